"""N-gram Jaccard join by vertical partitioning, and its connected components.

A document's set holds the 64-bit codes of its distinct word n-grams. All codes stand in one global
order: light codes by value, then the heavy ones (found in many documents) by how many. The order
is cut into fragments; a set is the union of its parts in the fragments. Partial overlaps of a pair
are counted fragment by fragment and summed, so no set is shipped or compared as one piece. Before
that a sketch (how many codes of a set lie in each range of value) bounds the overlap of a pair, and
pairs that the bound rules out are dropped.

Candidates: two sets as similar as asked share a code among the first n - ceil(t * n) + 1 of each
in the global order (a bucket). Equal sets form one class and are compared once. Within a bucket
pairs are not expanded: first every class is compared with the bucket's leader, the class in which
the shared code stands foremost. A pair is compared only in buckets whose code, taken as the first
that both share, leaves enough codes behind it in each: a linked pair passes in the bucket of its
first shared code, and copies with many codes of their own pass with few others. Links give
components. In buckets that still hold several, the strays (classes outside the bucket's largest
component) are compared with the classes of other components, a growing number of strays a round,
until each has had its turn or the bucket is one component. So no link between components is missed,
whatever a bucket's size, and a group of copies costs one comparison each.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. With fewer
words than n the whole sequence is the one n-gram. Null texts, empty texts and texts without words
have an empty set and are linked with nothing. Repeated rows are rows of one class; equal ids count
as separate rows. Very long texts are hashed in pieces and their codes compared by fragment. A null id is never the smallest of a component that has another. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SIEVE_BITS, documents, free_name, released, sifted, stored, text_key
from .words import by_bytes, gram_sets

FRAGMENTS = 8  # of light codes; the heavy ones are one more
#: A task reports a code as heavy that it finds this often among so many codes; the table keeps the heaviest.
HEAVY_LOCAL, HEAVY_CODES, HEAVY_TABLE = 3, 1_000_000, 1 << 16
#: So many classes of a bucket are compared with its other components in the first round; GROWTH times as many in each further one.
LEADERS, GROWTH = 64, 8
#: In so many first rounds a class is compared in its largest bucket only.
ONCE = 1
#: A sketch counts a set's codes by range of value: about so many codes a range, between so many ranges.
SKETCH_CODES, SKETCH_RANGES = 4, (16, 1024)
#: A side with at most so many rows (of 50 bytes or so) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def counted(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of (codes, counts) by code; only the heaviest `most`."""
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)
    if len(values) > most:
        top = np.argpartition(-n, most)[:most]
        values, n = values[top], n[top]
    return values, n


def heavy_codes(docs: DataFrame, width: int) -> list[tuple[int, int]]:
    """(code, count), heaviest first: what the global order puts last. A guide to the order only;
    any table gives the same links."""

    def run(batches):
        total, held, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def count():
            nonlocal total
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            total = counted([total, (values[n >= HEAVY_LOCAL], n[n >= HEAVY_LOCAL])], 4 * HEAVY_TABLE)

        for batch in by_bytes(batches, 0):
            held.append(gram_sets(batch.column(0), width)[0])
            size += len(held[-1])
            if size > HEAVY_CODES:
                count()
                size = 0
        if held:
            count()
        values, n = counted([total], HEAVY_TABLE)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return [(r.code, r.n) for r in rows.orderBy(F.desc("n"), "code").limit(HEAVY_TABLE).collect()]


class Order:
    """The global order: light codes by value, then heavy ones, the heaviest last."""

    def __init__(self, heavy: list[tuple[int, int]]):
        code = np.array([c for c, _ in heavy], np.int64).view(np.uint64)
        by = np.argsort(code)
        self.codes, self.rank = code[by], (len(code) - np.arange(len(code)))[by]
        self.maybe = None

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """0 for light codes."""
        out = np.zeros(len(x), np.int64)
        if not len(self.codes):
            return out
        if self.maybe is None:  # few light codes share their first bits with a heavy one
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[(self.codes >> np.uint64(44)).astype(np.int64)] = True
        at = np.flatnonzero(self.maybe[(x >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.codes, x[at])
        k[k == len(self.codes)] = 0
        out[at] = np.where(self.codes[k] == x[at], self.rank[k], 0)
        return out

    @staticmethod
    def first(x: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
        """The first n of the sorted codes x, of these ranks, in the global order."""
        light = x[rank == 0]
        return light[:n] if len(light) >= n else np.concatenate([light, x[rank > 0][np.argsort(rank[rank > 0], kind="stable")][: n - len(light)]])

    @staticmethod
    def fragments(x: np.ndarray, rank: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(fragment, codes): the parts of the sorted codes x; light codes by range of value, then the heavy ones."""
        light = x[rank == 0]
        part = (light >> np.uint64(61)).astype(np.int64)
        out = [(k, light[part == k]) for k in range(FRAGMENTS)] + [(FRAGMENTS, x[rank > 0])]
        return [(k, c) for k, c in out if len(c)]


def sketch(x: np.ndarray) -> bytes:
    """How many of the codes lie in each of a power of two of ranges; 255 stands for that many or more."""
    least, most = SKETCH_RANGES
    bits = int(min(max(len(x) // SKETCH_CODES, least), most) - 1).bit_length()
    return np.minimum(np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """No two sets with these sketches share more codes: the smaller counts, range by range, summed."""
    x, y = (np.where(v == 255, 1 << 40, v.astype(np.int64)) for v in (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)).sum())


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    cuts = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)))


def sets(docs: DataFrame, order: Order, width: int, percent: int) -> DataFrame:
    """id, text_key, n, class (16 bytes that stand for the set), sketch, first (codes): one row per document."""
    from xxhash import xxh3_128_digest

    shared = docs.sparkSession.sparkContext.broadcast((order.codes, order.rank))  # HEAVY_TABLE codes at most

    def run(batches):
        of = Order([])
        of.codes, of.rank = shared.value
        for batch in by_bytes(batches, 2):
            x, at = gram_sets(batch.column(2), width)
            rank, cuts = of.ranks(x), at.tolist()
            n = np.diff(at)
            spans = list(zip(cuts, cuts[1:], strict=False))
            first = [of.first(x[a:b], rank[a:b], b - a - -(-percent * (b - a) // 100) + 1) if b > a else x[:0] for a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([xxh3_128_digest(x[a:b].tobytes()) for a, b in spans], pa.binary()), pa.array([sketch(x[a:b]) for a, b in spans], pa.binary()), _lists(first)],
                ["id", "text_key", "n", "class", "sketch", "first"],
            )

    return docs.select("id", "text_key", "text").mapInArrow(run, "id bigint, text_key binary, n bigint, class binary, sketch binary, first array<bigint>")


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows; otherwise its joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fragments(source: DataFrame, heads: DataFrame, order: Order, width: int) -> DataFrame:
    """c, fragment, codes of the classes in heads (c, id, text_key), from their texts in the source; rows may repeat.
    A bit map of SIEVE_BITS, whatever the input's size, tells most other texts apart where they are
    read, so that no text is dealt out; the join by id and key is exact."""
    heads = stored(heads, "wanted")
    place = F.pmod(F.xxhash64("text_key"), F.lit(SIEVE_BITS))
    maps = heads.select(place.alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).collect()
    sieve = np.zeros(SIEVE_BITS // 8 + 4096, np.uint8)  # buckets of 4096 bytes, numbered from 1; number 0 holds place 0 only
    for k, bits in maps:
        sieve[k * 4096 : k * 4096 + 4096] = np.frombuffer(bits, np.uint8)
    shared = source.sparkSession.sparkContext.broadcast((order.codes, order.rank, sieve))
    at = F.expr("bitmap_bucket_number(place) * 32768 + bitmap_bit_position(place)")

    def run(batches):
        of = Order([])
        of.codes, of.rank, bits = shared.value

        def wanted():
            for batch in batches:
                k = batch.column(3).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(bits[k >> 3] >> (k & 7).astype(np.uint8) & 1 == 1))

        for batch in by_bytes(wanted(), 2):
            x, cuts = gram_sets(batch.column(2), width)
            rank = of.ranks(x)
            rows, fragment, codes = [], [], []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for f, c in of.fragments(x[a:b], rank[a:b]):
                    rows.append(k)
                    fragment.append(f)
                    codes.append(c)
            if rows:
                rows = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(fragment, pa.int32()), _lists(codes)], ["_id", "_key", "fragment", "codes"])

    found = source.withColumn("place", place).select("id", "text_key", "text", at.cast("bigint").alias("at")).mapInArrow(run, "_id bigint, _key binary, fragment int, codes array<bigint>")
    few = small(heads)
    out = stored(found.join(few, (found["_key"] == few["text_key"]) & found["_id"].eqNullSafe(few["id"])).select("c", "fragment", "codes"), "fragments")
    released(heads)
    return out


def hopeful(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) that may be similar by their sketches. It drops no similar pair."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (1, 3))
            most = np.array([most_shared(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "na", "b", "nb"]).filter(pa.array(np.minimum(most, np.minimum(na, nb)) * (100 + percent) >= (na + nb) * percent))

    left = small(pairs).join(rows.select(F.col("row").alias("a"), F.col("sketch").alias("sa")), "a")
    both = left.join(rows.select(F.col("row").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "na", "b", "nb", "sa", "sb").mapInArrow(run, "a bigint, na bigint, b bigint, nb bigint")


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs (a, na, b, nb) that are similar. Partial overlaps are counted by fragment and summed.
    Each fragment of a b travels once for each a that it is compared with; an a's fragments travel once."""
    theirs = parts.select(F.col("c").alias("b"), "fragment", F.col("codes").alias("cb")).join(small(pairs), "b")
    leaders = stored(pairs.select("a").distinct(), "leaders")
    ours = parts.select(F.col("c").alias("a"), "fragment", F.col("codes").alias("ca")).join(small(leaders), "a", "left_semi")
    both = theirs.join(ours.hint("merge"), ["a", "fragment"])
    overlap = both.select("a", "na", "b", "nb", "fragment", F.size(F.array_intersect("ca", "cb")).cast("bigint").alias("part")).distinct()  # fragments may repeat
    total = overlap.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("both"))
    return total.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """c, label: for each end of a link the smallest end that it reaches. Labels spread over links and
    jump along each other, so the rounds grow with the logarithm of a component's length."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "c"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "c").select("c", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("over"))
        after = stored(spread.join(jump, "label").select("c", "was", F.least("label", "over").alias("label")), "labels")
        labels = after.select("c", "label")
        if not after.where("label < was").limit(1).count():
            released(edges)
            return labels


def join(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, n, row, component_row, component_id: one row per document. component_id is the
    smallest id of the component, component_row the row that stands for it (its smallest id, then row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), text_key(text).alias("text_key"))
    order = Order(heavy_codes(source, width))
    rows = stored(sets(source, order, width, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = stored(rows.where("n > 0").groupBy("class").agg(F.min("row").alias("c")), "classes")
    members = stored(rows.where("n > 0").select("id", "text_key", "n", "row", "class").join(classes, "class").drop("class"), "members")
    again = members.where("row <> c").select(F.col("row").alias("other"))  # other rows of a class
    sets_of = rows.where("n > 0").select("row", "n", "first")
    maybe, alone = sifted(sets_of, F.col("row"), again, F.col("other"))
    ones = alone.unionByName(maybe.join(again, F.col("row") == F.col("other"), "left_anti"))
    firsts = ones.select(F.col("row").alias("c"), F.col("n").cast("int").alias("n"), F.posexplode("first").alias("place", "code"))
    same = Window.partitionBy("code")  # first codes are dealt out once, to be counted and to find their leader
    entries = firsts.withColumn("size", F.count("*").over(same)).withColumn("lead", F.min(F.struct("place", "c", "n")).over(same)).where("size > 1")
    buckets = entries.select("code", "c", F.col("n").cast("bigint").alias("n"), (F.col("n") - F.col("place")).alias("rest"), "size", F.col("lead.c").alias("leader"), F.col("lead.n").cast("bigint").alias("leader_n"), (F.col("lead.n") - F.col("lead.place")).alias("leader_rest"))
    buckets = stored(buckets, "buckets")
    heads = members.where("row = c").select("c", "id", "text_key")

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar: first by their sketches, then what is left by all fragments."""
        pairs = stored(pairs.distinct(), "pairs")
        hope = stored(hopeful(pairs, rows, percent), "hopeful")
        parts = fragments(source, ends(hope), order, width)
        links = stored(linked(hope, parts, percent), "links")
        released(pairs, hope, parts)
        return links

    def ends(pairs: DataFrame) -> DataFrame:
        return heads.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c")

    def enough(n1: str, rest1: str, n2: str, rest2: str) -> Column:
        """Could two sets be similar whose first shared code has so many codes from it on in each?"""
        return F.least(rest1, rest2) * (100 + percent) >= (F.col(n1) + F.col(n2)) * percent

    star = buckets.where("c <> leader").where(enough("n", "rest", "leader_n", "leader_rest")).select(F.col("leader").alias("a"), F.col("leader_n").alias("na"), F.col("c").alias("b"), F.col("n").alias("nb"))
    links = compared(star)
    labels = components(links)
    active, leaders, once = buckets.where("size > 2 and c <> leader").select("code", "c", "n", "rest"), LEADERS, ONCE
    while True:  # each round finishes some or all of the strays of each bucket
        named = active.join(labels, "c", "left").select("code", "c", "n", "rest", F.coalesce("label", "c").alias("label"))
        sizes_of = named.groupBy("code", "label").agg(F.count("*").alias("m")).groupBy("code").agg(F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("top"))
        open_ = stored(sizes_of.where("size > top.m").select("code", F.col("top.label").alias("main"), "size", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), (F.col("size") - F.col("top.m")) / leaders)))).cast("bigint").alias("turns")), "open")
        turns = open_.agg(F.max("turns")).first()[0]
        if turns is None:
            break
        # turns are powers of two, so that the same classes lead in all of their buckets
        named = stored(named.join(open_, "code").withColumn("leads", (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("c", F.lit(leaders)), "turns") == 0)), "active")
        if once > 0:  # most strays find their link in their largest bucket; the others are open to all later rounds
            largest = named.where("leads").groupBy("c").agg(F.max(F.struct("size", "code")).alias("own")).select("c", F.col("own.code").alias("code"), F.lit(True).alias("chosen"))
            named = stored(named.join(largest, ["c", "code"], "left").withColumn("leads", F.col("leads") & F.col("chosen").isNotNull()).drop("chosen"), "active")
        one = named.where("leads").select("code", F.col("c").alias("p"), F.col("n").alias("np"), F.col("rest").alias("rp"), F.col("label").alias("lp"))
        other = named.select("code", F.col("c").alias("q"), F.col("n").alias("nq"), F.col("rest").alias("rq"), F.col("label").alias("lq"))
        pairs = one.join(other, "code").where((F.col("lp") != F.col("lq")) & enough("np", "rp", "nq", "rq")).select(
            F.least("p", "q").alias("a"), F.when(F.col("p") < F.col("q"), F.col("np")).otherwise(F.col("nq")).alias("na"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("nq")).otherwise(F.col("np")).alias("nb")
        )
        more = compared(pairs)
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
        if turns == 1 and once <= 0:
            break
        once -= 1
        active, leaders = named.where(~F.col("leads")).select("code", "c", "n", "rest"), GROWTH * leaders

    final = members.join(labels, "c", "left").select("id", "text_key", "n", "row", F.coalesce("label", "c").alias("label"))
    final = stored(final.unionByName(rows.where("n = 0").select("id", "text_key", "n", "row", F.col("row").alias("label"))), "labelled")
    released(rows, buckets, members, classes)
    heads = stored(final.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head")).select("label", F.col("head.id").alias("component_id"), F.col("head.row").alias("component_row")), "heads")
    return final.join(heads, "label").select("id", "text_key", "n", "row", "component_row", "component_id")


def keep_first(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that stand for their component. Of rows that repeat an id and text the one
    stays whose columns hash lowest; all rows without words stay."""
    grouped = stored(join(docs, width, percent, id_col, text_col), "grouped")
    heads = grouped.where("row = component_row or n = 0").select(F.col("id").alias(free_name("_id", docs)), F.col("text_key").alias(free_name("_key", docs)), (F.col("n") > 0).alias(free_name("_words", docs)))
    heads = stored(heads.distinct(), "kept")
    its_id, its_key, words = (heads[c] for c in heads.columns)
    # rows whose id no row shares that goes stay as they are; only the others are dealt out
    gone = grouped.where("row <> component_row and n > 0").select("id")
    docs, stay = sifted(docs, docs[id_col].cast("bigint"), gone, F.col("id"))
    key = text_key(F.coalesce(docs[text_col], F.lit("")))
    same = (key == its_key) & docs[id_col].cast("bigint").eqNullSafe(its_id)
    if not grouped.where("n > 0").groupBy("id", "text_key").count().where("count > 1").limit(1).count():
        return stay.union(docs.join(heads, same, "left_semi"))
    place = free_name("_place", docs)
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    by = Window.partitionBy(docs[id_col], docs[text_col]).orderBy(F.xxhash64(*[docs[c] for c in hashed]))
    with_words = docs.join(heads, same & words, "left_semi").withColumn(place, F.row_number().over(by)).where(F.col(place) == 1).drop(place)
    return stay.union(with_words).union(docs.join(heads, same & ~words, "left_semi"))


def op9_vertical_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
