"""Removal of repeated long substrings, by suffix arrays of shards.

A byte goes if a 400-byte string that covers it also starts anywhere else in the corpus. Each
400-byte string has a minimiser: the leftmost smallest hash of its 160-byte parts. Equal strings
have equal minimisers, so strings are sharded by theirs, and neighbouring strings with one minimiser
travel as one slice. Slices are first counted by hash: a minimiser found once cannot repeat, and a
slice found twice repeats as a whole. Only where one minimiser has several different slices are
their bytes sent to its shard, once for each different slice, and there the suffix array and the
common prefixes of the shard's slices tell which strings repeat (suffixes.py), with queues on disk.
A minimiser with more than HOT different slices would make one shard as large as the corpus: its
strings are counted by their own hashes, spread over all tasks. Wherever a hash alone decides that
bytes go, two independent 64-bit hashes have to agree.

Beside that each document's passages are compared with other documents' at a smaller size: of any
240 bytes one 160-byte part is picked by its hash, and parts that stand in two documents or more are
counted (n_shared of n_parts). Nothing is removed for them.

Matches never cross documents; overlaps count; strings are judged on the input. Null and empty texts
have no bytes. Very long texts are hashed in segments and are one document of a chunk. Repeated rows
are copies of each other. Equal ids are different documents. An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ranges, shared_dir, stored
from .lm import add_up, blocks, get, put, spread, squeezed
from .suffixes import suffix_array
from .tokens import small_batches
from .words import mixed, powers

LENGTH, PART, NEAR = 400, 160, 240
CHUNK_BYTES, SEGMENT = 4_000_000, 400_000
#: Bytes of a shard's runs, tuples of a run that wait in memory (the others on disk), slices of a minimiser.
SHARD_BYTES, MEMORY, HOT = 2_000_000, 1 << 18, 64
#: Bytes of text for which there is one range of minimisers and one task.
RANGE_BYTES = 32_000_000
#: Bases of two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = "path string, kind int, shard int, place bigint, a binary, b binary"
NAMES = ["path", "kind", "shard", "place", "a", "b"]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


class Hashes:
    """Hashes of all parts of some bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(len(data), base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:-length]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, ~np.uint64(0), np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def slices(data: np.ndarray, lens: np.ndarray, length: int = LENGTH, part: int = PART, near: int = NEAR) -> tuple[tuple, tuple]:
    """((minimiser, hash, start, number of strings) of each slice, (hash, start) of each picked part);
    the documents stand one after another. Picked hashes are the least of many, so nearly all lie in the
    lowest range of values: they are mixed again (one to one), and ranges of them hold about equally many."""
    out, parts = [], []
    ends = np.cumsum(lens, dtype=np.int64)
    end_of = np.repeat(ends, lens)
    mask = np.uint64((1 << 23) - 1)
    for low in range(0, max(1, len(data) - near + 1), SEGMENT - length):
        here = data[low : low + SEGMENT]
        if len(here) < near:
            break
        h = Hashes(here)
        g = h.all(part)
        key = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        least = minima(key, near - part + 1)
        at = (least[low + np.arange(len(least)) + near <= end_of[low : low + len(least)]] & mask).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at  # one part is picked again and again
        parts.append((mixed(g[at]), low + at))
        if len(here) < length:
            continue
        n = len(here) - length + 1
        least = minima(key, length - part + 1)
        start = low + np.arange(n)
        fits = start + length <= end_of[low : low + n]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (end_of[low + 1 : low + n] != end_of[low : low + n - 1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(fits.astype(np.int64), first)
        first, count = first[count > 0], count[count > 0]
        own = SEGMENT - length
        inside = first < own  # the strings from there on belong to the next segment
        first, count = first[inside], np.minimum(count[inside], own - first[inside])
        at = (least[first] & mask).astype(np.int64)
        out.append((mixed(g[at]), h.of(first, count + length - 1), low + first, count))
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(none, *out, strict=True)), tuple(np.concatenate(x) for x in zip((none[0], none[2]), *parts, strict=True))


class Entries:
    """A chunk's documents, their slices and their picked parts; equal slices are one entry, entries are sorted by minimiser and hashes."""

    def __init__(self, path: str):
        self.ids, null, self.lens, self.data, self.key, self.of, self.start, self.count, self.part_of, self.part_doc = spread(get(path))
        self.null = null.astype(bool)

    @staticmethod
    def save(path: str, ids: list[int | None], texts: list[bytes]) -> tuple[tuple, tuple]:
        """((minimiser, both hashes, times) of each entry, (hash, documents) of each picked part); sorted"""
        from xxhash import xxh3_64_intdigest

        joined, lens = b"".join(texts), np.array([len(t) for t in texts], "<u4")
        data = np.frombuffer(joined, np.uint8)
        (key, h, start, count), (part, at) = slices(data, lens)
        view = memoryview(joined)
        other = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)), np.uint64, len(start))
        order = np.lexsort((other, h, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        some = order[new]
        n = np.bincount(of, minlength=len(some)).astype("<u4")
        doc = np.searchsorted(np.cumsum(lens, dtype=np.int64), at, "right")
        by = np.lexsort((doc, part))
        once = np.ones(len(by), bool)  # of a document's equal parts one
        once[1:] = (part[by][1:] != part[by][:-1]) | (doc[by][1:] != doc[by][:-1])
        by = by[once]
        parts, part_of, docs_n = np.unique(part[by], return_inverse=True, return_counts=True)
        put(path, squeezed(np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "<u2"), lens, data, key[some], of.astype("<u4"), start.astype("<u4"), count.astype("<u2"), part_of.astype("<u4"), doc[by].astype("<u4")))
        return (key[some], h[some], other[some], n), (parts, docs_n)

    def first(self) -> np.ndarray:
        """One slice of each entry."""
        out = np.zeros(len(self.key), np.int64)
        out[self.of[::-1]] = np.arange(len(self.of))[::-1]
        return out


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def table(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], NAMES)


REPEATS, SEND, TARGET, HOT_KEY = 1, 2, 4, 8


def judge(t: pa.Table) -> pa.Table:
    """One range of minimisers: for each chunk's entries what is to be done with them."""
    parts = [spread(x) for x in t["a"].to_pylist()]
    if not parts:
        return table([])
    size = [len(p[0]) for p in parts]
    key, h, other, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((np.arange(len(key)), other, h, key))
    k, hh, oo = key[order], h[order], other[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = np.r_[True, (k[1:] != k[:-1]) | (hh[1:] != hh[:-1]) | (oo[1:] != oo[:-1])]
    entry, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    total = np.bincount(entry, n[order])[entry]
    kinds = np.bincount(group, new)[group]
    verdict = np.zeros(len(key), np.uint16)
    several, hot = (kinds > 1) & (kinds <= HOT), kinds > HOT
    verdict[order] = (total > 1) * REPEATS + (several & new) * SEND + (several & (total > 1)) * TARGET + hot * HOT_KEY
    cuts = np.r_[0, np.cumsum(size)]
    return table([(p, 0, s, 0, squeezed(verdict[a:b].astype("<u2")), None) for p, s, a, b in zip(t["path"].to_pylist(), t["shard"].to_pylist(), cuts, cuts[1:], strict=False)])


def verdicts(t: pa.Table) -> np.ndarray:
    rows = sorted(zip(t["shard"].to_pylist(), t["a"].to_pylist(), strict=True))
    return np.concatenate([spread(x)[0] for _, x in rows]) if rows else np.zeros(0, np.uint16)


def hot_strings(e: Entries, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(slice, offset, both hashes) of each string of the slices whose minimiser is hot."""
    own = np.flatnonzero(verdict[e.of] & HOT_KEY)
    count = e.count[own].astype(np.int64)
    at = np.repeat(own, count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = e.start[at].astype(np.int64) + offset
    low = (start // SEGMENT) * SEGMENT
    out = [np.empty(len(at), np.uint64) for _ in BASES]
    for x in np.unique(low):
        m = low == x
        for h, base in zip(out, BASES, strict=True):
            h[m] = Hashes(e.data[x : x + SEGMENT + LENGTH], base).of(start[m] - x, np.full(m.sum(), LENGTH))
    return at, offset, out


def repeated(slices_: list[bytes], folder: str | None = None) -> list[np.ndarray]:
    """For each slice the offsets of the 400-byte strings that occur twice or more in these slices."""
    text = np.frombuffer(b"".join(x + b"\0" for x in slices_), np.uint8).astype(np.int16) + 1
    lens = np.array([len(x) for x in slices_], np.int64)
    ends = np.cumsum(lens + 1) - 1
    text[ends] = 0
    order, common = suffix_array(text, 257, LENGTH, MEMORY, folder)
    left = np.repeat(ends, lens + 1) - np.arange(len(text))
    twice = np.zeros(len(order), bool)
    twice[1:] = common[1:] >= LENGTH
    twice[:-1] |= common[1:] >= LENGTH
    at = np.zeros(len(text), bool)
    at[order[twice]] = True
    at &= left >= LENGTH
    return [np.flatnonzero(at[e - n : e]) for e, n in zip(ends, lens, strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, n_parts, n_shared, kept (bytes): one row per document."""
    spark = docs.sparkSession
    shards = ranges(docs, text_col, RANGE_BYTES)
    root = shared_dir(spark, "substrings")

    def counted_by_hash(path: str, kind: int, values: np.ndarray, n: np.ndarray) -> list[tuple]:
        b = blocks(path, values, n, shards)
        return [(path, kind, s, 0, c, m) for s, c, m in zip(b["shard"].to_pylist(), b["codes"].to_pylist(), b["counts"].to_pylist(), strict=True)]

    def cut(batches):
        ids, texts, size = [], [], 0

        def flush():
            path = f"{root}/{uuid.uuid4().hex}"
            (key, h, other, n), parts = Entries.save(path, ids, texts)
            shard = shard_of(key, shards)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            rows = [(path, 0, k, 0, squeezed(key[a:b], h[a:b], other[a:b], n[a:b]), None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            rows += counted_by_hash(path, 5, *parts)
            rows.append((path, 1, -1, 0, None, None))  # so that a chunk without slices is met again
            ids.clear(), texts.clear()
            return table(rows).to_batches()

        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append((text or "").encode())
                size += len(texts[-1]) + 16
                if size >= CHUNK_BYTES:
                    yield from flush()
                    size = 0
        if ids:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = stored(rows.mapInArrow(cut, ROWS), "slices")
    judged = stored(found.where("kind = 0").repartition(shards, "shard").groupBy("shard").applyInArrow(judge, ROWS), "verdicts")

    def send(t: pa.Table) -> pa.Table:
        path = t["path"][0].as_py()
        e, verdict = Entries(path), verdicts(t)
        out, first = [], e.first()
        send_some = np.flatnonzero(verdict & SEND)
        for x in send_some.tolist():
            s = first[x]
            body = e.data[e.start[s] : e.start[s] + e.count[s] + LENGTH - 1].tobytes()
            out.append((path, 0, int(e.key[x] >> np.uint64(33)), x if not verdict[x] & REPEATS else -1, body, int(e.key[x]).to_bytes(8, "little")))
        at, _, h = hot_strings(e, verdict)
        for kind, x in enumerate(h if len(at) else [], 3):
            out += counted_by_hash(path, kind, *np.unique(x, return_counts=True))
        return table(out)

    sent = stored(judged.repartition(shards, "path").groupBy("path").applyInArrow(send, ROWS), "sent")
    volume = sent.where("kind = 0").agg(F.sum(F.length("a"))).first()[0] or 0
    parts = max(1, -(-volume // SHARD_BYTES))

    def sort(t: pa.Table) -> pa.Table:
        """A shard; taken in runs of whole minimisers of bounded size."""
        rows = sorted(t.select(["b", "path", "place", "a"]).to_pylist(), key=lambda r: r["b"])
        out, run, size = [], [], 0

        def flush():
            for r, offsets in zip(run, repeated([r["a"] for r in run], f"{root}/queues"), strict=True):
                if r["place"] >= 0 and len(offsets):
                    out.append((r["path"], 2, 0, r["place"], squeezed(offsets.astype("<u2")), None))
            run.clear()

        for k, r in enumerate(rows):
            run.append(r)
            size += len(r["a"])
            if size >= SHARD_BYTES and (k + 1 == len(rows) or rows[k + 1]["b"] != r["b"]):
                flush()
                size = 0
        if run:
            flush()
        return table(out)

    sorted_ = sent.where("kind = 0").withColumn("shard", (F.col("shard") % parts).cast("int")).repartition(parts, "shard").groupBy("shard").applyInArrow(sort, ROWS)

    def summed(t: pa.Table) -> pa.Table:
        """One range of one kind of hash: the sums over all chunks, for each chunk's block."""
        sums = add_up(t.select(["path", "shard", "a", "b"]).rename_columns(["path", "shard", "codes", "counts"]))
        return table(list(zip(t["path"].to_pylist(), t["kind"].to_pylist(), t["shard"].to_pylist(), [0] * len(t), sums["sums"].to_pylist(), [None] * len(t), strict=True)))

    counts = sent.where("kind in (3, 4)").unionByName(found.where("kind = 5"))
    counted = counts.repartition(shards, "kind", "shard").groupBy("kind", "shard").applyInArrow(summed, ROWS)
    everything = judged.unionByName(found.where("kind = 1")).unionByName(stored(sorted_, "repeats")).unionByName(stored(counted, "hash-counts"))

    def finish(t: pa.Table) -> pa.Table:
        path, kind = t["path"][0].as_py(), t["kind"].to_numpy()
        e, verdict = Entries(path), verdicts(t.filter(pa.array(kind == 0)))
        n = len(e.data)
        edge = np.zeros(n + 1, np.int64)

        def cover(start, strings):  # the bytes of so many strings from each start
            np.add.at(edge, start, 1)
            np.add.at(edge, start + strings + LENGTH - 1, -1)

        if len(e.of):
            whole = (verdict[e.of] & REPEATS) > 0
            cover(e.start[whole].astype(np.int64), e.count[whole].astype(np.int64))
            first = e.first()
            some = t.filter(pa.array(kind == 2))
            for x, offsets in zip(some["place"].to_pylist(), some["a"].to_pylist(), strict=True):
                cover(int(e.start[first[x]]) + spread(offsets)[0].astype(np.int64), 1)
            at, offset, h = hot_strings(e, verdict)
            if len(at):
                twice = np.ones(len(at), bool)  # by both hashes
                for which, x in enumerate(h, 3):
                    twice &= verdicts(t.filter(pa.array(kind == which)))[np.unique(x, return_inverse=True)[1]] > 1
                cover(e.start[at[twice]].astype(np.int64) + offset[twice], 1)
        gone = np.cumsum(edge[:n]) > 0
        elsewhere = (verdicts(t.filter(pa.array(kind == 5)))[e.part_of] > 1) if len(e.part_of) else np.zeros(0, bool)
        n_parts, n_shared = (np.bincount(e.part_doc[m], minlength=len(e.lens)).tolist() for m in (np.ones(len(elsewhere), bool), elsewhere))
        rows, begin = [], 0
        for doc, null, size, p, q in zip(e.ids.tolist(), e.null.tolist(), e.lens.tolist(), n_parts, n_shared, strict=True):
            g, d = gone[begin : begin + size], e.data[begin : begin + size]
            removed = int(g.sum())
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed else 0
            rows.append((None if null else doc, size, removed, spans, p, q, d[~g].tobytes() if removed else d.tobytes()))
            begin += size
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "n_parts", "n_shared", "kept"])

    return everything.repartition(shards, "path").groupBy("path").applyInArrow(finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, n_parts bigint, n_shared bigint, kept binary")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_parts, n_shared, and score: the larger of the shares of bytes removed and of parts shared."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    score = F.greatest(share("n_removed", "n_bytes"), share("n_shared", "n_parts"))
    return remove_repeats(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_parts", "n_shared", score.alias("score"))
