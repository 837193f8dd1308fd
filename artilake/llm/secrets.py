"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern. Their values' hashes are counted over the corpus by distinct
repositories and owners: a value that many owners carry is a copied example, one that few carry
looks like a live credential. Base kinds (assign, access, hex) are always reported; the kind
`generic` (long mixed strings that no base span overlaps) is added only where the ownership count
says it is live-looking.

Null and empty texts have no spans. A null repository or owner counts as one of its own. Repeated
rows are reported each and count once by owner. A very long text's matches are one row's list. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, sifted, stored

#: The patterns of the base kinds, in the order of report.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of 18 and more characters: a run's first AKIA has its longest match
HEX = "[0-9a-f]{16,}"  # the same matches as [0-9a-f]+ of 16 and more characters
GENERIC = "[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "generic")
#: A value found with more owners or repositories than this is an example.
MOST_OWNERS, MOST_REPOS = 2, 2


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Structs (start, kind, end, value) of the pattern's leftmost non-overlapping matches whose
    group has `least` characters; positions in code points."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _overlaps(one: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < one["end"]) & (one["start"] < o["end"]))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """id, text_hash, repo, owner, base, extra: the spans by document, each list by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(_spans(F.col("text"), ASSIGN, 0, 2, ASSIGN_LEAST), _spans(F.col("text"), ACCESS, 1, 0, 1), _spans(F.col("text"), HEX, 2, 0, 1))))
    mixed = F.filter(_spans(F.col("text"), GENERIC, 3, 0, 1), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    extra = F.filter(mixed, lambda s: ~_overlaps(s, F.col("base")))
    return rows.select("id", F.xxhash64("text").alias("text_hash"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"), "base", extra.alias("extra"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repos, owners: over the whole corpus. Counts are made map-side, so a value that
    fills the corpus stays one row per task, repository and owner."""
    values = found.select("repo", "owner", F.explode(F.concat("base", "extra")).alias("s"))
    seen = values.select("repo", "owner", F.sha2("s.value", 256).alias("value_hash"))
    repos = seen.select("value_hash", "repo").distinct().groupBy("value_hash").agg(F.count("*").alias("repos"))
    owners = seen.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count("*").alias("owners"))
    return repos.join(owners, "value_hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """id, text_hash, base, spans, n_live, n_example: one row per document; spans are base and live generic
    spans by start and kind, each with its value's verdict."""
    found = stored(candidates(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    verdict = stored(ownership(found).select("value_hash", ((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)).alias("live")), "secret-owners")
    single = found.where((F.size("base") > 0) | (F.size("extra") > 0)).select("row", F.explode(F.concat("base", "extra")).alias("s"))
    judged = single.withColumn("value_hash", F.sha2("s.value", 256)).join(verdict, "value_hash")
    kept = judged.where(F.col("live") | (F.col("s.kind") < 3))
    one = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), "live")
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))  # one document's spans
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,live:boolean>>")
    spans = F.coalesce("spans", none)
    return found.join(by_row, "row", "left").select(
        "id", "text_hash", "base", spans.alias("spans"), F.size(F.filter(spans, lambda s: s["live"])).cast("bigint").alias("n_live"), F.size(F.filter(spans, lambda s: ~s["live"])).cast("bigint").alias("n_example")
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The rows, all columns; each reported span that is live-looking, and each base span, is replaced by the mark."""
    key, its_id, its_hash, spans = (free_name(c, docs) for c in ("_text_hash", "_found_id", "_found_hash", "_found_spans"))
    found = scan(docs, id_col, text_col, repo_col, owner_col).where(F.size("spans") > 0).select(F.col("id").alias(its_id), F.col("text_hash").alias(its_hash), F.col("spans").alias(spans)).distinct()
    found = stored(found, "secret-found")
    docs, clean = sifted(docs, docs[id_col].cast("bigint"), found, F.col(its_id))  # only rows that may have a span are dealt out
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(found, (rows[key] == found[its_hash]) & rows[id_col].cast("bigint").eqNullSafe(found[its_id]), "left")

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return rows.withColumn(text_col, F.when(F.col(spans).isNotNull(), done).otherwise(F.col(text_col))).select(*docs.columns).union(clean)


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    select id, '{kind}' kind, {order} ord, "end" - length(whole) s, "end" e, val from (
      select id, whole, val, sum(length(gap) + length(whole)) over (partition by id order by n rows unbounded preceding) "end" from (
        select doc_id id, unnest(string_split_regex(text, '{p}')[:-2]) gap, unnest(regexp_extract_all(text, '{p}', 0)) whole,
               unnest(regexp_extract_all(text, '{p}', {group})) val, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) n
        from documents where regexp_matches(text, '{p}')))
    where length(val) >= {least}"""


ORACLE = f"""
with base as ({" union all ".join([_sql_spans("assign", 0, ASSIGN, 2, ASSIGN_LEAST), _sql_spans("access", 1, ACCESS, 0, 1), _sql_spans("hex", 2, HEX, 0, 1)])}),
generic as (select * from ({_sql_spans("generic", 3, GENERIC, 0, 1)}) g
  where regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Z]') and regexp_matches(val, '[a-z]')
    and not exists (select 1 from base b where b.id = g.id and b.s < g.e and g.s < b.e)),
cand as (select * from base union all select * from generic),
own as (select val, count(distinct coalesce(source, chr(0))) n from cand join documents on id = doc_id group by val),
judged as (select cand.*, n <= {MOST_OWNERS} live from cand join own using (val)),
per as (select id, count(*) filter (ord = 0) n_assign, count(*) filter (ord = 1) n_access, count(*) filter (ord = 2) n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3) base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3 or live) spans,
  count(*) filter (live) n_live, count(*) filter (not live and ord < 3) n_example from judged group by id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from documents left join per on id = doc_id
"""
