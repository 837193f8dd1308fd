"""Queries over the driver's tables, by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import documents, inventory, magics, packs, signatures, stats, strings
from ..sources import images
from . import relations, reports, values  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES, query, table  # noqa: F401

BYTES = "b as (select doc_id, unnest(range(len(h))) o, unnest(h) x from (select doc_id, regexp_extract_all(hex(encode(text)), '..') h from documents))"
HIST = f"{BYTES}, h as (select doc_id, x, count(*) n from b group by all), t as (select doc_id, sum(n) tot, sum(n*n)::double q from h group by all)"
ENTROPY = f"{HIST}, e as (select doc_id, abs(round(-sum((n/tot)*log2(n/tot)), 4)) entropy from h join t using (doc_id) group by all)"


def _hits_sql() -> str:
    """id, name, found: patterns that match, as in signatures.match()."""
    out = []
    for name, _, patterns in signatures.LICENSES:
        for seq, (regex, weight, group) in enumerate(patterns):
            r = regex.replace("'", "''")
            version = f"coalesce(list_filter(regexp_extract_all(text, '{r}', {group}), lambda v: v <> '')[1], '')" if group else "''"
            at = f"coalesce(list_position(list_transform(regexp_extract_all(text, '{r}', {group}), lambda v: v <> ''), true), 1)" if group else "1"
            out.append(f"select doc_id id, source, '{name}' as name, {seq} seq, {weight}::double w, {version} v, regexp_extract_all(text, '{r}')[{at}] e from documents where regexp_matches(text, '{r}')")
    return f"""m as ({" union all ".join(out)}), hits as (select id, source, name, count(*) n_patterns, round(least(0.97::double, max(w) + 0.05::double * (count(*) - 1)), 2) confidence,
      coalesce(arg_min(v, seq) filter (v <> ''), '') as version, string_agg(e, ' | ' order by seq) evidence from m group by all)"""


HITS = _hits_sql()


def hits(spark, sf_dir):
    return signatures.match(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"with {HITS} select id doc_id, name, n_patterns, confidence, version, evidence from hits")
def sig_hits(spark, sf_dir):
    return hits(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query(f"with {HITS} select name, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as level, count(*) n from hits group by all")
def sig_levels(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("name", signatures.level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


@query(f"with {HITS} select k.name, k.supplier, count(id) payloads, max(confidence) best from (values {', '.join(str((n, s)) for n, s, _ in signatures.LICENSES)}) k(name, supplier) left join hits using (name) group by all")
def sig_coverage(spark, sf_dir):
    return signatures.coverage(hits(spark, sf_dir), signatures.names(spark))


@query(f"with {HITS} select doc_id from documents where doc_id not in (select id from hits)")
def sig_not_found(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(hits(spark, sf_dir).select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


@query(f"with {HITS}, r as (select *, row_number() over (partition by source, name order by confidence desc, (version <> '') desc, id) k, count(*) over (partition by source, name) payloads from hits) select source, name, confidence, version, id, payloads from r where k = 1")
def merge_by_source(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return signatures.merged(hits(spark, sf_dir).join(source, "id"), "source")


@query("select name, supplier, priority, place from (select *, min(seq) over (partition by name) place, row_number() over (partition by name order by priority desc, seq) k from (values ('a','x',1,0),('b','y',1,1),('a','z',2,2),('c','w',1,3),('b','v',0,4)) t(name, supplier, priority, seq)) where k = 1")
def sig_pack_override(spark, sf_dir):
    rows = [("a", "x", 1, 0), ("b", "y", 1, 1), ("a", "z", 2, 2), ("c", "w", 1, 3), ("b", "v", 0, 4)]
    return signatures.override(signatures.packs(spark, rows))


@query("select doc_id, md5(text) md5, sha1(text) sha1, sha256(text) sha256, strlen(text) n_bytes from documents")
def artifact_hashes(spark, sf_dir):
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(data).alias("md5"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


RUNS = """with b as (select {key} id, unnest(range(len(h))) o, unnest(h) x from (select {key}, regexp_extract_all(hex(encode({col})), '..') h from {table})),
p as (select id, o, x, o - row_number() over (partition by id order by o) g from b where x between '20' and '7E')
select id, min(o) as "offset", decode(unhex(string_agg(x, '' order by o))) as text from p group by id, g having count(*) >= {least}"""


@query(RUNS.format(key="doc_id", col="text", table="documents", least=6))
def string_runs(spark, sf_dir):
    return strings.string_runs(table(spark, sf_dir, "documents"), "doc_id", "text", 6)


@query(RUNS.format(key="page_id", col="html", table="pages", least=10))
def string_runs_min10(spark, sf_dir):
    return strings.string_runs(table(spark, sf_dir, "pages"), "page_id", "html", 10)


@query("select doc_id, len(r) runs, coalesce(list_sum(list_transform(r, lambda x: length(x))), 0)::bigint as characters from (select doc_id, regexp_extract_all(text, '[\\x20-\\x7E]{6,}') r from documents)")
def string_stats(spark, sf_dir):
    return strings.string_stats(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def doc_stats(spark, sf_dir, bank=None):
    return stats.byte_stats(table(spark, sf_dir, "documents"), "doc_id", "text", bank).withColumnRenamed("id", "doc_id")


@query(f"with {ENTROPY} select doc_id, entropy from e")
def byte_entropy(spark, sf_dir):
    return doc_stats(spark, sf_dir).select("doc_id", F.round("entropy", 4).alias("entropy"))


@query(f"with {HIST} select doc_id, round(256.0*q/tot - tot, 1) chi_square from t")
def byte_chi_square(spark, sf_dir):
    return doc_stats(spark, sf_dir).select("doc_id", F.round("chi_square", 1).alias("chi_square"))


@query(f"with {BYTES}, r as (select doc_id, x, o - row_number() over (partition by doc_id, x order by o) g from b), n as (select doc_id, count(*) n from r group by doc_id, x, g) select doc_id, max(n) longest_run from n group by doc_id")
def longest_run(spark, sf_dir):
    return doc_stats(spark, sf_dir).select("doc_id", "longest_run")


@query(f"with {BYTES} select doc_id, round(avg((x between '20' and '7E')::int), 4) printable from b group by doc_id")
def printable_ratio(spark, sf_dir):
    return doc_stats(spark, sf_dir).select("doc_id", F.round("printable", 4).alias("printable"))


@query("with b as (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '.{32}')) x from documents), n as (select doc_id, x, count(*) n from b group by all) select doc_id, sum(n - 1)::bigint duplicate_blocks from n group by doc_id having sum(n - 1) > 0")
def dup_blocks16(spark, sf_dir):
    return doc_stats(spark, sf_dir).where("duplicate_blocks > 0").select("doc_id", "duplicate_blocks")


@query(f"with {ENTROPY} select doc_id, case when entropy < 6.5 then 'plaintext' when entropy < 7.5 then 'mixed' else 'opaque' end verdict from e")
def opacity_verdict(spark, sf_dir):
    return doc_stats(spark, sf_dir).select("doc_id", stats.opacity(F.round("entropy", 4)).alias("verdict"))


@query(f"with {BYTES}, h as (select doc_id, o // 1024 bank, x, count(*) n from b group by all), t as (select doc_id, bank, sum(n)::bigint n_bytes from h group by all) select doc_id, bank, n_bytes, abs(round(-sum((n/n_bytes)*log2(n/n_bytes)), 4)) entropy from h join t using (doc_id, bank) group by all")
def bank_stats(spark, sf_dir):
    return doc_stats(spark, sf_dir, 1024).select("doc_id", "bank", "n_bytes", F.round("entropy", 4).alias("entropy"))


BANK_ROWS = "h as (select doc_id, hex(encode(text)) h from documents), b as (select doc_id, unnest(range((strlen(h) // 2 + 1023) // 1024)) bank, h from h), p as (select doc_id, bank, substr(h, bank * 2048 + 1, 2048) x from b), s as (select *, regexp_replace(x, '(..)', '\\1 ', 'g') y, strlen(x) // 2 n from p)"


@query(f"""with {BANK_ROWS} select doc_id, bank, bank * 1024 as start, bank * 1024 + n - 1 as "end", n size, round(100.0 * len(regexp_extract_all(y, 'FF ')) / n, 3) ff_percent, round(100.0 * len(regexp_extract_all(y, '00 ')) / n, 3) zero_percent, len(regexp_extract_all(y, '(?:(?:[2-6][0-9A-F]|7[0-9A-E]) ){{6,}}')) strings, sha256(unhex(x)) sha256 from s""")
def bank_table(spark, sf_dir):
    rows = stats.bank_table(table(spark, sf_dir, "documents"), "doc_id", "text", 1024).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", "bank", "start", "end", "size", F.round("ff_percent", 3).alias("ff_percent"), F.round("zero_percent", 3).alias("zero_percent"), "strings", "sha256")


@query("""select event_id, case when k = 0 then 'plaintext' when e < 6.5 then 'plaintext' when e < 7.5 then 'mixed' when k = 1 then 'compressed (gzip)' when k = 2 then 'compressed (zip)' else 'opaque' end verdict from (select event_id, event_id % 4 k, (event_id % 800) / 100.0 e from events)""")
def opacity_rules(spark, sf_dir):
    k = F.col("event_id") % 4
    head = F.when(k == 1, F.lit(b"\x1f\x8b\x08")).when(k == 2, F.lit(b"PK\x03\x04")).otherwise(F.lit(b"none"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", stats.opacity((F.col("event_id") % 800) / 100, F.when(k == 0, "arm"), magics.compression(head)).alias("verdict"))


#: name, supplier, patterns of addresses and version words, over the strings of documents.
WORDS = [("address", "", [("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", 0.5, 0), ("version ([0-9]+)", 0.6, 1)]), ("mail", "", [("[a-z]+@[a-z]+", 0.95, 0), ("[a-z]+@[a-z]+\\.org", 0.4, 0)])]


def _string_hits_sql(pack) -> str:
    one = []
    for name, _, patterns in pack:
        for seq, (regex, weight, group) in enumerate(patterns):
            version = f"nullif(regexp_extract(text, '{regex}', {group}), '')" if group else "null::varchar"
            one.append(f"select id, \"offset\" o, '{name}' as name, {seq} seq, {weight}::double w, {version} v, regexp_extract(text, '{regex}', 0) e from runs where regexp_matches(text, '{regex}')")
    return f"""with runs as ({RUNS.format(key="doc_id", col="text", table="documents", least=6)}), m as ({" union all ".join(one)}), r as (select *, row_number() over (partition by id, name, seq order by v is null, o) k from m), b as (select *, regexp_extract(e, '\\bv?([0-9]+\\.[0-9]+(?:\\.[0-9]+)+(?:-[A-Za-z0-9]+)?)\\b', 1) t from r where k = 1),
g as (select id, name, round(least(0.97::double, max(w) + 0.05::double * (count(*) - 1)), 2) confidence, arg_min(v, seq) filter (v is not null) v, arg_min(t, seq) filter (t <> '') t, string_agg(o || ':' || e, ' | ' order by seq) evidence from b group by id, name)
select id, name, confidence, coalesce(v, t) as version, v is null and t is not null as inferred, evidence from g"""


@query(_string_hits_sql(signatures.LICENSES))
def sig_string_hits(spark, sf_dir):
    return signatures.match_strings(strings.string_runs(table(spark, sf_dir, "documents"), "doc_id", "text", 6))


@query(_string_hits_sql(WORDS))
def sig_version_inferred(spark, sf_dir):
    return signatures.match_strings(strings.string_runs(table(spark, sf_dir, "documents"), "doc_id", "text", 6), WORDS)


@query("""select p_partkey, case p_partkey % 12 when 0 then 'no name' when 1 then 'no type' when 2 then 'unknown type' when 3 then 'purl with a version' when 4 then 'purl does not begin with pkg:' when 5 then 'no description' when 6 then 'empty version_note' when 7 then 'no patterns' when 8 then 'regex does not compile' when 9 then 'weight outside (0, 1]' when 10 then 'vgroup beyond the capture groups' end problem from part""")
def pack_problems(spark, sf_dir):
    """A signature made of each part, most of them breaking one rule."""
    k = F.col("p_partkey") % 12
    pattern = F.struct(F.when(k == 8, "a(").otherwise("a(b)(?:c)").alias("regex"), F.when(k == 9, F.col("p_size") + 1.0).otherwise(F.col("p_size") / 50).alias("weight"), F.when(k == 10, 2).otherwise(1).cast("bigint").alias("vgroup"))
    good = F.array(F.struct(F.lit("x").alias("regex"), F.lit(1.0).alias("weight"), F.lit(None).cast("bigint").alias("vgroup")), pattern)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k != 0, F.col("p_name")).alias("name"), F.when(k == 1, " ").when(k == 2, "thing").otherwise("library").alias("type"), F.when(k == 3, "pkg:x/a@1").when(k == 4, "x/a").otherwise("pkg:x/a").alias("purl"),
        F.when(k != 5, "text").alias("description"), F.when(k == 6, " ").alias("version_note"), F.when(k == 7, F.slice(good, 1, 0)).otherwise(good).alias("patterns"),
    )
    return packs.checked(rows, "p_partkey").select("p_partkey", "problem")


@query(f"with {ENTROPY}, r as (select source, doc_id id, entropy, count(*) over (partition by source) payloads, row_number() over (partition by source order by entropy desc, doc_id) k from e join documents using (doc_id)) select source, id, entropy, payloads from r where k = 1")
def headline_opacity(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return stats.headline(stats.byte_stats(table(spark, sf_dir, "documents"), "doc_id", "text").join(source, "id"), "source")


RECONCILE = """with o as (select p_partkey observed_id, lower(p_name) name, p_brand || '/' || p_type as purl, nullif((p_size % 7)::varchar, '0') as version from part),
d as (select p_partkey declared_id, case when p_partkey % 5 = 0 then 'unknown-' || p_partkey else lower(p_name) end name, case when p_partkey % 3 = 0 then null else p_brand || '/' || p_type || '/' || p_partkey end purl, case when p_partkey % 4 = 0 then '9' else nullif((p_size % 7)::varchar, '0') end as version from part),
k as (select declared_id, d.version dv, 0 place, purl as key from d union all select declared_id, version, 1, name from d),
j as (select distinct observed_id, version ov, purl as key from o union select observed_id, version, name from o),
m as (select declared_id, dv, observed_id, ov, row_number() over (partition by declared_id order by place, observed_id, ov nulls first) r from k join j using (key)),
x as (select declared_id, observed_id, case when ov is null or dv is null or ov = dv then 'agree' else 'conflict' end status, ov is not null and dv is not null versions_compared from m where r = 1)
select * from x union all select declared_id, null, 'declared_only', false from d where declared_id not in (select declared_id from x)
union all select null, observed_id, 'observed_only', false from o where observed_id not in (select observed_id from x)"""


@query(RECONCILE)
def reconcile_declared(spark, sf_dir):
    part, size = table(spark, sf_dir, "part"), F.nullif((F.col("p_size") % 7).cast("string"), F.lit("0"))
    purl, key = F.concat_ws("/", "p_brand", "p_type"), F.col("p_partkey")
    observed = part.select(key.alias("observed_id"), F.lower("p_name").alias("name"), purl.alias("purl"), size.alias("version"))
    declared = part.select(
        key.alias("declared_id"), F.when(key % 5 == 0, F.concat(F.lit("unknown-"), key)).otherwise(F.lower("p_name")).alias("name"),
        F.when(key % 3 != 0, F.concat_ws("/", purl, key)).alias("purl"), F.when(key % 4 == 0, "9").otherwise(size).alias("version"),
    )
    return inventory.reconcile(observed, declared, ["purl", "name"])


@query("select 'part' kind, p_name as name from part union all select 'supplier', s_name from supplier union all select 'customer', c_name from customer")
def component_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(c).alias("name")) for t, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select l_orderkey, l_linenumber, o_custkey as owner from lineitem join orders on l_orderkey = o_orderkey")
def owner_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("owner"))


@query("select distinct s_nationkey src_owner, c_nationkey dst_owner from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey where s_nationkey <> c_nationkey")
def edge_lift(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).distinct()
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.col("s_nationkey").alias("owner"))
    own = own.union(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.col("c_nationkey")))
    return inventory.lift_edges(edges, own)


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def unowned(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) select user_id, event_id, event_type from r where k = 1 and event_type <> 'error'")
def latest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return inventory.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("with r as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) k from events) select user_id, event_type, event_id from r where k = 1")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return inventory.earliest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("with n as (select source, lang, count(*) n from documents group by all), r as (select *, row_number() over (partition by source order by n desc, lang) k from n) select source, lang, n from r where k = 1")
def mode_architecture(spark, sf_dir):
    return inventory.mode(table(spark, sf_dir, "documents"), "source", "lang")


@query("with i as (select user_id, floor(epoch(ts))::bigint s, floor(epoch(ts))::bigint + 3600 e from events), g as (select user_id, s, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) t from i) select user_id, t gap_start, s gap_end from g where s > t")
def interval_gaps(spark, sf_dir):
    s = F.unix_timestamp("ts")
    return inventory.gaps(table(spark, sf_dir, "events").select("user_id", s.alias("s"), (s + 3600).alias("e")), "user_id", "s", "e")


@query("with d as (select user_id, event_id - lag(event_id) over (partition by user_id order by ts, event_id) d from events) select user_id, count(*) n, avg((d = 1)::int::double) step_ratio from d where d is not null group by user_id")
def step_counter(spark, sf_dir):
    return inventory.steps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")


@query("with s as (select page_id, lower(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\\.[^.]*$', '')) stem from pages) select stem, count(*) n, min(page_id) first_page from s group by stem having count(*) > 1")
def duplicate_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(scalars.url_stem(F.col("url")).alias("stem")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query("select r_name || '/' || n_name || '/' || c_name as path, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def path_tree(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), "c_custkey")


@query("select source, count(*) payloads, sum(strlen(text))::bigint n_bytes, count(distinct lang) langs, max(n_chars) longest from documents group by source")
def batch_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("payloads"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


@query("select event_id, event_type, json_extract(props, '$.k')::bigint k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"with {BYTES} select doc_id, avg((x in ('00', 'FF'))::int) >= 0.99 as blank from b where o < 1048576 group by doc_id union all select doc_id, true from documents where strlen(text) = 0")
def blank_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", stats.blank(F.encode("text", "UTF-8")).alias("blank"))


@query()
def cyclonedx_doc(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return documents.cyclonedx(signatures.merged(hits(spark, sf_dir).join(source, "id"), "source"), "source")


@query()
def spdx_doc(spark, sf_dir):
    return documents.spdx(cyclonedx_doc(spark, sf_dir), "source")


@query("select page_id, 'raw' kind, strlen(html) n_bytes from pages")
def image_kinds(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return pages.select("page_id", images.kind(F.col("content")).alias("kind"), F.octet_length("content").cast("bigint").alias("n_bytes"))
