"""Queries of report rows over the driver's tables: orders stand for segments, parts for packages, suppliers for filesystems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from .registry import query, table


@query("""select p_name as name, null::varchar as version, null::varchar purl, 'signature' as source from part union all select s_name, '1', 'pkg:x/' || s_suppkey, 'embedded-standard' from supplier union all select c_name, c_mktsegment, null, 'package-database' from customer""")
def found_components(spark, sf_dir):
    none = F.lit(None).cast("string")
    return evidence.found_components({
        "signature": table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), none.alias("version"), none.alias("purl")),
        "embedded-standard": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("1").alias("version"), F.concat(F.lit("pkg:x/"), "s_suppkey").alias("purl")),
        "package-database": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("version"), none.alias("purl")),
    })


@query("""select p_name as name, case when p_size > 9 then '1.' || p_size end as version, 'pkg:deb/' || p_name || case when p_size > 9 then '@1.' || p_size else '' end || case when p_partkey % 2 = 0 then '?arch=arm' else '' end purl, substr(repeat(p_type || ' ', 40), 1, 400) description, case when p_size > 9 then 0.97::double else 0.9::double end confidence from part""")
def package_components(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 9, F.concat(F.lit("1."), "p_size")).alias("version"), F.when(F.col("p_partkey") % 2 == 0, "arm").alias("architecture"), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(40)).alias("description"), F.lit("deb").alias("purl_type"))
    return evidence.package_components(rows)


@query("""with n as (select distinct p_brand g, p_size::varchar ref from part), e as (select p_brand g, p_size::varchar src, (p_partkey % 60)::varchar dst from part union select p_brand, (p_partkey % 50)::varchar, p_size::varchar from part),
k as (select distinct e.* from e join n on n.g = e.g and n.ref = e.dst where src <> dst) select n.g, ref, coalesce(string_agg(dst, ' ' order by dst), '') depends_on from n left join k on k.g = n.g and src = ref group by all""")
def dependency_graph(spark, sf_dir):
    part, size, key = table(spark, sf_dir, "part"), F.col("p_size").cast("string"), F.col("p_partkey")
    edge = lambda src, dst: part.select(F.col("p_brand").alias("g"), src.cast("string").alias("src"), dst.cast("string").alias("dst"))
    nodes = part.select(F.col("p_brand").alias("g"), size.alias("ref"))
    return evidence.dependency_graph(nodes, edge(size, key % 60), edge(key % 50, size), "g").withColumn("depends_on", F.array_join("depends_on", " "))


@query("""with f as (select o_custkey image, nullif(o_orderstatus || o_orderpriority, 'x') part, min(o_orderkey) at_ from orders group by all), r as (select *, row_number() over (partition by image order by at_) k from f where part is not null) select image, string_agg(part, ' + ' order by k) format from r where k <= 6 group by image""")
def detected_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), "o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("part"))
    return evidence.detected_format(rows, "image", "o_orderkey", "part")


@query("""with e as (select user_id g, event_id, event_type vendor, case when event_id % 3 = 0 then null else '1.' || (event_id % 5) end as version from events)
select g, count(*) blocks, array_to_string(list_sort(list(distinct vendor)), ' ') vendors, array_to_string(list_sort(list(distinct version) filter (version is not null)), ' ') versions, max(version) newest, arg_min(version, event_id) filter (version is not null) first_version from e group by g""")
def embedded_standards(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), "event_id", F.col("event_type").alias("vendor"), F.when(key % 3 != 0, F.concat(F.lit("1."), key % 5)).alias("version"))
    return evidence.standards(rows, "g", "event_id", "vendor", "version").withColumn("vendors", F.array_join("vendors", " ")).withColumn("versions", F.array_join("versions", " "))


@query("""with f as (select distinct s_nationkey image, s_suppkey fs from supplier), m as (select distinct s_nationkey image, s_suppkey fs from supplier where s_suppkey % 4 = 3), r as (select f.image, f.fs, m.fs is not null marked, row_number() over (partition by f.image order by (m.fs is null), f.fs) k from f left join m on m.image = f.image and m.fs = f.fs) select image, fs, marked from r where k = 1""")
def root_filesystems(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image"), F.col("s_suppkey").alias("fs"))
    path = F.when(F.col("fs") % 4 == 3, "/etc/passwd").otherwise("/readme")
    return evidence.root_filesystem(rows, rows.withColumn("path", path), "image", "fs", "path", ["/etc/passwd", "/sbin/init"])


@query("""with m as (select l_orderkey image, l_partkey % 7 cpuid, l_linenumber % 2 revision, l_suppkey * 1000000 + l_partkey place, l_quantity::bigint size from lineitem), r as (select *, row_number() over (partition by image, cpuid, revision order by place, size) k from m) select image, cpuid, revision, place, size from r where k = 1""")
def microcode_updates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 7).alias("cpuid"), (F.col("l_linenumber") % 2).alias("revision"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("place"), F.col("l_quantity").cast("bigint").alias("size"))
    return evidence.first_of(rows, ["image", "cpuid", "revision"], ["place", "size"])


@query("select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as number from documents")
def evidence_register(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return evidence.register(rows, "source", [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", "number")


@query("""select 'magic' kind, event_type as label, count(*) hits, count(*) filter (value > 50) confirmed from events group by event_type union all select 'signature', c_mktsegment, count(*), count(*) filter (c_acctbal > 0) from customer group by 2 union all select 'structure', o_orderstatus, count(*), count(*) from orders group by 2""")
def coverage_rows(spark, sf_dir):
    counted = lambda t, label, test: table(spark, sf_dir, t).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("hits"), F.count_if(test).alias("confirmed"))
    return evidence.coverage(counted("events", "event_type", F.col("value") > 50), counted("customer", "c_mktsegment", F.col("c_acctbal") > 0), counted("orders", "o_orderstatus", F.lit(True)))


@query("""with p as (select o_custkey g, o_orderkey probe, 8 + o_orderkey % 249 stride, round((o_orderkey % 13) / 13.0, 6) density from orders) select g, stride, density from (select *, row_number() over (partition by g order by density desc, stride, probe) k from p) where k = 1""")
def best_strides(spark, sf_dir):
    key = F.col("o_orderkey")
    return evidence.best_stride(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), key.alias("probe"), (key % 249 + 8).alias("stride"), ((key % 13) / 13.0).alias("density")), "g")


@query("select event_id from events where event_type = 'error' or (event_id % 3 = 0 and event_type <> 'view' and event_type <> 'click')")
def unreadable_segments(spark, sf_dir):
    """Errors are opaque, views filesystems, clicks blank; every third segment has no content."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", True).alias("opaque"), F.when(F.col("event_id") % 3 != 0, "content").alias("content"), F.when(kind == "view", "filesystem").otherwise("raw").alias("kind"), (kind == "click").alias("blank"))
    return evidence.unreadable(rows).select("event_id")
