"""Queries of packages, vendor documents, folds, layouts and framing over the driver's tables. The tables' rows
stand for artifacts: parts for packages, orders for segments, lineitems for files, events for records. The SQL
follows the blueprint's rules over the same rows, without the texts and documents that the operators parse."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import folds, framing, inventory, layout, magics
from ..sources import control, esp, vendor_documents, wrappers
from .registry import query, table


def joined_text(rows, group, order, text, between):
    """group, text: one text of each group's pieces in order."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: x["t"]), between).alias("text"))


def control_records(spark, sf_dir):
    """brand, p_partkey, name, text: a control record for each part; some removed, some without a name, some with a line that goes on."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("part-"), key)
    text = F.concat_ws(
        "\n", F.when(key % 11 != 0, F.concat(F.lit("Package: "), name)), F.concat(F.lit("Version: 0"), size), F.concat(F.lit("Version: 1."), size, F.lit("-2")),
        F.when(key % 5 == 0, "Status: deinstall ok config-files").when(key % 5 < 3, "Status: install ok installed"),
        F.concat(F.lit("Depends: part-"), key + 1, F.lit(" (>= 2),\n  part-"), key, F.lit(", part-"), key * 3, F.lit(" | none:any")),
        F.lit("CPE-ID: cpe:/a:v:p"), F.concat(F.lit("License: "), "p_type"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size").repartition(spark.sparkContext.defaultParallelism)  # short rows in few files make long texts
    return part.select(F.col("p_brand").alias("brand"), "p_partkey", name.alias("name"), text.alias("text"))


INSTALLED = "select p_brand id, 'part-' || p_partkey as name, '1.' || p_size || '-2' as version, null::varchar architecture, 'part-' || (p_partkey + 1) || ' (>= 2), part-' || p_partkey || ', part-' || (p_partkey * 3) || ' | none:any' depends, p_partkey, p_size, p_type from part where p_partkey % 11 <> 0 and p_partkey % 5 <> 0"


@query(f"select id, name, version, architecture, depends from ({INSTALLED})")
def package_blocks(spark, sf_dir):
    """One database of blocks for each brand, parsed again."""
    return control.packages(joined_text(control_records(spark, sf_dir), "brand", "p_partkey", "text", "\n \t\n"), "brand", "text")


@query("select p_brand id, p_name as name, '1.' || p_size as version, case when p_partkey % 2 = 0 then 'arm' end architecture from part where p_partkey % 7 <> 0")
def apk_blocks(spark, sf_dir):
    key = F.col("p_partkey")
    block = F.concat_ws("\n", F.when(key % 7 != 0, F.concat(F.lit("P:"), "p_name")), F.lit("V:0"), F.concat(F.lit("V:1."), "p_size"), F.when(key % 2 == 0, "A: arm"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_partkey", block.alias("block"))
    return control.apk_packages(joined_text(rows, "brand", "p_partkey", "block", "\n\n"), "brand", "text")


@query("with f as (select n_regionkey id, '/etc/' || n_name as path, case when n_nationkey % 3 > 0 then n_name end as name, case when n_nationkey % 2 = 0 then '1.' || n_nationkey end as version from nation) select id, path, name, version, name || ' text' description from (select *, row_number() over (partition by id order by path) k from f where name is not null) where k = 1")
def os_releases(spark, sf_dir):
    key = F.col("n_nationkey")
    text = F.concat_ws("\n", F.lit("# a comment"), F.when(key % 3 == 1, F.concat(F.lit("NAME='"), "n_name", F.lit("'"))).when(key % 3 == 2, F.concat(F.lit('NAME="other"\nDISTRIB_ID='), "n_name")), F.when(key % 2 == 0, F.concat(F.lit('VERSION_ID="1.'), key, F.lit('"'))), F.concat(F.lit("PRETTY_NAME='"), "n_name", F.lit(" text'")))
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("/etc/"), "n_name").alias("path"), text.alias("text"))
    return control.os_release(rows, "n_regionkey", "text", "path")


@query(f"select p.id, p.name, p.version, p_type license, 'cpe:2.3:a:v:p:1.' || p_size || ':*:*:*:*:*:*:*' cpe, 'part-' || (p_partkey + 1) || '|part-' || p_partkey || '|part-' || (p_partkey * 3) depends from ({INSTALLED}) p")
def package_controls(spark, sf_dir):
    """Packages with what their control records say; of two records the later path counts."""
    records = control_records(spark, sf_dir)
    found = control.packages(records, "brand", "text")
    files = records.withColumn("path", F.concat(F.lit("/info/b-"), "name", F.lit(".control")))
    old = records.select("brand", F.concat(F.lit("Package: "), "name", F.lit("\nLicense: old")).alias("text"), F.concat(F.lit("/info/a-"), "name", F.lit(".control")).alias("path"))
    texts = files.select("brand", "text", "path").unionByName(old).withColumn("id", F.struct("brand", "path"))
    parsed = control.blocks(texts, "id", "text").where("block = 0").select("id.brand", "id.path", "fields").withColumnRenamed("brand", "id")
    return control.controlled(found.drop("architecture", "depends"), parsed).select("id", "name", "version", "license", "cpe", F.array_join("depends", "|").alias("depends"))


@query(f"with p as ({INSTALLED}), e as (select id, name as src, unnest(['part-' || (p_partkey + 1), 'part-' || (p_partkey * 3)]) dst from p) select distinct e.id, src, dst from e join p on p.id = e.id and p.name = dst where src <> dst")
def declared_depends(spark, sf_dir):
    """Edges between packages of one database, to those that it holds."""
    p = control.packages(control_records(spark, sf_dir), "brand", "text")
    edges = p.select("id", F.col("name").alias("src"), F.explode(scalars.depends(F.col("depends"))).alias("dst"))
    known = p.select("id", F.col("name").alias("dst")).distinct()
    return edges.where("src <> dst").distinct().join(known, ["id", "dst"], "left_semi").select("id", "src", "dst")


@query("with l as (select o_orderpriority id, '/l/' || o_custkey || '.list' as path, o_custkey::varchar package, '/f/' || (o_orderkey % 997) file from orders) select id, file, arg_min(package, path) package from l group by id, file")
def package_owners(spark, sf_dir):
    """The files of package lists; the first list by path has a file."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("image"), F.concat(F.lit("/l/"), "o_custkey", F.lit(".list")).alias("path"), F.concat(F.lit("/f/"), F.col("o_orderkey") % 997).alias("file"))
    lists = rows.groupBy("image", "path").agg(F.array_join(F.concat(F.array(F.lit("no path")), F.collect_list("file")), "\r\n").alias("text"))
    return control.owners(lists, "image", "path", "text")


@query("""with f as (select p_brand image, p_partkey id, '/lib/lib' || p_size || '.so.' || (p_partkey % 3) path, 'lib' || p_size || '.so.' || (p_partkey % 3) file, 'lib' || p_size || '.so' as key from part),
n as (select p_brand image, p_partkey id, 'lib' || (p_size % 20) || '.so' || case p_partkey % 3 when 0 then '' when 1 then '.1' else '.9' end needed from part),
e as (select image, file, min(path) path from f group by all), k as (select image, key, min(path) path from f group by all)
select n.image, id, needed, coalesce(e.path, k.path) provider from n left join e on e.image = n.image and e.file = needed left join k on k.image = n.image and k.key = substr(needed, 1, instr(needed, '.so') + 2)""")
def library_links(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    files = part.select(F.col("p_brand").alias("image"), F.concat(F.lit("/lib/lib"), "p_size", F.lit(".so."), key % 3).alias("path"))
    ending = F.when(key % 3 == 0, "").when(key % 3 == 1, ".1").otherwise(".9")
    needed = part.select(F.col("p_brand").alias("image"), key.alias("id"), F.concat(F.lit("lib"), F.col("p_size") % 20, F.lit(".so"), ending).alias("needed"))
    return inventory.linked(needed, files, "image", "needed", "path").select("image", "id", "needed", "provider")


VENDOR = """(select p_brand doc, p_partkey, case when p_partkey % 9 = 0 then null else 'v' || p_name end as name, case when p_partkey % 4 = 0 then null else '1.' || p_size end as version,
 case when p_partkey % 3 = 0 then null else 'pkg:x/' || p_partkey || '@1' end purl, p_partkey % 2 = 0 spdx from part)"""


def vendor_texts(spark, sf_dir):
    """doc, form, text: for each brand a CycloneDX document of its odd parts and an SPDX one of its even parts."""
    key = F.col("p_partkey")
    name = F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit("v"), "p_name", F.lit(" ")))
    version = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("1."), "p_size"))
    purl = F.when(key % 3 != 0, F.concat(F.lit("pkg:x/"), key, F.lit("@1")))
    part = table(spark, sf_dir, "part")
    cdx = F.struct(key.alias("_k"), name.alias("name"), version.alias("version"), purl.alias("purl"), F.array(F.struct(F.struct(F.col("p_type").alias("id")).alias("license"))).alias("licenses"))
    refs = F.array(F.struct(F.lit("PURL").alias("referenceType"), purl.alias("referenceLocator")))
    spdx = F.struct(key.alias("_k"), name.alias("name"), version.alias("versionInfo"), F.col("p_type").alias("licenseConcluded"), F.lit("noassertion").alias("licenseDeclared"), refs.alias("externalRefs"))
    a = part.where(key % 2 == 1).groupBy("p_brand").agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.array_sort(F.collect_list(cdx)).alias("components"))).alias("text"))
    b = part.where(key % 2 == 0).groupBy("p_brand").agg(F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.array_sort(F.collect_list(spdx)).alias("packages"))).alias("text"))
    bad = part.select("p_brand").distinct().select("p_brand", F.lit("[1, 2]").alias("text"))
    return a.unionByName(b).unionByName(bad)


@query(f"select doc id, case when spdx then 'spdx' else 'cyclonedx' end form, name, version, purl, p_type licenses from {VENDOR} v join part using (p_partkey) where name is not null")
def vendor_components(spark, sf_dir):
    return vendor_documents.components(vendor_texts(spark, sf_dir), "p_brand", "text").select("id", "form", "name", "version", "purl", F.array_join("licenses", "|").alias("licenses"))


@query("select distinct p_brand id, 'not JSON' as error from part")
def vendor_problems(spark, sf_dir):
    return vendor_documents.problems(vendor_texts(spark, sf_dir), "p_brand", "text")


@query(f"""with v as (select * from {VENDOR} where name is not null), ours as (select p_partkey * 2 id, 'v' || p_name as name, 'pkg:X/' || (p_partkey * 2) purl, '1.' || p_size as version from part),
k as (select doc, p_partkey, v.version vv, 0 place, 'pkg:x/' || p_partkey as key from v where purl is not null union all select doc, p_partkey, version, 1, lower(name) from v),
o as (select key, min(id) id, arg_min(version, id) as version from (select lower(purl) as key, id, version from ours union all select lower(name), id, version from ours) group by key),
m as (select *, row_number() over (partition by p_partkey order by place) r from k join o using (key)),
j as (select v.doc, case when m.p_partkey is null then 'vendor_only' when vv is null or vv = m.version then 'agree' else 'conflict' end s from v left join (select * from m where r = 1) m using (p_partkey))
select doc, count(*) filter (s = 'agree') agreements, count(*) filter (s = 'conflict') conflicts, count(*) filter (s = 'vendor_only') vendor_only from j group by doc""")
def vendor_findings(spark, sf_dir):
    """Vendor documents against what was observed, by package URL and then name; counts by document."""
    part = table(spark, sf_dir, "part")
    ours = part.select((F.col("p_partkey") * 2).alias("observed_id"), F.concat(F.lit("v"), "p_name").alias("name"), F.concat(F.lit("pkg:X/"), F.col("p_partkey") * 2).alias("purl"), F.concat(F.lit("1."), "p_size").alias("version"))
    theirs = vendor_documents.components(vendor_texts(spark, sf_dir), "p_brand", "text").withColumn("declared_id", F.struct("id", "form", "seq"))
    keys = lambda df: df.withColumn("k", scalars.component_keys(F.col("name"), F.col("purl"))).withColumn("k0", F.get("k", F.lit(0))).withColumn("k1", F.get("k", F.lit(1)))
    d = inventory.reconcile(keys(ours), keys(theirs), ["k0", "k1"], "struct<id:string,form:string,seq:int>").where("declared_id is not null")
    n = lambda s: F.count_if(F.col("status") == s)
    return d.groupBy(F.col("declared_id.id").alias("doc")).agg(n("agree").alias("agreements"), n("conflict").alias("conflicts"), n("declared_only").alias("vendor_only"))


SEGMENTS = "(select o_custkey image, o_orderkey seq, 'segment ' || o_orderkey label, o_orderpriority as name, round(o_totalprice / 1000000, 1) confidence, case when o_orderkey % 3 = 0 then '1.' || (o_orderkey % 7) end as version from orders)"


def segments(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), key.alias("seq"), F.concat(F.lit("segment "), key).alias("label"), F.col("o_orderpriority").alias("name"), F.round(F.col("o_totalprice") / 1000000, 1).alias("confidence"), F.when(key % 3 == 0, F.concat(F.lit("1."), key % 7)).alias("version"))


@query(f"select image, name, max(confidence) confidence, arg_min(version, seq) filter (version is not null) as version, string_agg(label, '|' order by seq) segments from {SEGMENTS} group by image, name")
def merge_segments(spark, sf_dir):
    return folds.merge_segments(segments(spark, sf_dir), "image", "seq", "label").withColumn("segments", F.array_join("segments", "|"))


@query(f"""with s as (select image, name, max(confidence) c, arg_min(version, seq) filter (version is not null) v, list(label) f from {SEGMENTS} where seq % 2 = 0 group by all), t as (select image, name, max(confidence) c, arg_min(version, seq) filter (version is not null) v, list(label) f from {SEGMENTS} where seq % 2 = 1 group by all)
select image, name, greatest(s.c, t.c) confidence, coalesce(s.v, t.v) as version, array_to_string(list_sort(list_distinct(list_concat(coalesce(s.f, []), coalesce(t.f, [])))), '|') files from s full join t using (image, name)""")
def merge_hit_lists(spark, sf_dir):
    one = lambda odd: folds.merge_segments(segments(spark, sf_dir).where(F.col("seq") % 2 == odd), "image", "seq", "label").withColumnRenamed("segments", "files")
    return folds.merge_lists(one(0), one(1), ["image", "name"]).withColumn("files", F.array_join("files", "|"))


@query(f"""with recursive h as (select *, row_number() over (partition by image, name order by label) k from {SEGMENTS}), r as (select image, name, k, confidence c, version v from h where k = 1
union all select h.image, h.name, h.k, case when h.confidence > c or (h.version is not null and v is null) then h.confidence else c end, case when h.confidence > c or (h.version is not null and v is null) then h.version else v end from r join h on h.image = r.image and h.name = r.name and h.k = r.k + 1)
select image, name, c confidence, v as version, files from (select *, row_number() over (partition by image, name order by k desc) z from r) join (select image, name, string_agg(label, '|' order by label) files from {SEGMENTS} group by all) using (image, name) where z = 1""")
def fold_files(spark, sf_dir):
    return folds.fold_files(segments(spark, sf_dir), "image", "label").withColumn("files", F.array_join("files", "|"))


@query("select s_nationkey fs, count(*) n_files, sum(s_suppkey)::bigint n_bytes, array_to_string(list_sort(list(s_name))[1:3], ', ') || case when count(*) > 3 then ' and ' || (count(*) - 3) || ' more' else '' end reason from supplier group by s_nationkey")
def unread_files(spark, sf_dir):
    return folds.unread(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "fs"), "fs", "s_name", "s_suppkey")


@query("""with c as (select user_id g, floor(epoch(ts))::bigint s, floor(epoch(ts))::bigint + 1800 e from events where event_type = 'view'), x as (select user_id g, event_id, floor(epoch(ts))::bigint a from events where event_type <> 'view')
select g, event_id from x where not exists (select 1 from c where c.g = x.g and x.a >= c.s and x.a < c.e)""")
def claims_anti(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp("ts")).withColumnRenamed("user_id", "g")
    claims = events.where("event_type = 'view'").select("g", F.col("at").alias("s"), (F.col("at") + 1800).alias("e"))
    return layout.unclaimed(events.where("event_type <> 'view'").select("g", "event_id", "at"), claims, "g", "at", "s", "e").select("g", "event_id")


@query("""with p as (select user_id g, floor(epoch(ts))::bigint s, floor(epoch(ts))::bigint + 7200 e from events), l as (select g, s, lag(e) over (partition by g order by s, e) b from p) select g, count(*) filter (b > s) as "overlaps" from l group by g""")
def partition_overlaps(spark, sf_dir):
    s = F.unix_timestamp("ts")
    return layout.overlapping(table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), s.alias("s"), (s + 7200).alias("e")), "g", "s", "e")


@query("""with p as (select distinct o_custkey g, o_orderkey % 360 p from orders), n as (select g, p, coalesce(lead(p) over (partition by g order by p), min(p) over (partition by g)) q, count(*) over (partition by g) m from p), r as (select *, row_number() over (partition by g order by (q - p + 360) % 360 desc, p) k from n)
select g, q as start, case when m = 1 then 1 else (p - q + 360) % 360 + 1 end width from r where k = 1""")
def cyclic_windows(spark, sf_dir):
    return layout.cyclic_window(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 360).alias("p")), "g", "p", 360)


@query("with f as (select l_suppkey fs, l_orderkey * 8 + l_linenumber as path, sum(l_quantity)::bigint size from lineitem group by all), r as (select *, row_number() over w k, coalesce(sum(size) over (partition by fs order by path rows between unbounded preceding and 1 preceding), 0) before from f window w as (partition by fs order by path)) select fs, path, size from r where k <= 60 and before < 1000")
def capped_files(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fs"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"), F.col("l_quantity").cast("bigint").alias("size"))
    rows = rows.groupBy("fs", "path").agg(F.sum("size").alias("size"))
    return layout.capped(rows, "fs", "path", "size", 60, 1000)


@query("select event_id, case when k = 1 then event_type else event_type || ' (' || k || ')' end as unique from (select *, row_number() over (partition by user_id, event_type order by event_id) k from events)")
def unique_names(spark, sf_dir):
    return layout.unique_names(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("event_id", "unique")


@query("with f as (select 'sub' || (p_partkey % 3) || '/' || p_name || '.' || p_size as path, p_name stem from part) select path, case when count(*) over (partition by stem) = 1 then stem else replace(path, '/', '__') end stem from f")
def output_stems(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("sub"), F.col("p_partkey") % 3, F.lit("/"), "p_name", F.lit("."), "p_size").alias("path"))
    return layout.batch_stems(files, "path")


CELLS = "(select user_id g, event_id rec, c.col, c.value from (select *, row_number() over (partition by user_id order by event_id) i from events) e, lateral (select unnest([0, 1, 2, 3]) col, unnest([165, i % 256, i // 4 % 256, event_id * 7919 % 256]) as value) c)"


def cells(spark, sf_dir):
    """g, rec, then the columns sync, counter, page, data of records."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("rec"), F.lit(165).alias("sync"), (i % 256).alias("counter"), (F.floor(i / 4) % 256).cast("int").alias("page"), (F.col("event_id") * 7919 % 256).cast("int").alias("data"))


@query(f"""with s as (select *, (value - lag(value) over (partition by g, col order by rec) + 256) % 256 d from {CELLS}), a as (select g, col, count(d) n, count(*) filter (d = 1) o, count(*) filter (d = 0) z, min(value) lo, max(value) hi from s group by all)
select g, col, case when lo = hi then 'constant' when o >= 0.8 * n then 'counter' when o >= 2 and o + z >= 0.95 * n then 'slow' else 'payload' end as role, case when lo = hi then lo end as constant from a""")
def column_roles(spark, sf_dir):
    wide = cells(spark, sf_dir)
    rows = wide.select("g", "rec", F.posexplode(F.array("sync", "counter", "page", "data")).alias("col", "value"))
    return framing.column_roles(rows, ["g", "col"], "rec", "value")


@query("select user_id g, count(*) records, true framed from events group by user_id")
def framing_verified(spark, sf_dir):
    return framing.verified(cells(spark, sf_dir), "g", "rec", "sync", 165, "counter")


@query("select c_nationkey g, ['sum8', 'neg-sum8', 'xor8', 'crc8-0x07', 'crc8-0x31', 'crc8-0x1d', null][c_nationkey % 7 + 1] as algorithm from customer group by c_nationkey")
def checksum_columns(spark, sf_dir):
    """Records whose check byte each nation makes by another algorithm, one nation in seven by none."""
    payload, k = scalars.byte_values(F.encode("c_name", "UTF-8")), F.col("c_nationkey") % 7
    check = F.lit(None).cast("int")
    for n, name in enumerate(framing.ALGORITHMS):
        check = F.when(k == n, framing.checksum(payload, name)).otherwise(check)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), payload.alias("payload"), F.coalesce(check, F.pmod(F.col("c_custkey") * 31, F.lit(256)).cast("int")).alias("check"))
    return framing.checksum_algorithm(rows, "g", "payload", "check")


@query("""with p as (select p_partkey id, p_partkey % 4 k, 'x' || p_name n from part) select id, m.label, m.raw_hits, m.validated_hits, m.offsets from p, lateral (select * from (values
 ('ELF', 2, case when k = 0 then 1 else 0 end, case when k = 0 then length(n)::varchar else (length(n))::varchar || '|' || (2 * length(n) + 6)::varchar end), ('GZIP', 1, 0, (2 * length(n) + 12)::varchar), ('UBI erase counter', 1, 1, (2 * length(n) + 14)::varchar)) v(label, raw_hits, validated_hits, offsets)) m""")
def magic_scan(spark, sf_dir):
    """Payloads made of a part's name and magics; one in four has a confirmed ELF header."""
    n = F.encode(F.concat(F.lit("x"), "p_name"), "UTF-8")
    first = F.when(F.col("p_partkey") % 4 == 0, F.lit(b"\x7fELF\x01\x01")).otherwise(F.lit(b"\x7fELF\x07\x01"))
    data = F.concat(n, first, n, F.lit(b"\x7fELF\x03\x01"), F.lit(b"\x1f\x8b"), F.lit(b"UBI#"))
    rows = table(spark, sf_dir, "part").select("p_partkey", data.alias("data"))
    return magics.scan(rows, "p_partkey", "data").withColumn("offsets", F.array_join("offsets", "|"))


@query("select s_suppkey, case s_suppkey % 4 when 0 then 'gzip' when 1 then 'xz' when 2 then 'zip' end compression from supplier")
def payload_compression(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    head = F.when(k == 0, F.lit(b"\x1f\x8b\x08")).when(k == 1, F.lit(b"\xfd7zXZ\x00")).when(k == 2, F.lit(b"PK\x03\x04")).otherwise(F.lit(b"PK\x05"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", magics.compression(F.concat(head, F.encode("s_name", "UTF-8"))).alias("compression"))


@query("select event_id, case when event_type = 'error' and n > 0 then 'mixed' when event_type = 'error' then 'opaque' else 'plaintext' end verdict from (select *, event_id % 3 n from events)")
def settled_verdicts(spark, sf_dir):
    opaque = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", folds.settled(F.when(opaque, "opaque").otherwise("plaintext"), opaque, F.col("event_id") % 3).alias("verdict"))


@query("""with r as (select s_nationkey path, s_suppkey k, row_number() over (partition by s_nationkey order by s_suppkey) i from supplier)
select path, (i - 1)::int as entry, case when k % 11 = 0 then 'partition-' || (i - 1) else 'p' || k end as name, case k % 3 when 0 then 'app' when 1 then 'data' else '0x02' end as type,
case when k % 3 = 0 and k % 256 between 16 and 31 then 'ota_' || (k % 256 - 16) when k % 3 = 0 and k % 256 = 0 then 'factory'
when k % 3 = 1 and k % 256 = 1 then 'phy' when k % 3 = 1 and k % 256 = 4 then 'nvs_keys' when k % 3 = 1 and k % 256 = 130 then 'spiffs'
when k % 3 = 1 and k % 256 between 0 and 6 then ['ota','phy','nvs','coredump','nvs_keys','efuse','undefined'][(k % 256 + 1)::int] when k % 3 = 1 and k % 256 between 128 and 131 then ['esphttpd','fat','spiffs','littlefs'][(k % 256 - 127)::int]
when k % 3 = 0 and k % 256 = 32 then 'test' else '0x' || lower(lpad(to_hex((k % 256)::bigint), 2, '0')) end as subtype, k::bigint * 4096 as address, 4096::bigint as size from r where i <= 95""")
def esp_partitions(spark, sf_dir):
    """Suppliers of a nation as the entries of one flash's partition table; a table ends after 95."""
    key = F.col("s_suppkey").cast("bigint")
    little = lambda n: F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 8, "0"), F.lit("(..)")))
    name = F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("p"), key.cast("string")))
    digits = F.concat(F.lit("AA50"), F.lpad(F.hex(key % 3), 2, "0"), F.lpad(F.hex(key % 256), 2, "0"), F.array_join(little(key * 4096), ""), F.lit("00100000"), F.rpad(F.hex(name.cast("binary")), 40, "0"))
    flash = F.expr("array_join(transform(array_sort(collect_list(struct(k, e))), x -> x.e), '')")
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = table(spark, sf_dir, "supplier").withColumn("_rank", rank).where(F.col("_rank") <= esp.MAX_ENTRIES + 1)  # one more than a table holds, so that its end is met
    files = rows.select(F.col("s_nationkey").alias("path"), key.alias("k"), digits.alias("e")).groupBy("path").agg(F.unhex(flash).alias("content"))
    return esp.partitions(files, 0).select("path", F.col("index").alias("entry"), "name", "type", "subtype", "address", "size")


@query("""with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint n from documents)
select doc_id, 0 as level, 'chk' as format, 40::bigint as header_length, 40::bigint as "offset", 16 + n as length from d where doc_id % 2 = 0
union all select doc_id, (1 - doc_id % 2)::int, 'frm', 16, case when doc_id % 2 = 0 then 56 else 16 end, n from d where doc_id % 3 <> 0""")
def nested_headers(spark, sf_dir):
    """Each text as the payload of an FRM header, for even ids inside a CHK header; every third FRM header states a wrong length and is none."""
    key, text = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    stated = F.octet_length(text) + 16 + F.when(key % 3 == 0, 1).otherwise(0)
    little = F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(stated), 8, "0"), F.lit("(..)"))), "")
    frm = F.concat(F.lit(wrappers.FRM), F.unhex(F.concat(F.lit("00000001"), little, F.lit("00000000"))), text)
    chk = F.concat(F.lit(wrappers.CHK), F.unhex(F.rpad(F.lit("00000028"), 72, "0")))
    files = table(spark, sf_dir, "documents").select(key.alias("path"), F.when(key % 2 == 0, F.concat(chk, frm)).otherwise(frm).alias("content"))
    part = F.get("parts", F.lit(0))
    return wrappers.chain(files).select(F.col("path").alias("doc_id"), "level", "format", "header_length", part["offset"].alias("offset"), part["length"].alias("length"))
