"""Queries of scalar functions, each over every row of a table; the SQL follows the blueprint's rules, not the code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from .registry import query, table

#: name and package URL of a part: blank names, scoped names, package URLs with and without version.
PURLS = """(select p_partkey, case when p_size % 10 = 0 then '  ' else ' ' || p_name || ' ' end as name,
  case p_partkey % 4 when 0 then null when 1 then 'pkg:npm/@' || replace(lower(p_brand), ' ', '-') || '/core@1.' || p_size when 2 then 'pkg:deb/' || p_name || '@2?arch=arm' else 'pkg:Generic/' || p_type || '@' || p_size end purl from part)"""


def purls(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    purl = (
        F.when(key % 4 == 1, F.concat(F.lit("pkg:npm/@"), F.replace(F.lower("p_brand"), F.lit(" "), F.lit("-")), F.lit("/core@1."), size))
        .when(key % 4 == 2, F.concat(F.lit("pkg:deb/"), "p_name", F.lit("@2?arch=arm")))
        .when(key % 4 == 3, F.concat(F.lit("pkg:Generic/"), "p_type", F.lit("@"), size))
    )
    name = F.when(size % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), purl.alias("purl"))


@query(f"select p_partkey, nullif(trim(name), '') as name, regexp_replace(purl, '@[^@/?#]+$', '') base, coalesce(lower(regexp_replace(purl, '@[^@/?#]+$', '')), lower(trim(name))) as key, concat_ws('|', lower(regexp_replace(purl, '@[^@/?#]+$', '')), nullif(lower(trim(name)), '')) as keys from {PURLS}")
def purl_keys(spark, sf_dir):
    name, purl = F.col("name"), F.col("purl")
    return purls(spark, sf_dir).select("p_partkey", scalars.text(name).alias("name"), scalars.purl_base(purl).alias("base"), scalars.component_key(name, purl).alias("key"), F.array_join(scalars.component_keys(name, purl), "|").alias("keys"))


@query("""with s as (select p_partkey, case p_partkey % 3 when 0 then '/usr/lib/lib' || lower(p_brand) || '.so.' || p_size || '.1' when 1 then 'lib' || p_size || '.so' else '/bin/' || lower(p_brand) end as name from part)
select p_partkey, case when contains(f, '.so') then substr(f, 1, instr(f, '.so') + 2) else f end soname from (select p_partkey, string_split(name, '/')[-1] f from s)""")
def soname_keys(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("/usr/lib/lib"), F.lower("p_brand"), F.lit(".so."), "p_size", F.lit(".1"))).when(key % 3 == 1, F.concat(F.lit("lib"), "p_size", F.lit(".so"))).otherwise(F.concat(F.lit("/bin/"), F.lower("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.soname_key(name).alias("soname"))


@query("""select o_orderkey, case when o_orderkey % 5 < 3 and year(o_orderdate) between 1990 and 2099 then strftime(o_orderdate, '%Y-%m-%d') end as date from orders""")
def bcd_dates(spark, sf_dir):
    """Every fifth date has a month 13, every fifth a hexadecimal digit: those are none."""
    key = F.col("o_orderkey")
    digits = F.when(key % 5 == 3, F.date_format("o_orderdate", "'13'ddyyyy")).when(key % 5 == 4, F.date_format("o_orderdate", "MMdd'A'yyy")).otherwise(F.date_format("o_orderdate", "MMddyyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.bcd_date(F.conv(digits, 16, 10).cast("bigint")).alias("date"))


@query("""with s as (select p_partkey, p_partkey * 7919 % 268435456 v from part), b as (select p_partkey, (v >> 8) & 15 f, (v >> 4) & 15 m, v & 15 s, (v >> 16) & 15 em, (v >> 20) & 255 ef from s)
select p_partkey, printf('%02x-%02x-%02x', case when f = 15 then f + ef else f end, case when f in (6, 15) then m + em * 16 else m end, s) as name from b""")
def cpuid_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.cpuid_name(F.col("p_partkey") * 7919 % (1 << 28)).alias("name"))


@query("""with h as (select p_partkey, md5(p_name) h from part) select p_partkey, upper(substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2)||'-'||substr(h,11,2)||substr(h,9,2)||'-'||substr(h,15,2)||substr(h,13,2)||'-'||substr(h,17,4)||'-'||substr(h,21,12)) guid,
array_to_string(regexp_extract_all(h, '..'), ' ') guid_key from h""")
def guid_texts(spark, sf_dir):
    data = F.unhex(F.md5("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.guid(data).alias("guid"), scalars.guid_key(data).alias("guid_key"))


@query("""select event_id, printf('0x%08X', event_id * 4096) as "offset", case when event_id < 26 then chr((65 + event_id)::int) when event_id < 702 then chr((65 + (event_id - 26) // 26)::int) || chr((65 + (event_id - 26) % 26)::int)
when event_id < 18278 then chr((65 + (event_id - 702) // 676)::int) || chr((65 + (event_id - 702) // 26 % 26)::int) || chr((65 + (event_id - 702) % 26)::int)
else chr((65 + (event_id - 18278) // 17576)::int) || chr((65 + (event_id - 18278) // 676 % 26)::int) || chr((65 + (event_id - 18278) // 26 % 26)::int) || chr((65 + (event_id - 18278) % 26)::int) end as "column" from events""")
def cell_names(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.hex_offset(n * 4096).alias("offset"), scalars.column_name(n).alias("column"))


@query("""select page_id, replace(replace(replace(replace(regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') escaped from pages""")
def xml_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.xml_escaped(F.col("html")).alias("escaped"))


@query("""select s_suppkey, 'SPDXRef-' || regexp_replace(regexp_replace('Package-' || s_suppkey || '-' || s_name || ' (x)', '[^A-Za-z0-9.-]+', '-', 'g'), '-+$', '') spdx_id,
case when s_suppkey % 7 = 0 then 'NOASSERTION' else 'Organization: ' || s_name end supplier from supplier""")
def spdx_names(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.spdx_id(F.lit("Package"), F.col("s_suppkey"), F.lit(""), F.concat("s_name", F.lit(" (x)"))).alias("spdx_id"), scalars.supplier(name).alias("supplier"))


@query("""select p_partkey, case when p_partkey % 6 = 5 then null else 'cpe:2.3:a:' || case when p_partkey % 6 = 0 then '*' else lower(p_brand) end || ':part' || p_size || ':' ||
case p_partkey % 6 when 1 then '9.9' when 2 then '*' when 3 then '1.' || p_size || '-rc' else '1.' || p_size end || ':*:*:*:*:*:*:*' end cpe from part""")
def cpe_names(spark, sf_dir):
    k = F.col("p_partkey") % 6
    vendor = F.when(k == 0, "").otherwise(F.lower("p_brand"))
    declared = F.when(k == 5, F.lit("cpe:2.3:a:b")).otherwise(F.concat(F.lit("cpe:/a:"), vendor, F.lit(":part"), "p_size", F.when(k == 1, ":9.9").otherwise("")))
    version = F.when(k == 3, F.concat(F.lit("1."), "p_size", F.lit("-rc-2"))).when(k != 2, F.concat(F.lit("1."), "p_size", F.lit("-2")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.cpe23(declared, version).alias("cpe"))



@query("""select doc_id, regexp_extract(text, '\\bv?([0-9]+\\.[0-9]+(?:\\.[0-9]+)+(?:-[A-Za-z0-9]+)?)\\b', 1) as token from documents where regexp_matches(text, '\\bv?([0-9]+\\.[0-9]+(?:\\.[0-9]+)+(?:-[A-Za-z0-9]+)?)\\b')""")
def version_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.version_token(F.col("text")).alias("token")).where("token is not null")


@query("""select r_type module, case when r_type in ('driver', 'peim', 'smm', 'combined-peim-driver', 'combined-smm-dxe', 'mm-standalone') then 'device-driver' when r_type = 'application' then 'application' when r_type = 'firmware-volume-image' then 'container' when r_type in ('raw', 'freeform') then 'data' else 'firmware' end as type, count(*) n
from (select ['driver', 'peim', 'smm', 'application', 'firmware-volume-image', 'raw', 'freeform', 'dxe-core'][p_partkey % 8 + 1] r_type from part) group by all""")
def module_types(spark, sf_dir):
    names = F.array(*map(F.lit, ("driver", "peim", "smm", "application", "firmware-volume-image", "raw", "freeform", "dxe-core")))
    rows = table(spark, sf_dir, "part").select(F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("module"))
    return rows.groupBy("module", scalars.uefi_component_type(F.col("module")).alias("type")).agg(F.count("*").alias("n"))


@query("""with b as (select s_suppkey, list_transform(regexp_extract_all(hex(encode(s_name)), '..'), lambda x: ('0x' || x)::int) v from supplier) select s_suppkey, list_reduce(list_prepend(0, v), lambda a, x: xor(a, x)) xor8, list_sum(v)::int % 256 sum8 from b""")
def byte_checksums(spark, sf_dir):
    v = scalars.byte_values(F.encode("s_name", "UTF-8"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.xor8(v).alias("xor8"), scalars.sum8(v).alias("sum8"))
