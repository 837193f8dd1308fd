"""Package databases, control files, file lists and os-release files, in the JVM.

A database is text of one row; its blocks stand between lines that are blank. Texts are split where
they are read and nothing is shuffled until packages are joined to what else is known of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cpe23, depends

#: Keys of a distribution's name and version, the best first.
OS_NAME, OS_VERSION, OS_TEXT = ("DISTRIB_ID", "NAME"), ("DISTRIB_RELEASE", "VERSION_ID", "VERSION"), ("DISTRIB_DESCRIPTION", "PRETTY_NAME")
#: A line of a text of many that is a field. A line ends at a line feed; a value with another line end inside is none.
FIELD = "(?<![^\\n])([A-Za-z][A-Za-z0-9-]*):.*(?=[\\r\\x{85}\\x{2028}\\x{2029}]?(?:\\n|\\z))"


def chunks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, text: the stretches between blank lines."""
    plain = F.regexp_replace(F.col(text_col), "\r\n?", "\n")
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(plain, "\n\\s*\n")).alias("block", "text"))


def once(value: Column) -> Column:
    """The value as a generator's one row. Filters and later expressions then read it and do not compute it again."""
    return F.explode(F.array(value))


def last_wins(keys: Column, values: Column) -> Column:
    """A map of keys and their values; of a key given twice the last value counts. Both are computed once, as a lambda's variable."""

    def of(x: Column) -> Column:
        names, back = F.array_distinct(x["keys"]), F.reverse(x["keys"])
        return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(x["values"], (-F.array_position(back, k)).cast("int"))))

    return F.get(F.transform(F.array(F.struct(keys.alias("keys"), values.alias("values"))), of), F.lit(0))


def blocks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, fields: one row per block with a field. A line that begins with a blank goes on with the field before."""
    joined = F.regexp_replace("text", "\n[ \t]+", " ")
    lines = chunks(texts, id_col, text_col).select("id", F.col("block").cast("bigint").alias("block"), once(F.regexp_extract_all(joined, F.lit(FIELD), F.lit(0))).alias("lines"))
    key = lambda x: F.substring_index(x, ":", 1)
    value = lambda x: F.trim(F.ltrim(F.substring(x, F.length(key(x)) + 2, F.length(x)), F.lit(" \t")))
    return lines.where(F.size("lines") > 0).select("id", "block", once(last_wins(F.transform("lines", key), F.transform("lines", value))).alias("fields"))


def installed(fields: Column) -> Column:
    """Has the block a package name, and a status of installed or none?"""
    status = F.coalesce(F.element_at(fields, "Status"), F.lit(""))
    return (F.coalesce(F.element_at(fields, "Package"), F.lit("")) != "") & ((status == "") | status.contains("installed"))


def packages(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, version, architecture, depends: of the installed packages."""
    f = F.col("fields")
    one = lambda k: F.nullif(F.element_at(f, k), F.lit(""))
    return blocks(texts, id_col, text_col).where(installed(f)).select("id", F.element_at(f, "Package").alias("name"), one("Version").alias("version"), one("Architecture").alias("architecture"), one("Depends").alias("depends"))


def apk_packages(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, version, architecture from blocks with single-letter keys P, V and A."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("^[A-Za-z]:"))
    pairs = F.transform(lines, lambda x: F.substring(x, 1, 1)), F.transform(lines, lambda x: F.trim(F.substring(x, 3, 1 << 20)))
    rows = chunks(texts, id_col, text_col).select("id", once(last_wins(*pairs)).alias("f"))
    one = lambda k: F.nullif(F.element_at("f", k), F.lit(""))
    return rows.select("id", one("P").alias("name"), one("V").alias("version"), one("A").alias("architecture")).where("name is not null")


def os_release(texts: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """id, path, name, version, description: of each id's files, by path, the first that names a distribution."""
    line = "(?m)^([A-Z_]+)=['\"]?([^'\"\\n]*)['\"]?$"
    t = F.col(text_col)
    pairs = F.regexp_extract_all(t, F.lit(line), F.lit(1)), F.regexp_extract_all(t, F.lit(line), F.lit(2))
    rows = texts.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), once(last_wins(*pairs)).alias("f"))
    best = lambda keys: F.coalesce(*(F.nullif(F.element_at("f", k), F.lit("")) for k in keys))
    named = rows.select("id", "path", best(OS_NAME).alias("name"), best(OS_VERSION).alias("version"), best(OS_TEXT).alias("text")).where("name is not null")
    first = named.groupBy("id").agg(F.min(F.struct("path", "name", "version", F.coalesce("text", "name").alias("description"))).alias("m"))
    return first.select("id", "m.*")


def owners(lists: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """id, file, package: file lists (…/<package>.list or …/<package>:<architecture>.list) as rows; of two
    lists that claim a file the first by path has it."""
    package = F.split_part(F.regexp_replace(F.substring_index(path_col, "/", -1), "\\.list$", ""), F.lit(":"), F.lit(1))
    rows = lists.where(F.col(path_col).endswith(".list")).select(F.col(id_col).alias("id"), F.col(path_col).alias("_path"), package.alias("package"), F.explode(F.split(text_col, "\r?\n")).alias("file"))
    rows = rows.withColumn("file", F.trim("file")).where(F.col("file").startswith("/"))
    return rows.groupBy("id", "file").agg(F.min(F.struct("_path", "package")).alias("m")).select("id", "file", F.col("m.package").alias("package"))


def controlled(found: DataFrame, controls: DataFrame) -> DataFrame:
    """The packages (id, name, version, …) with license, cpe, source and depends of their control records
    (id, path, fields); of a package's records the last by path counts. Packages without one stay."""
    f = F.col("fields")
    one = lambda k: F.nullif(F.element_at(f, k), F.lit(""))
    last = controls.withColumn("name", F.coalesce(one("Package"), F.regexp_replace(F.substring_index("path", "/", -1), "\\.control$", ""))).groupBy("id", "name").agg(F.max_by("fields", "path").alias("fields"))
    rows = found.join(last, ["id", "name"], "left")
    return rows.select(*found.columns, one("License").alias("license"), cpe23(one("CPE-ID"), F.col("version")).alias("cpe"), F.coalesce(one("SourceName"), one("Source")).alias("source"), F.when(f.isNotNull(), depends(one("Depends"))).alias("depends"))
