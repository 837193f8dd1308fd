"""Signature packs as data: JSON files read into rows, checked row by row, merged by directory.

A pack is {"pack": …, "signatures": [{name, supplier, type, purl, description, version_note, patterns:
[{regex, weight, vgroup}]}]}. Directories stand in order of priority, the lowest first. A signature of a
later directory takes the place of an earlier one of its name; a name twice in one directory, a row that
breaks a rule, and no signature at all are errors.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

PATTERN = "struct<regex:string,weight:double,vgroup:bigint>"
SIGNATURE = f"struct<name:string,supplier:string,type:string,purl:string,description:string,version_note:string,patterns:array<{PATTERN}>>"
SCHEMA = f"pack string, signatures array<{SIGNATURE}>"
FIELDS = ("name", "supplier", "type", "purl", "description", "version_note", "patterns")
#: The component types of CycloneDX.
TYPES = ("application", "library", "framework", "operating-system", "device", "firmware", "file", "container", "data", "device-driver", "platform", "machine-learning-model")


class PackError(ValueError):
    """Packs that cannot be used."""


def search_path(built_in: str, variable: str | None = None, extra: list[str] | None = None) -> list[str]:
    """Directories of packs, lowest priority first: the built-in one, those of an environment variable, the caller's."""
    named = os.environ.get(variable, "").split(os.pathsep) if variable else []
    return [built_in, *(d for d in named if d.strip()), *(extra or [])]


def read(spark: SparkSession, directories: list[str]) -> DataFrame:
    """pack, file, priority, seq and the signature's fields: one row per signature; a pack without a name has its file's."""
    rows = None
    for priority, directory in enumerate(directories):
        if not os.path.isdir(directory) or not any(f.endswith(".json") for f in os.listdir(directory)):
            continue
        found = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(directory)
        file = F.substring_index(F.input_file_name(), "/", -1)
        part = found.select(F.coalesce("pack", F.regexp_replace(file, "\\.json$", "")).alias("pack"), file.alias("file"), F.lit(priority).alias("priority"), F.posexplode("signatures").alias("seq", "s"))
        part = part.select("pack", "file", "priority", "seq", *(F.col(f"s.{f}").alias(f) for f in FIELDS))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise PackError("no signature packs found in " + os.pathsep.join(directories))
    return rows


@F.pandas_udf(IntegerType())
def groups_of(regex: pd.Series) -> pd.Series:
    """Capture groups of a regular expression; -1 if it does not compile."""

    def count(x):
        try:
            return None if x is None else re.compile(x).groups
        except re.error:
            return -1

    return regex.map(count).astype("Int32")


def problem(groups: Column) -> Column:
    """The first rule that a signature breaks; null for a good one. `groups`: an array, the capture groups of each pattern's regex."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    patterns = F.zip_with("patterns", groups, lambda p, g: F.struct(p["regex"].alias("regex"), p["weight"].alias("weight"), p["vgroup"].alias("vgroup"), g.alias("groups")))
    of_pattern = lambda p: (
        F.when(p["regex"].isNull(), "pattern without regex")
        .when(p["groups"] < 0, "regex does not compile")
        .when(p["weight"].isNull(), "pattern without weight")
        .when(~((p["weight"] > 0) & (p["weight"] <= 1)), "weight outside (0, 1]")
        .when(p["vgroup"].isNotNull() & ((p["vgroup"] < 1) | (p["vgroup"] > p["groups"])), "vgroup beyond the capture groups")
    )
    return (
        F.when(blank(F.col("name")), "no name")
        .when(blank(F.col("type")), "no type").when(blank(F.col("purl")), "no purl").when(blank(F.col("description")), "no description")
        .when(~F.col("type").isin(*TYPES), "unknown type")
        .when(~F.col("purl").startswith("pkg:"), "purl does not begin with pkg:")
        .when(F.col("purl").contains("@"), "purl with a version")
        .when(F.col("version_note").isNotNull() & blank(F.col("version_note")), "empty version_note")
        .when(F.coalesce(F.size("patterns"), F.lit(0)) <= 0, "no patterns")
        .otherwise(F.get(F.filter(F.transform(patterns, of_pattern), lambda x: x.isNotNull()), F.lit(0)))
    )


def checked(signatures: DataFrame, key: str = "seq") -> DataFrame:
    """The rows with `problem`."""
    keyed = signatures.withColumn("_row", F.struct("file", key)) if "file" in signatures.columns else signatures.withColumn("_row", F.col(key))
    counts = keyed.select("_row", F.posexplode("patterns").alias("k", "p")).select("_row", F.struct("k", groups_of(F.col("p.regex")).alias("g")).alias("g"))
    counts = counts.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("g")), lambda x: x["g"]).alias("_groups"))  # one signature's patterns
    return keyed.join(counts, "_row", "left").withColumn("problem", problem(F.coalesce("_groups", F.array().cast("array<int>")))).drop("_row", "_groups")


def merged(signatures: DataFrame) -> DataFrame:
    """Of each name the signature of the last directory, at the place where the name came first."""
    by = Window.partitionBy("name")
    place = F.min(F.struct("priority", "file", "seq")).over(by)
    k = F.row_number().over(by.orderBy(F.desc("priority"), "file", "seq"))
    return signatures.withColumn("place", place).withColumn("_k", k).where("_k = 1").drop("_k")


def load(spark: SparkSession, directories: list[str]) -> list[tuple]:
    """(name, supplier, patterns) as signatures.match() takes them, in order; raises PackError. Packs are
    written by hand, so that all of them fit on the driver, as the expressions made of them have to."""
    rows = checked(read(spark, directories)).cache()
    bad = rows.where("problem is not null").select("file", "name", "problem").first()
    twice = rows.groupBy("priority", "name").agg(F.count("*").alias("n")).where("n > 1").first()
    found = merged(rows).orderBy("place").collect() if bad is None and twice is None else []
    rows.unpersist()
    if bad:
        raise PackError(f"{bad.file}: signature '{bad.name}': {bad.problem}")
    if twice:
        raise PackError(f"signature '{twice.name}' is defined twice in one directory")
    if not found:
        raise PackError("no signatures in " + os.pathsep.join(directories))
    return [(r.name, r.supplier, [(p.regex, p.weight, p.vgroup or 0) for p in r.patterns]) for r in found]


def names(signatures: DataFrame) -> DataFrame:
    """packs: the names of the packs, sorted."""
    return signatures.agg(F.array_sort(F.collect_set("pack")).alias("packs"))
