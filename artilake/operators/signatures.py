"""Weighted signature matching: which known components a payload holds, how surely, in which version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import version_token

#: name, supplier, patterns of (regular expression, weight, group of the version or 0).
LICENSES = [
    ("apache", "Apache Software Foundation", [("Apache License, Version ([0-9.]*[0-9])", 0.9, 1), ("Licensed under the Apache License", 0.6, 0)]),
    ("mit", "MIT", [("MIT License", 0.85, 0), ("Permission is hereby granted, free of charge", 0.7, 0)]),
    ("gpl", "Free Software Foundation", [("GNU General Public License, version ([0-9]+)", 0.9, 1), ("GNU General Public License", 0.5, 0)]),
    ("creative-commons", "Creative Commons", [("CC BY(?:-NC)?(?:-SA)? ([0-9]\\.[0-9])", 0.8, 1), ("CC BY", 0.4, 0)]),
]
MOST, STEP, EVIDENCE = 0.97, 0.05, 8
HIGH, MEDIUM = 0.8, 0.5


def _pattern(text: Column, regex: str, weight: float, group: int, seq: int) -> Column:
    """The pattern's match: the first with a version, else the first; null without one."""
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    versions = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else F.transform(whole, lambda _: F.lit(""))
    both = F.arrays_zip(whole.alias("whole"), versions.alias("version"))
    pick = F.coalesce(F.get(F.filter(both, lambda m: m["version"] != ""), F.lit(0)), F.get(both, F.lit(0)))
    return F.when(text.rlike(regex), F.struct(F.lit(seq).alias("seq"), F.lit(weight).alias("weight"), pick["version"].alias("version"), pick["whole"].alias("evidence")))


def match(payloads: DataFrame, id_col: str, text_col: str, pack=LICENSES) -> DataFrame:
    """id, name, n_patterns, confidence, version, evidence: one literal expression per pattern, in one scan
    of the payloads; nothing is joined or shuffled."""
    hits = []
    for name, _, patterns in pack:
        found = F.array_compact(F.array(*[_pattern(F.col(text_col), *p, k) for k, p in enumerate(patterns)]))
        hits.append(F.struct(F.lit(name).alias("name"), found.alias("found")))
    one = payloads.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*hits), lambda h: F.size(h["found"]) > 0)).alias("h"))
    found = F.col("h.found")
    confidence = F.round(F.least(F.lit(MOST), F.array_max(F.transform(found, lambda m: m["weight"])) + STEP * (F.size(found) - 1)), 2)
    version = F.get(F.filter(F.transform(found, lambda m: m["version"]), lambda v: v != ""), F.lit(0))
    evidence = F.array_join(F.slice(F.transform(found, lambda m: m["evidence"]), 1, EVIDENCE), " | ")
    return one.select("id", F.col("h.name").alias("name"), F.size(found).cast("bigint").alias("n_patterns"), confidence.alias("confidence"), F.coalesce(version, F.lit("")).alias("version"), evidence.alias("evidence"))


def level(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def packs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, supplier string, priority int, seq int")


def override(signatures: DataFrame) -> DataFrame:
    """Of each name the one with the highest priority, at the place where the name came first."""
    by = Window.partitionBy("name")
    first = signatures.withColumn("place", F.min("seq").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("priority"), "seq")))
    return first.where("k = 1").select("name", "supplier", "priority", "place")


def names(spark: SparkSession, pack=LICENSES) -> DataFrame:
    return spark.createDataFrame([(n, s) for n, s, _ in pack], "name string, supplier string")


def coverage(hits: DataFrame, known: DataFrame) -> DataFrame:
    """How many payloads each signature is found in, 0 for none."""
    found = hits.groupBy("name").agg(F.count("*").alias("payloads"), F.max("confidence").alias("best"))
    return known.join(found, "name", "left").select("name", "supplier", F.coalesce("payloads", F.lit(0)).cast("bigint").alias("payloads"), "best")


def merged(hits: DataFrame, group: str) -> DataFrame:
    """One row per group and name: the surest hit (a version first among equals, then the smallest id)."""
    order = F.struct("confidence", (F.col("version") != "").alias("exact"), (-F.col("id")).alias("order"), "version")
    top = hits.groupBy(group, "name").agg(F.max(order).alias("top"), F.count("*").alias("payloads"))
    return top.select(group, "name", F.col("top.confidence").alias("confidence"), F.col("top.version").alias("version"), (-F.col("top.order")).alias("id"), "payloads")


def match_strings(strings: DataFrame, pack=LICENSES) -> DataFrame:
    """id, name, confidence, version, inferred, evidence: signatures matched over extracted strings (id, offset, text).

    Of a pattern the first string by offset counts whose match has a version, else the first that matches;
    evidence (offset, text) stands in the order of the patterns. Where no pattern has a version, a token of
    the matched texts that looks like one is taken and marked as inferred. Each string is looked at once,
    with one literal expression per pattern; only matches are shuffled, after a map-side minimum."""
    hits = []
    for name, _, patterns in pack:
        for seq, (regex, weight, group) in enumerate(patterns):
            version = F.nullif(F.regexp_extract("text", regex, group), F.lit("")) if group else F.lit(None).cast("string")
            hits.append(F.when(F.col("text").rlike(regex), F.struct(F.lit(name).alias("name"), F.lit(seq).alias("seq"), F.lit(float(weight)).alias("weight"), version.alias("version"), F.regexp_extract("text", regex, 0).alias("evidence"))))
    rows = strings.select("id", "offset", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("id", "offset", "h.*")
    best = rows.groupBy("id", "name", "seq", "weight").agg(F.min(F.struct(F.col("version").isNull().alias("none"), "offset", "version", "evidence")).alias("b"))
    one = F.struct("seq", "b.offset", "b.version", "b.evidence")
    all_ = best.groupBy("id", "name").agg(F.max("weight").alias("w"), F.array_sort(F.collect_list(one)).alias("m"))  # one pattern a row
    said = F.get(F.filter(F.transform("m", lambda x: x["version"]), lambda v: v.isNotNull()), F.lit(0))
    kept = F.slice("m", 1, EVIDENCE)
    token = F.get(F.filter(F.transform(kept, lambda x: version_token(x["evidence"])), lambda v: v.isNotNull()), F.lit(0))
    evidence = F.array_join(F.transform(kept, lambda x: F.concat(x["offset"].cast("string"), F.lit(":"), x["evidence"])), " | ")
    return all_.select("id", "name", F.round(F.least(F.lit(MOST), F.col("w") + STEP * (F.size("m") - 1)), 2).alias("confidence"), F.coalesce(said, token).alias("version"), (said.isNull() & token.isNotNull()).alias("inferred"), evidence.alias("evidence"))
