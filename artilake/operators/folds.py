"""Hits of one component in many places as one row: over segments in order, over two lists, over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_segments(hits: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """group, name, confidence, version, segments: of rows (group, order, label, name, confidence, version).
    The surest hit counts, the earliest of equals; the version is the first that any hit has, in order,
    and no later one takes its place. A group's hits of one name are one aggregate, map-side."""
    version = F.nullif("version", F.lit(""))
    best = F.max(F.struct("confidence", (-F.col(order)).alias("_at")))
    first = F.min(F.when(version.isNotNull(), F.struct(F.col(order).alias("_at"), version.alias("version"))))
    places = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.col(label).alias("label"))))
    rows = hits.groupBy(group, "name").agg(best.alias("b"), first.alias("v"), places.alias("p"))
    return rows.select(group, "name", F.col("b.confidence").alias("confidence"), F.col("v.version").alias("version"), F.transform("p", lambda x: x["label"]).alias("segments"))


def merge_lists(primary: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confidence, version, files of two lists with one row per key each: files are united, the
    higher confidence counts, and the primary's version goes before the extra's."""
    a = primary.select(*keys, F.col("confidence").alias("_ca"), F.col("version").alias("_va"), F.col("files").alias("_fa"))
    b = extra.select(*keys, F.col("confidence").alias("_cb"), F.col("version").alias("_vb"), F.col("files").alias("_fb"))
    none = F.array().cast("array<string>")
    return a.join(b, keys, "full").select(*keys, F.greatest("_ca", "_cb").alias("confidence"), F.coalesce("_va", "_vb").alias("version"), F.array_sort(F.array_union(F.coalesce("_fa", none), F.coalesce("_fb", none))).alias("files"))


def fold_files(hits: DataFrame, group: str, path: str) -> DataFrame:
    """group, name, confidence, version, files: over the files in the order of their paths. A hit takes the
    place of the one before if it is surer, or has a version where that had none; the files are united."""
    one = F.struct(F.col(path).alias("path"), F.col("confidence").cast("double").alias("confidence"), F.nullif("version", F.lit("")).alias("version"))
    rows = hits.groupBy(group, "name").agg(F.array_sort(F.collect_list(one)).alias("h"))  # one component's files

    def step(best: Column, x: Column) -> Column:
        return F.when((x["confidence"] > best["confidence"]) | (x["version"].isNotNull() & best["version"].isNull()), x).otherwise(best)

    best = F.aggregate(F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), F.get("h", F.lit(0)), step)
    rows = rows.select(group, "name", best.alias("best"), F.array_distinct(F.transform("h", lambda x: x["path"])).alias("files"))
    return rows.select(group, "name", F.col("best.confidence").alias("confidence"), F.col("best.version").alias("version"), "files")


def settled(verdict: Column, opaque: Column, identified: Column) -> Column:
    """An opaque verdict is "mixed" once components were read out of the payload."""
    return F.when(opaque & (identified > 0), "mixed").otherwise(verdict)


def unread(files: DataFrame, group: str, path: str, size: str, listed: int = 3) -> DataFrame:
    """group, n_files, n_bytes, reason: one row for the files of a group that could not be read."""
    rows = files.groupBy(group).agg(F.count("*").alias("n_files"), F.sum(size).cast("bigint").alias("n_bytes"), F.array_sort(F.collect_set(path)).alias("p"))
    names = F.array_join(F.slice("p", 1, listed), ", ")
    more = F.when(F.size("p") > listed, F.concat(F.lit(" and "), (F.size("p") - listed).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select(group, "n_files", "n_bytes", F.concat(names, more).alias("reason"))
