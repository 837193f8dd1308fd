"""Intervals, windows and caps over the parts of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unclaimed(candidates: DataFrame, claims: DataFrame, group: str, at: str, start: str, end: str) -> DataFrame:
    """The candidates whose place lies in no claimed interval [start, end) of their group.

    Claims and candidates of a group stand in one order and each candidate sees the furthest end of the
    claims that begin at or before it: one shuffle by group and no product of the two sides."""
    rows = candidates.select(*candidates.columns, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_end"))
    other = claims.select(F.col(group), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).cast("bigint").alias("_end"))
    by = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(other, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(by))
    return seen.where("_kind = 1 and (_reach is null or _reach <= _at)").select(*candidates.columns)


def overlapping(parts: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, overlaps: how many parts begin before their predecessor, by start, has ended."""
    by = Window.partitionBy(group).orderBy(start, end)
    rows = parts.withColumn("_before", F.lag(end).over(by))
    return rows.groupBy(group).agg(F.count_if(F.col("_before") > F.col(start)).alias("overlaps"))


def cyclic_window(places: DataFrame, group: str, place: str, cycle: int) -> DataFrame:
    """group, start, width: the smallest window on a cycle that covers all places; it begins behind the
    largest gap, the first of equals."""
    by = Window.partitionBy(group).orderBy(place)
    whole = Window.partitionBy(group)
    rows = places.select(group, place).distinct()
    rows = rows.withColumn("_next", F.coalesce(F.lead(place).over(by), F.min(place).over(whole))).withColumn("_gap", F.pmod(F.col("_next") - F.col(place), F.lit(cycle)))
    top = rows.groupBy(group).agg(F.max(F.struct("_gap", (-F.col(place)).alias("_order"), "_next")).alias("m"), F.count("*").alias("n"))
    last, start = -F.col("m._order"), F.col("m._next")
    return top.select(group, start.alias("start"), F.when(F.col("n") == 1, 1).otherwise(F.pmod(last - start, F.lit(cycle)) + 1).cast("bigint").alias("width"))


def capped(files: DataFrame, group: str, path: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """The first files of each group by path; reading stops before a file once `most` files or `most_bytes`
    bytes have been read, so the file that crosses the bytes is in."""
    by = Window.partitionBy(group).orderBy(path)
    rows = files.withColumn("_k", F.row_number().over(by)).withColumn("_read", F.coalesce(F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col("_k") <= most) & (F.col("_read") < most_bytes)).drop("_k", "_read")


def unique_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """The rows with `unique`: the name, and for its later bearers "name (2)", "name (3)", in order."""
    by = Window.partitionBy(group, name).orderBy(order)
    k = F.row_number().over(by)
    return rows.withColumn("_k", k).withColumn("unique", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))).drop("_k")


def batch_stems(files: DataFrame, path: str) -> DataFrame:
    """path, stem: the file name without extension; where several files share it, the path with "__" for each slash."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)\\.[^.]*$", "")
    rows = files.select(path, stem.alias("_stem"))
    shared = rows.groupBy("_stem").agg(F.count("*").alias("_n"))  # counted map-side: a common stem is no hot group
    return rows.join(shared, "_stem").select(path, F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.replace(path, F.lit("/"), F.lit("__"))).alias("stem"))
