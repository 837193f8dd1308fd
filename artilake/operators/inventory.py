"""Joins, folds and windows over inventories: what was observed, what was declared, who owns what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import soname_key


def reconcile(observed: DataFrame, declared: DataFrame, keys: list[str], id_type: str = "bigint") -> DataFrame:
    """key, status: declared rows against observed ones by the first key that hits; versions by equality.
    A missing version on either side agrees without being compared. The keys are expanded with their
    place, so one equi-join serves them all; of the observed rows of a key the first is kept before the join."""
    d = declared.select("declared_id", F.col("version").alias("declared_version"), F.posexplode(F.array(*keys)).alias("place", "key")).where("key is not null")
    o = observed.select("observed_id", F.col("version").alias("observed_version"), F.explode(F.array(*keys)).alias("key")).where("key is not null")
    o = o.groupBy("key").agg(F.min(F.struct("observed_id", "observed_version")).alias("o")).select("key", "o.*")
    hit = d.join(o, "key").groupBy("declared_id", "declared_version").agg(F.min(F.struct("place", "observed_id", "observed_version")).alias("m"))
    ours, theirs = F.col("m.observed_version"), F.col("declared_version")
    matched = hit.select("declared_id", F.col("m.observed_id").alias("observed_id"), F.when(ours.isNull() | theirs.isNull() | (ours == theirs), "agree").otherwise("conflict").alias("status"), (ours.isNotNull() & theirs.isNotNull()).alias("versions_compared"))
    missing = declared.join(matched, "declared_id", "left_anti").select("declared_id", F.lit(None).cast("bigint").alias("observed_id"), F.lit("declared_only").alias("status"), F.lit(False).alias("versions_compared"))
    extra = observed.join(matched.select("observed_id").distinct(), "observed_id", "left_anti").select(F.lit(None).cast(id_type).alias("declared_id"), "observed_id", F.lit("observed_only").alias("status"), F.lit(False).alias("versions_compared"))
    return matched.unionByName(missing).unionByName(extra)


def linked(needed: DataFrame, files: DataFrame, group: str, need: str, path: str) -> DataFrame:
    """The rows of `needed` with `provider`: the group's file of that name (the first by path), else the
    first whose name is the same up to ".so"; null if none is."""
    name = F.substring_index(path, "/", -1)
    exact = files.groupBy(group, name.alias(need)).agg(F.min(path).alias("_exact"))
    base = files.groupBy(group, soname_key(F.col(path)).alias("_base")).agg(F.min(path).alias("_like"))
    rows = needed.withColumn("_base", soname_key(F.col(need))).join(exact, [group, need], "left").join(base, [group, "_base"], "left")
    return rows.withColumn("provider", F.coalesce("_exact", "_like")).drop("_exact", "_like", "_base")


def lift_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges between files as distinct edges between their owners, without loops."""
    a, b = owner.select(F.col("file").alias("src"), F.col("owner").alias("src_owner")), owner.select(F.col("file").alias("dst"), F.col("owner").alias("dst_owner"))
    return edges.join(a, "src").join(b, "dst").where("src_owner <> dst_owner").select("src_owner", "dst_owner").distinct()


def latest(rows: DataFrame, keys: list[str], order: list[Column], dead: Column) -> DataFrame:
    """The last row of each key by struct maximum (map-side), unless it is a deletion."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], dead.alias("_dead"), *rest)).alias("_top"))
    return top.where("not _top._dead").select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest])


def earliest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest])


def mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; the smaller among equals."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("order"), F.col(value).alias("value"))).alias("m")).select(group, F.col("m.value").alias(value), (-F.col("m.order")).alias("n"))


def gaps(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Stretches of each group that no interval covers, between its first and last."""
    by = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_to", F.max(end).over(by)).where(F.col(start) > F.col("_to")).select(group, F.col("_to").alias("gap_start"), F.col(start).alias("gap_end"))


def steps(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Per group the share of rows whose value is one more than that of the row before."""
    by = Window.partitionBy(group).orderBy(*order)
    d = rows.withColumn("_d", F.col(value) - F.lag(value).over(by)).where("_d is not null")
    return d.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col("_d") == 1).cast("double")).alias("step_ratio"))
