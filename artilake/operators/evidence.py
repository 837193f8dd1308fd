"""What was found as rows of a report: components, edges, formats, standards, coverage, numbered evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a format's name, characters of a description, confidences of package records.
FORMAT_PARTS, DESCRIPTION, DECLARED, UNVERSIONED = 6, 400, 0.97, 0.9


def found_components(sources: dict[str, DataFrame]) -> DataFrame:
    """name, version, purl, source: all sources' rows of (name, version, purl) as one table."""
    parts = [df.select("name", "version", "purl", F.lit(name).alias("source")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def package_components(packages: DataFrame) -> DataFrame:
    """name, version, purl, description, confidence from rows of (name, version, architecture, description, purl_type)."""
    version = F.when(F.col("version").isNotNull(), F.concat(F.lit("@"), "version")).otherwise("")
    arch = F.when(F.col("architecture").isNotNull(), F.concat(F.lit("?arch="), "architecture")).otherwise("")
    purl = F.concat(F.lit("pkg:"), "purl_type", F.lit("/"), "name", version, arch)
    return packages.select("name", "version", purl.alias("purl"), F.substring("description", 1, DESCRIPTION).alias("description"), F.when(F.col("version").isNotNull(), DECLARED).otherwise(UNVERSIONED).alias("confidence"))


def dependency_graph(nodes: DataFrame, declared: DataFrame, linked: DataFrame, group: str) -> DataFrame:
    """group, ref, depends_on (sorted): each node with its declared and linked edges to other known nodes;
    a node without edges has none. Edges are made distinct before they are gathered."""
    edges = declared.select(group, "src", "dst").unionByName(linked.select(group, "src", "dst")).where("src <> dst").distinct()
    known = edges.join(nodes.select(group, F.col("ref").alias("dst")).distinct(), [group, "dst"], "left_semi")
    out = known.groupBy(group, F.col("src").alias("ref")).agg(F.array_sort(F.collect_list("dst")).alias("d"))
    return nodes.select(group, "ref").distinct().join(out, [group, "ref"], "left").select(group, "ref", F.coalesce("d", F.array().cast("array<string>")).alias("depends_on"))


def detected_format(parts: DataFrame, group: str, order: str, part: str) -> DataFrame:
    """group, format: the different parts in order, FORMAT_PARTS at most, joined by " + "."""
    first = parts.where(F.col(part).isNotNull()).groupBy(group, part).agg(F.min(order).alias("_at"))  # a part's repeats are gone before they are gathered
    rows = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", part))).alias("p"))
    return rows.select(group, F.array_join(F.slice(F.transform("p", lambda x: x[part]), 1, FORMAT_PARTS), " + ").alias("format"))


def standards(blocks: DataFrame, group: str, at: str, vendor: str, version: str) -> DataFrame:
    """group, blocks, vendors, versions (sorted), newest, first_version: of embedded standards' blocks by place."""
    first = F.min(F.when(F.col(version).isNotNull(), F.struct(at, version)))
    rows = blocks.groupBy(group).agg(F.count("*").alias("blocks"), F.array_sort(F.collect_set(vendor)).alias("vendors"), F.array_sort(F.collect_set(version)).alias("versions"), F.max(version).alias("newest"), first.alias("f"))
    return rows.select(group, "blocks", "vendors", "versions", "newest", F.col(f"f.{version}").alias("first_version"))


def root_filesystem(filesystems: DataFrame, files: DataFrame, group: str, fs: str, path: str, markers: list[str]) -> DataFrame:
    """group, fs, marked: the first filesystem that has one of the marker paths, else the group's first."""
    marked = files.where(F.col(path).isin(markers)).select(group, fs).distinct().withColumn("marked", F.lit(True))
    rows = filesystems.select(group, fs).join(marked, [group, fs], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    return rows.groupBy(group).agg(F.min(F.struct((~F.col("marked")).alias("_not"), fs)).alias("m")).select(group, F.col(f"m.{fs}").alias(fs), (~F.col("m._not")).alias("marked"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], *rest)).alias("m"))
    return top.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def register(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with `number`, 1..n in each group's report."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))


def coverage(magics: DataFrame, signatures: DataFrame, checks: DataFrame) -> DataFrame:
    """kind, label, hits, confirmed: everything that was looked for, found or not."""
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), "label", F.col("hits").cast("bigint").alias("hits"), F.col("confirmed").cast("bigint").alias("confirmed"))
    return shape(magics, "magic").unionByName(shape(signatures, "signature")).unionByName(shape(checks, "structure"))


def best_stride(probes: DataFrame, group: str) -> DataFrame:
    """group, stride, density: the densest stride of rows (group, probe, stride, density); of equals the shortest, then the first probe."""
    top = probes.groupBy(group).agg(F.max(F.struct(F.round("density", 6).alias("density"), (-F.col("stride")).alias("_s"), (-F.col("probe")).alias("_p"))).alias("m"))
    return top.select(group, (-F.col("m._s")).alias("stride"), F.col("m.density").alias("density"))


def unreadable(segments: DataFrame) -> DataFrame:
    """Segments whose content could not be listed: judged opaque, or without content though neither blank nor a filesystem."""
    return segments.where(F.coalesce("opaque", F.lit(False)) | (F.col("content").isNull() & (F.col("kind") != "filesystem") & ~F.coalesce("blank", F.lit(False))))
