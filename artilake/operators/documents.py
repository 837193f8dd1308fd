"""Bills of materials as JSON documents, one per group of components; built in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cyclonedx(components: DataFrame, group: str) -> DataFrame:
    """group, n_components, document: CycloneDX 1.6 from rows of (group, name, version, confidence), by name and version."""
    version = F.when(F.col("version") != "", F.col("version"))  # a missing version leaves the field out
    facts = F.array(F.struct(F.lit("identification:confidence").alias("name"), F.col("confidence").cast("string").alias("value")))
    one = F.struct(F.lit("library").alias("type"), F.col("name").alias("name"), version.alias("version"), F.concat_ws("@", "name", version).alias("bom-ref"), facts.alias("properties"))
    grouped = components.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("name", F.coalesce(version, F.lit("")).alias("version"), one.alias("one")))).alias("all"))
    body = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), F.struct(F.struct(F.lit("firmware").alias("type"), F.col(group).cast("string").alias("name")).alias("component")).alias("metadata"), F.transform("all", lambda c: c["one"]).alias("components"))
    return grouped.select(group, F.size("all").cast("bigint").alias("n_components"), F.to_json(body).alias("document"))


def spdx(cyclonedx_documents: DataFrame, group: str) -> DataFrame:
    """group, n_packages, document: SPDX 2.3 made from the CycloneDX documents, so that the two agree."""
    parsed = F.from_json("document", "components array<struct<name string, version string, `bom-ref` string>>")
    rows = cyclonedx_documents.select(group, F.col(group).cast("string").alias("_name"), parsed["components"].alias("c"))
    package = F.transform("c", lambda x, k: F.struct(F.concat(F.lit("SPDXRef-Package-"), (k + 1).cast("string")).alias("SPDXID"), x["name"].alias("name"), x["version"].alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation")))
    relation = F.transform("c", lambda x, k: F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.concat(F.lit("SPDXRef-Package-"), (k + 1).cast("string")).alias("relatedSpdxElement")))
    body = F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("_name").alias("name"), package.alias("packages"), relation.alias("relationships"))
    return rows.select(group, F.size("c").cast("bigint").alias("n_packages"), F.to_json(body).alias("document"))
