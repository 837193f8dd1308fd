"""Bills of materials that vendors supply (CycloneDX and SPDX, JSON) as rows of components, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import text

CYCLONEDX = "bomFormat string, specVersion string, components array<struct<type:string,name:string,version:string,purl:string,cpe:string,description:string,supplier:struct<name:string>,licenses:array<struct<license:struct<id:string,name:string>,expression:string>>>>"
SPDX = "spdxVersion string, name string, packages array<struct<name:string,versionInfo:string,supplier:string,licenseConcluded:string,licenseDeclared:string,description:string,summary:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>"
#: Fixed value: the longest document that is read.
MAX_BYTES = 64 << 20
NONE = ("NOASSERTION", "NONE")


def form(document: Column) -> Column:
    """cyclonedx, spdx, or the reason why the document is neither."""
    head = F.from_json(document, "bomFormat string, spdxVersion string")
    return (
        F.when(F.octet_length(document) > MAX_BYTES, "too large")
        .when(head["bomFormat"] == "CycloneDX", "cyclonedx")
        .when(head["spdxVersion"].startswith("SPDX-"), "spdx")
        .when(head.isNull() | ~F.ltrim(F.coalesce(document, F.lit(""))).startswith("{"), "not JSON")
        .otherwise("neither CycloneDX nor SPDX")
    )


def _listed(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull()))


def components(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, form, seq, name, version, purl, cpe, type, licenses, supplier, description: the named components
    of each document that can be read."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), form(F.col(text_col)).alias("form"))
    cdx = rows.where("form = 'cyclonedx'").select("id", "form", F.posexplode(F.from_json("_text", CYCLONEDX)["components"]).alias("seq", "c"))
    c = F.col("c")
    licences = F.transform(F.coalesce(c["licenses"], F.expr("array()")), lambda x: F.coalesce(text(x["license"]["id"]), text(x["license"]["name"]), text(x["expression"])))
    a = cdx.select("id", "form", "seq", text(c["name"]).alias("name"), text(c["version"]).alias("version"), text(c["purl"]).alias("purl"), text(c["cpe"]).alias("cpe"), F.coalesce(text(c["type"]), F.lit("library")).alias("type"), F.filter(licences, lambda x: x.isNotNull()).alias("licenses"), text(c["supplier"]["name"]).alias("supplier"), text(c["description"]).alias("description"))
    spdx = rows.where("form = 'spdx'").select("id", "form", F.posexplode(F.from_json("_text", SPDX)["packages"]).alias("seq", "c"))
    refs = F.coalesce(c["externalRefs"], F.expr("array()"))
    last = lambda test: text(F.try_element_at(F.filter(refs, lambda r: test(F.lower(r["referenceType"]))), F.lit(-1))["referenceLocator"])
    said = lambda x: F.when(~F.upper(text(x)).isin(*NONE), text(x))
    supplier = text(F.regexp_replace(c["supplier"], "^[^:]*:", ""))
    b = spdx.select("id", "form", "seq", text(c["name"]).alias("name"), text(c["versionInfo"]).alias("version"), F.when(F.size(refs) > 0, last(lambda k: k == "purl")).alias("purl"), F.when(F.size(refs) > 0, last(lambda k: k.startswith("cpe23"))).alias("cpe"), F.lit("library").alias("type"), _listed(F.array(said(c["licenseConcluded"]), said(c["licenseDeclared"]))).alias("licenses"), supplier.alias("supplier"), F.coalesce(text(c["description"]), text(c["summary"])).alias("description"))
    return a.unionByName(b).where("name is not null")


def problems(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, error: the documents that cannot be read, beside those that can."""
    rows = documents.select(F.col(id_col).alias("id"), form(F.col(text_col)).alias("error"))
    return rows.where(~F.col("error").isin("cyclonedx", "spdx"))
