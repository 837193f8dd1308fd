"""Record framing: what the byte columns of a grid of records are, over rows of (group, rec, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import crc8, sum8, xor8

#: Shares that make a column constant, a counter, slow, or a checksum of the record.
CONSTANT, COUNTER, SLOW, MATCH = 0.99, 0.80, 0.95, 0.9
#: Checksum algorithms in the order in which they are tried.
ALGORITHMS = ("sum8", "neg-sum8", "xor8", "crc8-0x07", "crc8-0x31", "crc8-0x1d")


def column_roles(cells: DataFrame, keys: list[str], rec: str, value: str) -> DataFrame:
    """keys, role, constant: constant, counter (steps of one), slow (repeats and steps of one) or payload; steps are modulo 256."""
    by = Window.partitionBy(*keys).orderBy(rec)
    rows = cells.withColumn("_step", F.pmod(F.col(value) - F.lag(value).over(by), F.lit(256)))
    n, ones, zeros = F.count("_step"), F.count_if(F.col("_step") == 1), F.count_if(F.col("_step") == 0)
    a = rows.groupBy(*keys).agg(n.alias("n"), ones.alias("ones"), zeros.alias("zeros"), F.min(value).alias("low"), F.max(value).alias("high"))
    role = F.when(F.col("low") == F.col("high"), "constant").when(F.col("ones") >= COUNTER * F.col("n"), "counter").when((F.col("ones") >= 2) & (F.col("ones") + F.col("zeros") >= SLOW * F.col("n")), "slow").otherwise("payload")
    return a.select(*keys, role.alias("role"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("constant"))


def verified(cells: DataFrame, group: str, rec: str, constant: str, expected: int, counter: str) -> DataFrame:
    """group, records, framed: do the constant column and the counter column hold over all records?"""
    by = Window.partitionBy(group).orderBy(rec)
    rows = cells.withColumn("_step", F.pmod(F.col(counter) - F.lag(counter).over(by), F.lit(256)))
    a = rows.groupBy(group).agg(F.count("*").alias("records"), F.count_if(F.col(constant) == expected).alias("c"), F.count_if(F.col("_step") == 1).alias("ones"), F.count("_step").alias("steps"))
    return a.select(group, "records", ((F.col("c") >= CONSTANT * F.col("records")) & ((F.col("steps") == 0) | (F.col("ones") >= COUNTER * F.col("steps")))).alias("framed"))


def checksum(payload: Column, name: str) -> Column:
    """The payload's checksum (an array of byte values) by an algorithm."""
    if name == "neg-sum8":
        return F.pmod(-sum8(payload), F.lit(256))
    if name.startswith("crc8-"):
        return crc8(payload, int(name[5:], 16))
    return {"sum8": sum8, "xor8": xor8}[name](payload)


def checksum_algorithm(records: DataFrame, group: str, payload: str, check: str) -> DataFrame:
    """group, algorithm: the first that MATCH of the group's records satisfy; null if none does."""
    counts = [F.count_if(checksum(F.col(payload), a) == F.col(check)).alias(f"_{k}") for k, a in enumerate(ALGORITHMS)]
    rows = records.groupBy(group).agg(F.count("*").alias("_n"), *counts)
    found = F.coalesce(*(F.when(F.col(f"_{k}") >= MATCH * F.col("_n"), F.lit(a)) for k, a in enumerate(ALGORITHMS)))
    return rows.select(group, found.alias("algorithm"))


def deframed(cells: DataFrame, group: str, rec: str, payload: str) -> DataFrame:
    """group, payload: the records' payloads (text) in order, as one; a group is one delivered file."""
    return cells.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rec, payload))), lambda x: x[payload]), "").alias("payload"))
