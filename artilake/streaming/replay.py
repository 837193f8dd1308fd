"""Log-structured replay of a stream: the last version of each key, deletions included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, keys: list[str], order: list[Column], dead: Column) -> DataFrame:
    """keys, dead and the other columns of the last version so far, for streams (update mode) and tables.
    The state is one struct a key; an older version that comes late changes nothing."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], dead.alias("dead"), *rest)).alias("_top"))
    return top.select(*keys, F.col("_top.dead").alias("dead"), *[F.col(f"_top.{c}").alias(c) for c in rest])


def replay(rows: DataFrame, keys: list[str], order: list[Column], dead: Column, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each batch of changed keys to `apply` (which must bear being called again with the same batch)."""
    return latest(rows, keys, order, dead).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
