"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces of 4096 and, for the rest, into the powers of two of
its binary representation, longest first. Equal lengths form a bucket, and every piece is a
sequence of its own, whose length is a power of two: nothing is padded and no sequence holds ids
of two documents. Sequences are numbered bucket by bucket, longest first.

Null and empty texts hold the end id alone. Repeated rows and repeated ids are packed once for
each row; a very long text's pieces of 4096 come first. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored
from .tokens import encoder, small_batches, tokenizer_path

#: So many (task, length) counts are broadcast, so that no ids are shuffled; beyond it the pieces are joined by shuffle.
BROADCAST_ROWS = 1_000_000
PIECES = "id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, part int, k bigint"
_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("k", pa.int64())])


def lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to n, longest first, none over `longest` (a power of two)."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, end_id: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit), the number of the task that
    made it and its number among the task's pieces of that length."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        for batch in small_batches(batches, 500):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                total, at = len(ids) // 4, 0
                for n in lengths(total, longest):
                    k = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc, at, n, total, ids[4 * at : 4 * (at + n)], part, k))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, doc_tokens, ids, sequence_id, offset: one row per piece."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    cut = stored(pieces(docs, path or tokenizer_path(), end_id, longest, id_col, text_col), "pieces")
    tasks = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_task = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for each length: bounded by log2(longest) + 1
    totals = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    longer, first = 0, F.lit(0).cast("bigint")
    for length in sorted(totals, reverse=True):
        first = F.when(F.col("length") == length, F.lit(longer).cast("bigint")).otherwise(first)
        longer += totals[length]
    before = stored(tasks.select("length", "part", (first + F.coalesce(F.sum("n").over(by_task), F.lit(0))).alias("before")), "before")
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    return cut.join(before, ["length", "part"]).select("id", "start", "length", "doc_tokens", "ids", (F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir)))
