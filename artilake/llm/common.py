"""Shared helpers of the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor
can read, so a lost executor never loses the only copy of a result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch of texts that a Python worker gets at once, unless the session has a value of its own.
BATCH_ROWS, SPARKS_OWN = 1000, 10_000
#: Bits of a map that tells wanted keys from most others.
SIEVE_BITS = 1 << 24


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from Spark's own size to BATCH_ROWS, so that long texts do not add up in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == SPARKS_OWN:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; in local mode alone, a temporary folder stands in where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_artilake_dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="artilake-")
        spark._artilake_dir = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written table: cuts the lineage and is computed once."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        files, name = scratch_fs(table.stored_at)
        files.delete_dir(name)


def free_name(name: str, docs: DataFrame) -> str:
    """The name, with as many underscores before it as no column of the table has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sifted(rows: DataFrame, key: Column, few: DataFrame, its_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be one of few, rows whose key is none of them). Told apart where they are read, by a broadcast bit map
    of SIEVE_BITS whatever the input's size, so that only the former need be dealt out for an exact join."""
    place, part, bits = (free_name(c, rows) for c in ("_place", "_part", "_bits"))
    number, position = f"bitmap_bucket_number({place})", f"bitmap_bit_position({place})"
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(SIEVE_BITS)).alias(place)
    maps = few.select(at(its_key)).groupBy(F.expr(number).alias(part)).agg(F.expr(f"bitmap_construct_agg({position})").alias(bits))
    byte = f"cast(conv(hex(substring({bits}, cast({position} div 8 + 1 as int), 1)), 16, 10) as bigint)"
    hit = F.coalesce(F.expr(f"getbit({byte}, cast({position} % 8 as int)) = 1"), F.lit(False))
    marked = rows.select("*", at(key)).withColumn(part, F.expr(number)).join(F.broadcast(maps), part, "left")
    return marked.where(hit).drop(place, part, bits), marked.where(~hit).drop(place, part, bits)


def ranges(docs: DataFrame, text_col: str, bytes_each: int) -> int:
    """How many parts to deal work into so that each stands for about so many bytes of text, 8 at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()[0] or 0
    return max(8, -(-total // bytes_each))


def id_remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def text_key(col: Column) -> Column:
    """16 bytes that stand for a text: the first half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.encode(col, "UTF-8"), 256)), 1, 16)


def scratch_fs(uri: str):
    """(file system, path) for a URI of the shared folder, from Python on any node."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)
