"""Byte statistics of payloads and the verdict whether their content can be read."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = "id bigint, bank bigint, n_bytes bigint, entropy double, chi_square double, longest_run bigint, printable double, duplicate_blocks bigint"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
#: Entropy below the first is plain text, below the second mixed.
PLAIN, MIXED = 6.5, 7.5
PRINTABLE = re.compile(rb"[\x20-\x7e]{6,}")


def _facts(data: bytes) -> tuple:
    n = len(data)
    if not n:
        return 0, 0.0, 0.0, 0, 0.0, 0
    x = np.frombuffer(data, np.uint8)
    c = np.bincount(x, minlength=256).astype(float)
    p = c[c > 0] / n
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
    whole = n // 16 * 16
    blocks = np.frombuffer(data, "<c16", whole // 16).view("<u8").reshape(-1, 2) if whole else np.zeros((0, 2), "<u8")
    order = np.lexsort((blocks[:, 1], blocks[:, 0]))
    repeated = int((blocks[order][1:] == blocks[order][:-1]).all(1).sum())  # equal blocks stand together
    return n, abs(float(-(p * np.log2(p)).sum())), float(256 * (c * c).sum() / n - n), int(np.diff(cuts).max()), float(c[32:127].sum() / n), repeated


def byte_stats(payloads: DataFrame, id_col: str, text_col: str, bank: int | None = None) -> DataFrame:
    """One row per payload, or one per bank of so many bytes; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = data or b""
                parts = [data] if bank is None else [data[at : at + bank] for at in range(0, len(data), bank)]
                rows += [(key, k, *_facts(part)) for k, part in enumerate(parts)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], [c.split()[0] for c in STATS.split(", ")])

    rows = payloads.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("data"))
    return rows.mapInArrow(run, STATS)


def opacity(entropy: Column, architecture: Column | None = None, compression: Column | None = None) -> Column:
    """The verdict: machine code is plain text whatever its entropy; a compressed container is named."""
    none = F.lit(None).cast("string")
    architecture, compression = none if architecture is None else architecture, none if compression is None else compression
    return (
        F.when(architecture.isNotNull() | (entropy < PLAIN), "plaintext")
        .when(entropy < MIXED, "mixed")
        .when(compression.isNotNull(), F.concat(F.lit("compressed ("), compression, F.lit(")")))
        .otherwise("opaque")
    )


BANKS = "id bigint, bank bigint, start bigint, end bigint, size bigint, entropy double, ff_percent double, zero_percent double, strings bigint, sha256 string"
#: Fixed value: a payload has at most about so many banks; longer ones have larger banks.
MOST_BANKS = 256


def bank_table(payloads: DataFrame, id_col: str, text_col: str, bank: int = 1 << 16) -> DataFrame:
    """One row per bank of each payload: entropy, fill, printable strings (they do not span banks) and SHA-256."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = data or b""
                size = bank if len(data) <= bank * MOST_BANKS else 1 << max(16, (len(data) // MOST_BANKS).bit_length())
                for k, at in enumerate(range(0, len(data), size)):
                    part = data[at : at + size]
                    share = np.bincount(np.frombuffer(part, np.uint8), minlength=256) / len(part)
                    some = share[share > 0]
                    rows.append((key, k, at, at + len(part) - 1, len(part), abs(float(-(some * np.log2(some)).sum())), 100 * float(share[255]), 100 * float(share[0]), len(PRINTABLE.findall(part)), hashlib.sha256(part).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.int64(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in BANKS.split(", ")])

    rows = payloads.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("data"))
    return rows.mapInArrow(run, BANKS)


def headline(stats: DataFrame, group: str) -> DataFrame:
    """The payload with the highest entropy of each group, the smallest id first. Map-side maximum."""
    best = F.max(F.struct(F.round("entropy", 4).alias("entropy"), (-F.col("id")).alias("order")))
    return stats.groupBy(group).agg(best.alias("best"), F.count("*").alias("payloads")).select(group, (-F.col("best.order")).alias("id"), F.col("best.entropy").alias("entropy"), "payloads")


def blank(content: Column) -> Column:
    """Are 99 % of the first MiB's bytes 0x00 or 0xFF? Nothing at all is blank. In the JVM, over spaced hex digits."""
    spaced = F.regexp_replace(F.hex(F.substring(content, 1, 1 << 20)), "(..)", "$1 ")
    other = F.length(F.replace(F.replace(spaced, F.lit("00 ")), F.lit("FF ")))
    return other * 100 <= F.length(spaced)
