"""Firmware images as rows: record files (Intel HEX, S-record), UF2 blocks, ELF programs and raw bytes.

A file is told by its first bytes, laid out in memory by address and filled with 0xFF where nothing
is written. What cannot be read gives a row with an error instead of failing the job. Each file is
one task's work; nothing is shuffled.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOADED = "path string, kind string, base bigint, entry bigint, gap_bytes bigint, overlap_bytes bigint, longest_gap bigint, content binary, error string"
#: The largest file and the largest stretch that is filled.
MAX_BYTES, MAX_GAP = 512 << 20, 64 << 20
UF2_WORDS, UF2_END = (0x0A324655, 0x9E5D5157), 0x0AB16F30
UF2_NOT_MAIN, UF2_HAS_FAMILY = 0x1, 0x2000


def read_files(spark: SparkSession, folder: str, recursive: bool = False, skip: str = r"(^|/)[._]") -> DataFrame:
    """path, length, content: files that are neither empty, too large nor hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where((F.col("length") > 0) & (F.col("length") <= MAX_BYTES) & ~F.col("path").rlike(skip)).select("path", "length", "content")


def kind(content: Column) -> Column:
    """The form of a file by its first bytes; the order of the cases decides."""
    line = F.regexp_extract(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^\s*([^\r\n]*)", 1)
    return (
        F.when(F.substring(content, 1, 4) == F.lit(b"\x7fELF"), "elf")
        .when(F.substring(content, 1, 8) == F.lit(struct.pack("<II", *UF2_WORDS)), "uf2")
        .when(line.rlike(r"^:[0-9A-Fa-f]{10,}\s*$"), "intel-hex")
        .when(line.rlike(r"^S[0-9][0-9A-Fa-f]{6,}\s*$"), "s-record")
        .otherwise("raw")
    )


def _hex_records(data: bytes):
    """((address, bytes) parts, entry)"""
    parts, base, entry = [], 0, None
    for k, line in enumerate(data.decode("latin-1").splitlines(), 1):
        line = line.strip()
        if not line:
            continue
        if not re.fullmatch(r":(?:[0-9A-Fa-f]{2}){5,}", line):
            raise ValueError(f"line {k}: no Intel HEX record")
        raw = bytes.fromhex(line[1:])
        n, at, form, body = raw[0], int.from_bytes(raw[1:3], "big"), raw[3], raw[4:-1]
        if n != len(body):
            raise ValueError(f"line {k}: wrong length")
        if sum(raw) & 0xFF:
            raise ValueError(f"line {k}: wrong checksum")
        if form == 0:
            parts.append((base + at, body))
        elif form == 1:
            break
        elif form in (2, 4):
            base = int.from_bytes(body, "big") << (4 if form == 2 else 16)
        elif form in (3, 5):
            entry = int.from_bytes(body, "big")
    return parts, entry  # records of unknown types are passed over


def _s_records(data: bytes):
    parts, entry = [], None
    width = {1: 2, 2: 3, 3: 4, 7: 4, 8: 3, 9: 2}
    for k, line in enumerate(data.decode("latin-1").splitlines(), 1):
        line = line.strip()
        if not line:
            continue
        if not re.fullmatch(r"S[0-9](?:[0-9A-Fa-f]{2}){2,}", line):
            raise ValueError(f"line {k}: no S-record")
        form, raw = int(line[1]), bytes.fromhex(line[2:])
        if raw[0] != len(raw) - 1:
            raise ValueError(f"line {k}: wrong length")
        if sum(raw) & 0xFF != 0xFF:
            raise ValueError(f"line {k}: wrong checksum")
        if form in width and len(raw) >= width[form] + 2:  # others, and those too short for an address, are passed over
            at, body = int.from_bytes(raw[1 : 1 + width[form]], "big"), raw[1 + width[form] : -1]
            if form <= 3:
                parts.append((at, body))
            else:
                entry = at
    return parts, entry


def _uf2_blocks(data: bytes):
    parts = []
    for at in range(0, len(data) - 511, 512):
        first, second, flags, target, size = struct.unpack_from("<5I", data, at)
        if (first, second) != UF2_WORDS or struct.unpack_from("<I", data, at + 508)[0] != UF2_END or size > 476:
            raise ValueError(f"block {at // 512}: damaged")
        if not flags & UF2_NOT_MAIN:
            parts.append((target, data[at + 32 : at + 32 + size]))
    return parts, None


def _elf_segments(data: bytes):
    if len(data) < 52 or data[4] not in (1, 2) or data[5] not in (1, 2):
        raise ValueError("damaged ELF header")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    head = struct.unpack_from(order + ("QQQIHHH" if wide else "IIIIHHH"), data, 24)
    entry, table, size, count = head[0], head[1], head[5], head[6]
    parts = []
    for k in range(count):
        at = table + k * size
        if wide:
            form, _, offset, virtual, physical, length = struct.unpack_from(order + "IIQQQQ", data, at)
        else:
            form, offset, virtual, physical, length = struct.unpack_from(order + "5I", data, at)
        if form == 1 and length:
            parts.append((physical or virtual, data[offset : offset + length]))
    return parts, entry


def flatten(parts: list[tuple[int, bytes]]) -> tuple[int, bytes, int, int, int]:
    """(base, bytes, gap bytes, overlapping bytes, longest gap): in address order, later parts over earlier ones."""
    if not parts:
        raise ValueError("nothing to load")
    if sum(len(b) for _, b in parts) > MAX_BYTES:
        raise ValueError("too large")
    parts = sorted(parts, key=lambda p: p[0])
    out, base, gap, over, longest = bytearray(), parts[0][0], 0, 0, 0
    for at, body in parts:
        hole = at - base - len(out)
        if hole > MAX_GAP:
            raise ValueError(f"a gap of {hole} bytes")
        if hole > 0:
            out += b"\xff" * hole
            gap, longest = gap + hole, max(longest, hole)
        else:
            over += min(-hole, len(body))
        out[at - base : at - base + len(body)] = body
    return base, bytes(out), gap, over, longest


READERS = {"intel-hex": _hex_records, "s-record": _s_records, "uf2": _uf2_blocks, "elf": _elf_segments}


def load(files: DataFrame) -> DataFrame:
    """One row of LOADED per file of (path, content). A raw file is its own content at 0, and so is one that cannot be read, with the error."""
    schema = pa.schema([pa.field(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in LOADED.split(", "))])

    def run(batches):
        for batch in batches:
            for path, form, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = content or b""
                row = (path, form, 0, None, 0, 0, 0, data, None)
                if form in READERS:
                    try:
                        parts, entry = READERS[form](data)
                        base, flat, gap, over, longest = flatten(parts)
                        row = (path, form, base, entry, gap, over, longest, flat, None)
                    except (ValueError, struct.error) as e:
                        row = (*row[:8], str(e))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    return files.select("path", kind(F.col("content")).alias("kind"), "content").mapInArrow(run, LOADED)
