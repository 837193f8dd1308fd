"""Container and file-system magics in payloads: raw hits, those that a closer look confirms, and where they are.

A payload's bytes are looked at as Latin-1 text, so that regular expressions of the JVM find bytes;
nothing is shuffled and a payload never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats: label, magic, and how a hit is confirmed ("" where the magic alone does).
CHECKS = (
    ("ELF", b"\x7fELF", "elf"),
    ("PE/DOS", b"MZ", "weak"),
    ("ZIP", b"PK\x03\x04", ""),
    ("GZIP", b"\x1f\x8b", "weak"),
    ("XZ", b"\xfd7zXZ\x00", ""),
    ("BZIP2", b"BZh", ""),
    ("7-Zip", b"7z\xbc\xaf\x27\x1c", ""),
    ("Zstandard", b"\x28\xb5\x2f\xfd", ""),
    ("LZ4", b"\x04\x22\x4d\x18", ""),
    ("SquashFS little-endian", b"hsqs", "size"),
    ("SquashFS big-endian", b"sqsh", ""),
    ("UBI erase counter", b"UBI#", ""),
    ("JFFS2 little-endian", b"\x85\x19", "weak"),
    ("JFFS2 big-endian", b"\x19\x85", "weak"),
    ("CramFS little-endian", b"\x45\x3d\xcd\x28", ""),
    ("CramFS big-endian", b"\x28\xcd\x3d\x45", ""),
    ("uImage", b"\x27\x05\x19\x56", ""),
    ("Android boot image", b"ANDROID!", ""),
    ("Flattened Device Tree", b"\xd0\x0d\xfe\xed", ""),
)
#: Compressed containers by their first bytes.
COMPRESSED = ((b"\x1f\x8b\x08", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x5d\x00\x00", "lzma"), (b"\x04\x22\x4d\x18", "lz4"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"PK\x03\x04", "zip"), (b"hsqs", "squashfs"), (b"\x27\x05\x19\x56", "u-boot uImage"))
MOST_HITS, OFFSETS = 4096, 8


def _places(latin: Column, magic: bytes) -> Column:
    """Offsets of the magic, one behind the other; overlapping ones do not count."""
    gaps = F.split(latin, "".join(f"\\x{b:02x}" for b in magic), -1)
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + len(magic)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(x)).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.when(F.size(gaps) > 1, F.aggregate(F.slice(gaps, 1, F.least(F.size(gaps) - 1, F.lit(MOST_HITS))), start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<int>"))


def _confirmed(data: Column, places: Column, how: str) -> Column:
    if how == "weak":  # two bytes are never confirmed
        return F.array().cast("array<int>")
    byte = lambda at: F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("bigint")
    if how == "elf":
        return F.filter(places, lambda p: byte(p + 4).isin(1, 2) & byte(p + 5).isin(1, 2))
    if how == "size":
        size = lambda p: sum(byte(p + 40 + k) * 256**k for k in range(4))
        return F.filter(places, lambda p: size(p).between(1, F.length(data)))
    return places


def scan(payloads: DataFrame, id_col: str, data_col: str, checks=CHECKS) -> DataFrame:
    """id, label, raw_hits, validated_hits, offsets: one row for each magic that a payload holds."""
    data = F.col(data_col)
    latin = F.decode(data, "ISO-8859-1")
    found = []
    for label, magic, how in checks:
        places = _places(latin, magic)
        found.append(F.struct(F.lit(label).alias("label"), places.alias("raw"), _confirmed(data, places, how).alias("ok")))
    rows = payloads.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*found), lambda x: F.size(x["raw"]) > 0)).alias("h"))
    offsets = F.slice(F.when(F.size("h.ok") > 0, F.col("h.ok")).otherwise(F.col("h.raw")), 1, OFFSETS)
    return rows.select("id", "h.label", F.size("h.raw").cast("bigint").alias("raw_hits"), F.size("h.ok").cast("bigint").alias("validated_hits"), offsets.alias("offsets"))


def compression(data: Column) -> Column:
    """The compressed container that begins here; null if none does."""
    return F.coalesce(*(F.when(F.substring(data, 1, len(m)) == F.lit(m), F.lit(name)) for m, name in COMPRESSED))
