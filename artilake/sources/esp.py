"""ESP application images and flash layouts, in the JVM: headers, segments, partitions.

Only headers are looked at and nothing is shuffled; a file is one row until its partitions are
dealt out. Null and short contents give no row. A header that is not plausible is none, so a stray
magic byte in packed data does not end a run. Blank texts are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wrappers import number

#: Fixed values of the format.
IMAGE_MAGIC, IMAGE_HEADER, SEGMENT_HEADER, MAX_SEGMENTS = 0xE9, 24, 8, 16
ENTRY_LEAST, ENTRY_MOST = 0x3C000000, 0x50200000
APP_MAGIC, APP_BYTES = 0xABCD5432, 256
TABLE_AT, BOOTLOADER_AT, ENTRY_MAGIC, ENTRY_BYTES, MAX_ENTRIES = 0x8000, 0x1000, b"\xaa\x50", 32, 95
CHIPS = {
    0x0000: ("ESP32", "Xtensa LX6"),
    0x0002: ("ESP32-S2", "Xtensa LX7"),
    0x0005: ("ESP32-C3", "RISC-V"),
    0x0009: ("ESP32-S3", "Xtensa LX7"),
    0x000C: ("ESP32-C2", "RISC-V"),
    0x000D: ("ESP32-C6", "RISC-V"),
    0x0010: ("ESP32-H2", "RISC-V"),
    0x0012: ("ESP32-P4", "RISC-V"),
    0x0017: ("ESP32-C5", "RISC-V"),
}
KINDS = {0: "app", 1: "data"}
APP_SUBTYPES = {0x00: "factory", 0x20: "test"}
DATA_SUBTYPES = {0x00: "ota", 0x01: "phy", 0x02: "nvs", 0x03: "coredump", 0x04: "nvs_keys", 0x05: "efuse", 0x06: "undefined", 0x80: "esphttpd", 0x81: "fat", 0x82: "spiffs", 0x83: "littlefs"}
OTA_FIRST, OTA_LAST = 0x10, 0x1F
SEGMENT = "struct<index:int,load_address:bigint,offset:bigint,length:bigint>"


def _bytes(content: Column, at: Column, n: int) -> Column:
    return F.substring(content, (at + 1).cast("int"), F.lit(n))


def _little(content: Column, at: Column, n: int) -> Column:
    return number(content, at.cast("int"), n, little=True)


def _name(table: dict, code: Column, otherwise: Column) -> Column:
    """The table's name of a code."""
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code.cast("int")), otherwise)


def _hex2(code: Column) -> Column:
    return F.format_string("0x%02x", code)


def subtype_name(kind: Column, subtype: Column) -> Column:
    """The name of a partition's subtype; its number in hexadecimal where it has none."""
    app = F.when(subtype.between(OTA_FIRST, OTA_LAST), F.concat(F.lit("ota_"), (subtype - OTA_FIRST).cast("string"))).otherwise(_name(APP_SUBTYPES, subtype, _hex2(subtype)))
    return F.when(kind == 0, app).when(kind == 1, _name(DATA_SUBTYPES, subtype, _hex2(subtype))).otherwise(_hex2(subtype))


def app_descriptor(content: Column, at: Column) -> Column:
    """What the build wrote at the start of the first segment; null without its magic."""

    def text(start: int, n: int) -> Column:
        valid = F.make_valid_utf8(_bytes(content, at + start, n).cast("string"))
        return F.nullif(F.regexp_replace(F.substring_index(valid, "\0", 1), r"^\s+|\s+$", ""), F.lit(""))

    fields = {"secure_version": _little(content, at + 4, 4), "app_version": text(16, 32), "project_name": text(48, 32), "build_time": text(80, 16), "build_date": text(96, 16), "idf_version": text(112, 32), "elf_sha256": F.lower(F.hex(_bytes(content, at + 144, 32)))}
    fits = (at + APP_BYTES <= F.length(content)) & (_little(content, at, 4) == APP_MAGIC)
    return F.when(fits, F.struct(*(v.alias(k) for k, v in fields.items())))


def image_at(content: Column, at: Column) -> Column:
    """The image whose header stands at an offset: chip, entry point, segments, end and descriptor; null if there is none."""
    size, count, entry = F.length(content).cast("bigint"), _little(content, at + 1, 1), _little(content, at + 4, 4)
    start = F.struct((at + IMAGE_HEADER).cast("bigint").alias("at"), F.lit(True).alias("fits"), F.expr(f"cast(array() as array<{SEGMENT}>)").alias("found"))

    def step(state: Column, k: Column) -> Column:
        body = state["at"] + SEGMENT_HEADER
        length = _little(content, state["at"] + 4, 4)
        segment = F.struct(k.cast("int").alias("index"), _little(content, state["at"], 4).alias("load_address"), body.alias("offset"), length.alias("length"))
        fits = state["fits"] & F.coalesce(body + length <= size, F.lit(False))
        return F.when(fits, F.struct((body + length).alias("at"), F.lit(True).alias("fits"), F.concat(state["found"], F.array(segment)).alias("found"))).otherwise(F.struct(state["at"].alias("at"), F.lit(False).alias("fits"), state["found"].alias("found")))

    plausible = (at + IMAGE_HEADER <= size) & (_little(content, at, 1) == IMAGE_MAGIC) & count.between(1, MAX_SEGMENTS) & entry.between(ENTRY_LEAST, ENTRY_MOST)
    chip = _little(content, at + 12, 2)

    def finish(state: Column) -> Column:  # the walk's result is a variable here, so it is made once
        fields = {
            "offset": at.cast("bigint"),
            "chip_id": chip,
            "chip": _name({k: v[0] for k, v in CHIPS.items()}, chip, F.format_string("unknown chip 0x%04x", chip)),
            "core": _name({k: v[1] for k, v in CHIPS.items()}, chip, F.lit(None).cast("string")),
            "entry_point": entry,
            "hash_appended": _little(content, at + 23, 1) % 2 == 1,
            "segments": state["found"],
            "end": state["at"],
            "app": app_descriptor(content, state["found"][0]["offset"]),
        }
        return F.when(state["fits"], F.struct(*(v.alias(k) for k, v in fields.items())))

    return F.when(plausible, F.aggregate(F.sequence(F.lit(0), (count - 1).cast("int")), start, step, finish))


def table_at(content: Column, at: int = TABLE_AT) -> Column:
    """The entries of a partition table, up to the first that has no magic; empty if there is none."""
    place = lambda k: F.lit(at) + k * ENTRY_BYTES
    fits = lambda k: F.coalesce((place(k) + ENTRY_BYTES <= F.length(content)) & (_bytes(content, place(k), 2) == F.lit(ENTRY_MAGIC)), F.lit(False))
    every = F.sequence(F.lit(0), F.lit(MAX_ENTRIES - 1))
    n = F.coalesce(F.array_min(F.filter(every, lambda k: ~fits(k))), F.lit(MAX_ENTRIES))

    def entry(k: Column) -> Column:
        p = place(k)
        kind, subtype = _little(content, p + 2, 1), _little(content, p + 3, 1)
        raw = F.substring_index(F.decode(_bytes(content, p + 12, 16), "ISO-8859-1"), "\0", 1)
        name = F.nullif(F.regexp_replace(raw, r"[^\x00-\x7f]", "�"), F.lit(""))
        return F.struct(
            k.alias("index"),
            F.coalesce(name, F.concat(F.lit("partition-"), k.cast("string"))).alias("name"),
            kind.alias("type_id"),
            _name(KINDS, kind, _hex2(kind)).alias("type"),
            subtype.alias("subtype_id"),
            subtype_name(kind, subtype).alias("subtype"),
            _little(content, p + 4, 4).alias("address"),
            _little(content, p + 8, 4).alias("size"),
        )

    # the sequence is made once, before the entries: [1 .. n] for n entries, [] for none
    return F.transform(F.slice(every, F.lit(1), n), entry)


def partitions(files: DataFrame, at: int = TABLE_AT) -> DataFrame:
    """path and each entry of the partition table of each (path, content)."""
    return files.select("path", F.inline(table_at(F.col("content"), at)))


def layouts(files: DataFrame) -> DataFrame:
    """path, kind (application or flash), partitions, images, bootloader, primary: one row per ESP file.

    A flash's primary image is the first of its app partitions' that has a descriptor, else the first,
    else the bootloader.
    """
    c = F.col("content")
    parsed = files.select("path", image_at(c, F.lit(0)).alias("_whole"), image_at(c, F.lit(BOOTLOADER_AT)).alias("_boot"), table_at(c).alias("_table"), c.alias("_bytes"))
    inside = F.transform(F.filter("_table", lambda p: p["type_id"] == 0), lambda p: F.struct(p["name"].alias("partition"), image_at(F.col("_bytes"), p["address"]).alias("image")))
    parsed = parsed.withColumn("_images", F.filter(inside, lambda x: x["image"].isNotNull()))
    first = F.coalesce(F.get(F.filter("_images", lambda x: x["image"]["app"].isNotNull()), F.lit(0))["image"], F.get("_images", F.lit(0))["image"], F.col("_boot"))
    whole = F.col("_whole").isNotNull()
    return parsed.where(whole | F.col("_boot").isNotNull() | (F.size("_images") > 0)).select(
        "path",
        F.when(whole, "application").otherwise("flash").alias("kind"),
        F.when(~whole, F.col("_table")).alias("partitions"),
        F.when(~whole, F.col("_images")).alias("images"),
        F.when(~whole, F.col("_boot")).alias("bootloader"),
        F.coalesce(F.col("_whole"), first).alias("primary"),
    )


def partition_images(found: DataFrame) -> DataFrame:
    """path, each partition of layouts(), and the first image of its name; null where it has none."""
    rows = found.select("path", "images", F.explode("partitions").alias("_p"))
    return rows.select("path", "_p.*", F.get(F.filter("images", lambda x: x["partition"] == F.col("_p.name")), F.lit(0))["image"].alias("image"))
