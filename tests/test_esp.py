"""ESP images and flash layouts against files made here by their layout."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from artilake.sources import esp


def descriptor(version=b"1.2", idf=b" v5.1 "):
    return (struct.pack("<II", 0xABCD5432, 3).ljust(16, b"\0") + version.ljust(32, b"\0") + b"lamp".ljust(32, b"\0") + bytes(16) + b"May 1 2024".ljust(16, b"\0") + idf.ljust(32, b"\0") + b"\x01" * 32).ljust(256, b"\0")


def image(*bodies, chip=5, entry=0x40380000, count=None):
    head = struct.pack("<BBBBI", 0xE9, len(bodies) if count is None else count, 2, 0, entry).ljust(12, b"\0") + struct.pack("<H", chip)
    return head.ljust(23, b"\0") + b"\x01" + b"".join(struct.pack("<II", 0x3C000000 + k, len(b)) + b for k, b in enumerate(bodies))


def entry(kind, subtype, address, size, name):
    return b"\xaa\x50" + struct.pack("<BBII", kind, subtype, address, size) + name.ljust(16, b"\0") + bytes(4)


def flash(boot=b"", *entries, apps=()):
    out = bytearray(b"\xff" * 0x20000)
    out[0x1000 : 0x1000 + len(boot)] = boot
    table = b"".join(entries)
    out[0x8000 : 0x8000 + len(table)] = table
    for at, body in apps:
        out[at : at + len(body)] = body
    return bytes(out)


FILES = {
    "app": image(descriptor(), b"xyz"),
    "app-plain": image(b"abc", chip=0x77),
    "flash": flash(image(b"boot"), entry(1, 2, 0x9000, 0x5000, b"nvs"), entry(0, 0x10, 0x10000, 0x8000, b""), entry(0, 0x11, 0x18000, 0x8000, b"ota1"), entry(0x40, 7, 0x1F000, 16, b"\xe9x"), apps=[(0x10000, image(b"none")), (0x18000, image(descriptor(b"")))]),
    "boot-only": flash(image(b"boot")),
    "table-only": flash(b"", entry(1, 2, 0x9000, 0x5000, b"nvs")),
    "far": flash(image(b"boot"), entry(0, 0, 0xFFFFFFF0, 16, b"far")),
    "cut": image(b"abc")[:-1],
    "cut-header": image(b"abc")[:20],
    "no-segments": image(),
    "seventeen": image(*[b"a"] * 17),
    "entry": image(b"abc", entry=0x10),
    "huge": image(b"abc", count=2) + struct.pack("<II", 0, 0xFFFFFFFF),
    "empty": b"",
    "null": None,
}


def test_layouts(spark):
    found = esp.layouts(spark.createDataFrame(list(FILES.items()), "path string, content binary"))
    rows = {r.path: r for r in found.collect()}
    assert {p: r.kind for p, r in rows.items()} == {"app": "application", "app-plain": "application", "flash": "flash", "boot-only": "flash", "far": "flash"}
    app = rows["app"].primary
    assert (app.chip, app.core, app.entry_point, app.hash_appended, app.end) == ("ESP32-C3", "RISC-V", 0x40380000, True, len(FILES["app"]))
    assert [tuple(s) for s in app.segments] == [(0, 0x3C000000, 32, 256), (1, 0x3C000001, 296, 3)]
    assert (app.app.app_version, app.app.project_name, app.app.build_time, app.app.idf_version, app.app.secure_version, app.app.elf_sha256) == ("1.2", "lamp", None, "v5.1", 3, "01" * 32)
    plain = rows["app-plain"].primary
    assert (plain.chip, plain.core, plain.app) == ("unknown chip 0x0077", None, None)
    assert rows["flash"].primary.offset == 0x18000 and rows["flash"].primary.app.app_version is None  # the first with a descriptor
    assert rows["boot-only"].primary.offset == rows["far"].primary.offset == 0x1000
    got = esp.partition_images(found.where("path = 'flash'")).select("index", "name", "type", "subtype", F.col("image.offset").alias("at")).orderBy("index").collect()
    assert [tuple(r) for r in got] == [(0, "nvs", "data", "nvs", None), (1, "partition-1", "app", "ota_0", 0x10000), (2, "ota1", "app", "ota_1", 0x18000), (3, "�x", "0x40", "0x07", None)]


def test_partitions(spark):
    rows = {"many": b"".join(entry(0, k, k, 1, b"n%d" % k) for k in range(100)), "gap": entry(1, 0x83, 1, 2, b"a") + bytes(32) + entry(0, 0, 1, 2, b"b"), "short": entry(0, 0x20, 9, 9, b"t")[:-1], "null": None}
    got = esp.partitions(spark.createDataFrame(list(rows.items()), "path string, content binary"), 0).collect()
    assert sum(r.path == "many" for r in got) == 95
    assert [(r.name, r.subtype, r.address, r.size) for r in got if r.path != "many"] == [("a", "littlefs", 1, 2)]
    assert [r.subtype for r in got if r.path == "many" and r["index"] in (0, 16, 31, 32, 33)] == ["factory", "ota_0", "ota_15", "test", "0x21"]
