"""Readers against known bytes, documents against their rows, and the replay of a stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from artilake.operators import documents, stats
from artilake.sources import archives, control, images
from artilake.streaming import replay


def hex_line(at: int, form: int, body: bytes) -> str:
    raw = bytes([len(body)]) + at.to_bytes(2, "big") + bytes([form]) + body
    return ":" + (raw + bytes([-sum(raw) & 0xFF])).hex().upper()


def s_line(form: int, at: int, width: int, body: bytes) -> str:
    raw = bytes([width + len(body) + 1]) + at.to_bytes(width, "big") + body
    return f"S{form}" + (raw + bytes([~sum(raw) & 0xFF])).hex().upper()


def entry(name: str, mode: int, body: bytes = b"", inode: int = 1, links: int = 1) -> bytes:
    fields = [inode, mode, 0, 0, links, 7, len(body), 0, 0, 0, 0, len(name) + 1, 0]
    head = b"070701" + b"".join(b"%08X" % f for f in fields) + name.encode() + b"\0"
    head += b"\0" * (-len(head) % 4)
    return head + body + b"\0" * (-len(body) % 4)


HEX = "\n".join([hex_line(0, 4, b"\x08\x00"), hex_line(4, 0, b"wxyz"), hex_line(0, 0, b"ab"), hex_line(0, 5, b"\x08\0\0\1"), hex_line(0, 1, b"")])
UF2 = b"".join(struct.pack("<8I", *images.UF2_WORDS, flags, at, 4, 0, 1, 0) + body + b"\0" * 472 + struct.pack("<I", images.UF2_END) for flags, at, body in ((0, 16, b"efgh"), (1, 90, b"none"), (0, 18, b"EFGH")))
ELF = b"\x7fELF\x01\x01\x01" + b"\0" * 9 + struct.pack("<HHIIIIIHHH", 2, 40, 1, 0x100, 52, 0, 0, 52, 32, 1) + b"\0" * 6 + struct.pack("<8I", 1, 84, 0x200, 0, 4, 4, 5, 4) + b"code"


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (HEX.encode(), ("intel-hex", 0x08000000, 0x08000001, 2, 0, 2, b"ab\xff\xffwxyz", None)),
        (f"{s_line(0, 0, 2, b'hi')}\n{s_line(1, 16, 2, b'abc')}\n{s_line(9, 16, 2, b'')}".encode(), ("s-record", 16, 16, 0, 0, 0, b"abc", None)),
        (UF2, ("uf2", 16, None, 0, 2, 0, b"efEFGH", None)),
        (ELF, ("elf", 0x200, 0x100, 0, 0, 0, b"code", None)),
        (HEX.replace("61", "62").encode(), ("intel-hex", 0, None, 0, 0, 0, HEX.replace("61", "62").encode(), "line 3: wrong checksum")),
        (f"{hex_line(0, 9, b'??')}\n{hex_line(2, 0, b'z')}\n{hex_line(0, 3, bytes([1, 2, 3, 4]))}".encode(), ("intel-hex", 2, 0x01020304, 0, 0, 0, b"z", None)),
        (f"{s_line(5, 3, 2, b'')}\nS10200FD\n{s_line(1, 16, 2, b'abc')}".encode(), ("s-record", 16, None, 0, 0, 0, b"abc", None)),
        (b"plain", ("raw", 0, None, 0, 0, 0, b"plain", None)),
        (None, ("raw", 0, None, 0, 0, 0, b"", None)),
    ],
)
def test_image_forms(spark, data, want):
    row = images.load(spark.createDataFrame([("f", data, 1)], "path string, content binary, extra int")).first()
    assert tuple(bytes(v) if isinstance(v, bytearray) else v for v in row[1:]) == want


def test_a_gap_too_long_is_refused():
    with pytest.raises(ValueError, match="gap"):
        images.flatten([(0, b"a"), (images.MAX_GAP + 2, b"b")])


def test_read_files(spark, tmp_path):
    for name, body in (("a.bin", b"x"), ("empty", b""), (".hidden", b"y")):
        (tmp_path / name).write_bytes(body)
    assert [r.path.rsplit("/", 1)[1] for r in images.read_files(spark, str(tmp_path)).collect()] == ["a.bin"]


def test_cpio(spark):
    end = entry("TRAILER!!!", 0)
    data = entry("etc", 0o040755) + entry("etc/a", 0o100644, b"old") + entry("b", 0o100644, b"", 9, 2) + entry("c", 0o100644, b"both", 9, 2) + entry("l", 0o120777, b"etc/a") + end + b"\0" * 8 + entry("etc/a", 0o100600, b"newer") + end
    rows = archives.cpio(spark.createDataFrame([("x", data), ("y", entry("../z", 0o100644, b"q") + b"\0" + entry("kept", 0o100644, b"k")), ("z", data[:150]), ("n", None)], "path string, content binary")).collect()
    got = {(r.path, r.name): (r.node_type, r.size, r.target, bytes(r.content) if r.content is not None else None) for r in rows if not r.error}
    assert got[("x", "etc/a")] == ("file", 5, None, b"newer")
    assert got[("x", "b")] == got[("x", "c")] == ("file", 4, None, b"both")
    assert got[("x", "l")] == ("symlink", 5, "etc/a", None)
    assert got[("x", "etc")][0] == "directory"
    assert [(r.path, r.error) for r in rows if r.error] == [("z", "cut off at 116")] and len([k for k in got if k[0] == "x"]) == 5
    assert [k for k in got if k[0] == "y"] == [("y", "kept")]


def test_control_blocks_of_null_and_empty_texts(spark):
    assert control.blocks(spark.createDataFrame([(1, None), (2, ""), (3, "no field\n")], "id int, text string"), "id", "text").count() == 0


def test_blank(spark):
    rows = [(1, b""), (2, b"\0\xff" * 50), (3, b"\xf0\x0f" * 50), (4, b"\0" * 98 + b"ab"), (5, b"\0" * 99 + b"a")]
    got = spark.createDataFrame(rows, "id int, content binary").select("id", stats.blank(F.col("content")).alias("b")).collect()
    assert {r.id for r in got if r.b} == {1, 2, 5}


def test_documents_agree(spark):
    rows = [("s", "zlib", "1.2", 0.9), ("s", "mit", "", 0.7), ("t", "mit", None, 0.5)]
    made = documents.cyclonedx(spark.createDataFrame(rows, "source string, name string, version string, confidence double"), "source")
    first = {r.source: json.loads(r.document) for r in made.collect()}
    second = {r.source: json.loads(r.document) for r in documents.spdx(made, "source").collect()}
    assert [(c["name"], c.get("version")) for c in first["s"]["components"]] == [("mit", None), ("zlib", "1.2")]
    for source, doc in first.items():
        assert [(c["name"], c.get("version")) for c in doc["components"]] == [(p["name"], p.get("versionInfo")) for p in second[source]["packages"]]
        assert len(second[source]["relationships"]) == len(doc["components"])


def test_replay_of_a_stream(spark, tmp_path):
    schema, state = "k string, v int, x string, gone boolean", {}
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "p", False), ("b", 5, "q", False)], schema).write.json(str(source))

    def apply(batch, _):
        state.update({r.k: (r.dead, r.x) for r in batch.collect()})

    def run():
        rows = spark.readStream.schema(schema).json(str(source))
        replay.replay(rows, ["k"], [F.col("v")], F.col("gone"), apply, str(tmp_path / "cp")).awaitTermination(60)

    run()
    spark.createDataFrame([("a", 3, "r", True), ("b", 4, "late", False)], schema).write.mode("append").json(str(source))
    run()
    assert state == {"a": (True, "r"), "b": (False, "q")}
