"""Vendor headers against files made here by their layout."""

from __future__ import annotations

import struct

from artilake.sources import wrappers


def trx(version, offsets, size, declared=None):
    head = b"HDR0" + struct.pack("<III", declared or size, 7, version << 16 | 1) + struct.pack(f"<{len(offsets)}I", *offsets)
    return head.ljust(size, b"\xaa")


def test_parts(spark):
    board = b"U12H\0\0"
    rows = {
        "trx1": trx(1, [28, 60, 0], 100),
        "trx2": trx(2, [32, 90, 50, 0], 120),
        "trx-cut": trx(1, [28, 60, 0], 100, 101),
        "trx-past": trx(1, [28, 100, 0], 100),
        "trx-none": trx(1, [0, 0, 0], 100),
        "trx-v3": trx(3, [28, 60, 0], 100),
        "chk": b"\x2a\x23\x24\x5e" + struct.pack(">IIII", 46, len(board), 5, 6).ljust(36, b"\0") + board + b"x" * 54,
        "chk-long": b"\x2a\x23\x24\x5e" + struct.pack(">I", 600) + b"\0" * 700,
        "shrs": (b"SHRS" + struct.pack(">II", 30, 29)).ljust(1756, b"\0") + b"p" * 30,
        "shrs-cut": (b"SHRS" + struct.pack(">II", 31, 29)).ljust(1756, b"\0") + b"p" * 30,
        "bneg": b"BNEG" + struct.pack("<IIII", 1, 1, 8, 4) + b"q" * 12,
        "bneg-one": b"BNEG" + struct.pack("<IIII", 1, 1, 8, 5) + b"q" * 12,
        "uimage": struct.pack(">IIIIIIIBBBB", 0x27051956, 0, 0, 9, 0x80000000, 0x80000400, 0, 5, 5, 2, 3) + b"Linux-5.10".ljust(32, b"\0") + b"k" * 9,
        "short": b"HDR0",
        "empty": b"",
        "null": None,
    }
    got = wrappers.parts(spark.createDataFrame(list(rows.items()), "path string, content binary")).collect()
    assert sorted((r.path, r.format, r.part, r.offset, r.length) for r in got) == [
        ("bneg", "bneg", 0, 20, 8),
        ("bneg", "bneg", 1, 28, 4),
        ("bneg-one", "bneg", 0, 20, 8),
        ("chk", "chk", 0, 46, 54),
        ("shrs", "shrs", 0, 1756, 30),
        ("trx1", "trx", 0, 28, 32),
        ("trx1", "trx", 1, 60, 40),
        ("trx2", "trx", 0, 32, 18),
        ("trx2", "trx", 1, 90, 30),
        ("trx2", "trx", 2, 50, 70),
        ("uimage", "uimage", 0, 64, 9),
    ]
    detail = {r.path: r.detail for r in got}
    assert detail["chk"] == {"board": "U12H", "kernel_length": "5", "rootfs_length": "6"}
    assert detail["trx1"] == {"version": "1", "crc32": "7", "flags": "1"}
    assert detail["uimage"]["name"] == "Linux-5.10" and detail["uimage"]["load_address"] == str(0x80000000) and detail["uimage"]["compression"] == "3"


def chk(payload):
    return (b"\x2a\x23\x24\x5e" + struct.pack(">III", 40, 0, 0)).ljust(40, b"\0") + payload


def frm(payload, version=3):
    return b"*FRM" + struct.pack(">I", version) + struct.pack("<I", 16 + len(payload)) + b"\0" * 4 + payload


def test_chain(spark):
    rows = {
        "nested": chk(frm(trx(1, [28, 60, 0], 100))),
        "five": chk(chk(chk(chk(chk(b"x"))))),
        "frm-long": frm(b"abc") + b"d",
        "frm-empty": frm(b""),
        "trx": trx(1, [28, 60, 0], 100),
        "uimage": struct.pack(">I", 0x27051956).ljust(70, b"\0"),
        "empty": b"",
        "null": None,
    }
    got = wrappers.chain(spark.createDataFrame(list(rows.items()), "path string, content binary")).collect()
    assert sorted((r.path, r.level, r["at"], r.format, [(p.offset, p.length) for p in r.parts]) for r in got) == [
        ("five", 0, 0, "chk", [(40, 161)]),
        ("five", 1, 40, "chk", [(80, 121)]),
        ("five", 2, 80, "chk", [(120, 81)]),
        ("five", 3, 120, "chk", [(160, 41)]),
        ("frm-empty", 0, 0, "frm", [(16, 0)]),
        ("nested", 0, 0, "chk", [(40, 116)]),
        ("nested", 1, 40, "frm", [(56, 100)]),
        ("nested", 2, 56, "trx", [(84, 32), (116, 40)]),
        ("trx", 0, 0, "trx", [(28, 32), (60, 40)]),
    ]
    assert {r.detail["version"] for r in got if r.format == "frm"} == {"3"}


def block(kind, body, size=None):
    return body + b"FWx0" + struct.pack(">IB3xI", 9, kind, 16 + len(body) if size is None else size)


def test_trailers(spark):
    image = b"i" * 50
    rows = {
        "both": image + block(1, b'\0{"version": {"dist": "x"}}\0') + block(0, b"sig"),
        "two": image + block(1, b'{"a": 1}') + block(1, b'{"a": 2}'),
        "two-bad": image + block(1, b"{") + block(1, b'{"a": 2}'),
        "list": image + block(1, b"[1]"),
        "not-utf8": image + block(1, b'{"a": "\xff"}'),
        "cut": image + block(1, b"{}", 80),
        "small": image + block(1, b"{}", 15),
        "only": block(0, b""),
        "ten": b"".join(block(0, b"s") for _ in range(10)),
        "none": image,
        "short": b"FWx0",
        "null": None,
    }
    got = wrappers.metadata(spark.createDataFrame(list(rows.items()), "path string, content binary")).selectExpr("path", "start", "to_json(metadata) as m", "signature_block").collect()
    assert sorted((r.path, r.start, r.m, r.signature_block) for r in got) == [
        ("both", 50, '{"version":{"dist":"x"}}', True),
        ("list", 50, None, False),
        ("not-utf8", 50, None, False),
        ("only", 0, None, True),
        ("ten", 17, None, True),
        ("two", 50, '{"a":1}', False),
        ("two-bad", 50, None, False),
    ]
