"""Scalar functions, package databases, packs and vendor documents against answers written down by hand."""

import json

import pytest
from pyspark.sql import functions as F

from artilake.functions import scalars
from artilake.operators import folds, layout, magics, packs, signatures
from artilake.plans import relations
from artilake.sources import control, vendor_documents


def values(spark, make, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], schema).coalesce(1).select(make).collect()]


def test_names(spark):
    x = F.col("x")
    assert values(spark, scalars.purl_base(x), ["pkg:npm/@angular/core@1.0", "pkg:npm/left-pad", "pkg:deb/a@1?arch=x", None]) == ["pkg:npm/@angular/core", "pkg:npm/left-pad", "pkg:deb/a@1?arch=x", None]
    assert values(spark, scalars.soname_key(x), ["/lib/libssl.so.1.1", "libcrypto.so", "busybox", "", None]) == ["libssl.so", "libcrypto.so", "busybox", None, None]
    assert values(spark, scalars.depends(x), ["a (>=1) | b, c", "libc6:any, ,d", "", None]) == [["a", "c"], ["libc6:any", "d"], [], []]
    assert values(spark, scalars.text(x), [" a ", " \t", "", None]) == ["a", None, None, None]
    assert values(spark, scalars.xml_escaped(x), ["<a & \"b\">\x01\t'"]) == ["&lt;a &amp; &quot;b&quot;&gt;\t'"]
    assert values(spark, scalars.version_token(x), ["littlefs v2.8.1", "v2.8", "x1.2.3", "1.2.3-rc1 9.9.9"]) == ["2.8.1", None, None, "1.2.3-rc1"]


def test_numbers(spark):
    x = F.col("x")
    assert values(spark, scalars.bcd_date(x), [0x01172023, 0x99999999, 0x12312100, 0x0A012020, None], "x bigint") == ["2023-01-17", None, None, None, None]
    assert values(spark, scalars.cpuid_name(x), [0x806EC, 0x906EA, 0x00F12], "x bigint") == ["06-8e-0c", "06-9e-0a", "0f-01-02"]
    assert values(spark, scalars.column_name(x), [0, 25, 26, 701, 702, 18277, 18278, 16383], "x bigint") == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "XFD"]
    assert values(spark, scalars.hex_offset(x), [0, 0x3F1A80, 0x123456789], "x bigint") == ["0x00000000", "0x003F1A80", "0x123456789"]


def test_column_names_of_five_letters_and_more(spark):
    def name(k):
        return name(k // 26 - 1) + chr(65 + k % 26) if k >= 0 else ""

    at = [475253, 475254, 475255, 599999, 5999999, 12356629, 12356630]
    got = values(spark, scalars.column_name(F.col("x")), at, "x bigint")
    assert got == [name(k) for k in at] and got[:3] == ["ZZZZ", "AAAAA", "AAAAB"]


def test_bytes(spark):
    x = F.col("x")
    assert values(spark, scalars.guid(x), [bytes(range(16)), b"ab"], "x binary") == ["03020100-0504-0706-0809-0A0B0C0D0E0F", "6162"]
    assert values(spark, scalars.guid_key(x), [b"\x0a\xff", b""], "x binary") == ["0a ff", ""]
    assert values(spark, scalars.cstr(x, F.lit(1)), [b"xabc\0d", b"x\xe9\0", b"x\xc3\xa9\0", b"xabc", b"x"], "x binary") == ["abc", "\u00e9", "\u00e9", None, None]
    assert values(spark, scalars.utf16_text(x), ["hi\0x".encode("utf-16-le"), b"\0\0"], "x binary") == ["hi", None]
    b = scalars.byte_values(x)
    assert values(spark, scalars.crc8(b, 0x07), [b"123456789"], "x binary") == [0xF4] and values(spark, scalars.crc8(b, 0x31), [b"123456789"], "x binary") == [0xA2]
    assert values(spark, scalars.inverted_crc32(x), [b"123456789"], "x binary") == [0xCBF43926 ^ 0xFFFFFFFF]


def test_control_blocks(spark):
    text = "Package: busybox\nVersion: 1.35\nStatus: install ok installed\nDepends: libc,\n libcrypt\n \t\nPackage: gone\nVersion: 2\nStatus: deinstall ok\n\nVersion: 3\n\nPackage: curl\r\nVersion: 7\r\nVersion: 8\r\nnot a field\n"
    got = control.packages(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").collect()
    assert [tuple(r) for r in got] == [(1, "busybox", "1.35", None, "libc, libcrypt"), (1, "curl", "8", None, None)]


def test_control_fields_are_parsed_once(spark):
    texts = ["A: 1\nB:\t2 \n b\nA: 3\nno field\n-C: 4\n", "A: x\u2028\nB: x\u2028y\nC: \u2028\u2028\nD: d\u0085\r\nE:\n\tlast:", None, "A :1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [(r.id, dict(r.fields)) for r in control.blocks(rows, "id", "text").orderBy("id").collect()] == [(0, {"A": "3", "B": "2  b"}), (1, {"A": "x", "D": "d", "E": "last:"})]
    plan = control.packages(rows, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z0-9-]*)") <= 2  # keys and values; filters do not repeat the parse


def test_package_controls_parse_each_text_once(spark):
    plan = relations.package_controls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z0-9-]*)") <= 6  # three tables of texts, keys and values of each


def test_package_controls_find_keys_and_values_in_one_pass(spark):
    plan = relations.package_controls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z0-9-]*)") == 2  # one pass over the databases, one over the control records, old and new together


def test_vendor_documents(spark):
    cdx = {"bomFormat": "CycloneDX", "components": [{"name": " zlib ", "version": "", "licenses": [{"license": {"name": "Zlib"}}, {"expression": "MIT"}, {}], "supplier": {"name": "S"}}, {"name": " "}, {"version": "1"}]}
    spdx = {"spdxVersion": "SPDX-2.3", "packages": [{"name": "a", "versionInfo": "1", "supplier": "Organization: X Y", "licenseConcluded": "NOASSERTION", "licenseDeclared": "MIT", "summary": "s", "externalRefs": [{"referenceType": "cpe23Type", "referenceLocator": "c"}]}]}
    docs = spark.createDataFrame([("c", json.dumps(cdx)), ("s", json.dumps(spdx)), ("x", "{}"), ("y", "no"), ("z", None)], "id string, text string")
    got = [tuple(r) for r in vendor_documents.components(docs, "id", "text").orderBy("id").collect()]
    assert got == [("c", "cyclonedx", 0, "zlib", None, None, None, "library", ["Zlib", "MIT"], "S", None), ("s", "spdx", 0, "a", "1", None, "c", "library", ["MIT"], "X Y", "s")]
    assert {r.id: r.error for r in vendor_documents.problems(docs, "id", "text").collect()} == {"x": "neither CycloneDX nor SPDX", "y": "not JSON", "z": "not JSON"}


def signature(name, regex="a(b)", **more):
    return {"name": name, "supplier": "S", "type": "library", "purl": "pkg:generic/" + name, "description": "d", "patterns": [{"regex": regex, "weight": 0.5, "vgroup": 1}]} | more


def test_packs(spark, tmp_path):
    def pack(folder, file, *signatures_):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / file).write_text(json.dumps({"signatures": signatures_}))

    pack("a", "one.json", signature("x"), signature("y"))
    pack("b", "two.json", signature("x", "c(d)"), signature("z"))
    path = packs.search_path(str(tmp_path / "a"), None, [str(tmp_path / "b"), str(tmp_path / "none")])
    assert [(n, p[0][0]) for n, _, p in packs.load(spark, path)] == [("x", "c(d)"), ("y", "a(b)"), ("z", "a(b)")]
    assert packs.names(packs.read(spark, path)).first().packs == ["one", "two"]
    pack("c", "bad.json", signature("v", "a("))
    with pytest.raises(packs.PackError, match="does not compile"):
        packs.load(spark, [str(tmp_path / "c")])
    pack("d", "1.json", signature("w"))
    pack("d", "2.json", signature("w"))
    with pytest.raises(packs.PackError, match="twice"):
        packs.load(spark, [str(tmp_path / "d")])
    with pytest.raises(packs.PackError, match="no signature packs"):
        packs.load(spark, [str(tmp_path / "none")])


def test_strings_give_versions_first(spark):
    pack = [("lib", "", [("lib ?([0-9.]*)", 0.5, 1), ("LIB", 0.9, 0)]), ("fs", "", [("fs v[0-9.]+", 0.4, 0)])]
    rows = spark.createDataFrame([(1, 5, "lib"), (1, 9, "lib 2.1"), (1, 12, "LIB"), (1, 20, "fs v1.2.3")], "id int, offset bigint, text string")
    got = {r.name: tuple(r)[2:] for r in signatures.match_strings(rows, pack).collect()}
    assert got == {"lib": (0.95, "2.1", False, "9:lib 2.1 | 12:LIB"), "fs": (0.4, "1.2.3", True, "20:fs v1.2.3")}


def test_folds_depend_on_order(spark):
    rows = spark.createDataFrame([("i", "a", "/1", 0.9, None), ("i", "a", "/2", 0.5, "1"), ("i", "a", "/3", 0.6, None)], "g string, name string, path string, confidence double, version string")
    assert tuple(folds.fold_files(rows, "g", "path").first()) == ("i", "a", 0.6, None, ["/1", "/2", "/3"])
    assert tuple(folds.merge_segments(rows, "g", "confidence", "path").first())[3] == "1"


def test_claims_and_magics(spark):
    claims = spark.createDataFrame([("g", 10, 20), ("g", 12, 14), ("g", 30, 30)], "g string, s bigint, e bigint")
    found = spark.createDataFrame([("g", k) for k in (9, 10, 15, 19, 20, 30)] + [("h", 15)], "g string, at bigint")
    assert sorted((r.g, r.at) for r in layout.unclaimed(found, claims, "g", "at", "s", "e").collect()) == [("g", 9), ("g", 20), ("g", 30), ("h", 15)]
    data = b"MZ" + b"hsqs" + b"\0" * 36 + (40).to_bytes(4, "little") + b"hsqs" + b"\0" * 36 + (9999).to_bytes(4, "little")
    got = {r.label: (r.raw_hits, r.validated_hits, r.offsets) for r in magics.scan(spark.createDataFrame([(1, data), (2, None), (3, b"")], "id int, data binary"), "id", "data").collect()}
    assert got == {"PE/DOS": (1, 0, [0]), "SquashFS little-endian": (2, 1, [2])}
