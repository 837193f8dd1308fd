"""Headers that vendors put before an image, in the JVM: one row per part of a wrapped file.

Only the header's bytes are looked at and nothing is shuffled. A header whose sizes do not fit
the file is none; null and short contents give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
UIMAGE, TRX, CHK, SHRS, BNEG, FRM = b"\x27\x05\x19\x56", b"HDR0", b"\x2a\x23\x24\x5e", b"SHRS", b"BNEG", b"*FRM"
UIMAGE_HEADER, CHK_LEAST, CHK_MOST, CHK_BOARD_MOST, SHRS_HEADER, SHRS_TAIL, BNEG_HEADER, FRM_HEADER = 64, 40, 512, 64, 1756, 16, 20, 16
MOST_NESTED = 4
#: Trailers behind an image: their length, magic, largest block, most blocks, kinds.
TRAILER, TRAILER_MAGIC, TRAILER_BLOCK_MOST, MOST_TRAILERS, SIGNATURE, METADATA = 16, b"FWx0", 64 << 10, 9, 0, 1
MAX_BYTES = 512 << 20
TRX_NAMES = ("kernel", "root filesystem", "part 2", "part 3")
#: Slots for part offsets by version.
TRX_SLOTS = {1: 3, 2: 4}
PART = "array<struct<part:int,name:string,offset:bigint,length:bigint>>"


def number(content: Column, at: int, n: int = 4, little: bool = False) -> Column:
    """The unsigned number of n bytes at an offset; null past the end."""
    digits = F.hex(F.concat(*(F.substring(content, at + n - k, 1) for k in range(n))) if little else F.substring(content, at + 1, n))
    return F.when(F.length(digits) == 2 * n, F.conv(digits, 16, 10).cast("bigint"))


def text(content: Column, at: int, n: int | Column) -> Column:
    """The text up to the first zero byte."""
    raw = F.decode(F.substring(content, F.lit(at + 1), F.lit(n) if isinstance(n, int) else n.cast("int")), "ISO-8859-1")
    return F.nullif(F.trim(F.substring_index(raw, "\0", 1)), F.lit(""))


def _part(k: int, name: str, offset: Column, length: Column) -> Column:
    return F.struct(F.lit(k).alias("part"), F.lit(name).alias("name"), offset.cast("bigint").alias("offset"), length.cast("bigint").alias("length"))


def _found(form: str, header: Column, detail: dict[str, Column], parts: Column) -> Column:
    pairs = F.create_map(*(x for k, v in detail.items() for x in (F.lit(k), v.cast("string")))) if detail else F.expr("cast(map() as map<string,string>)")
    return F.struct(F.lit(form).alias("format"), header.cast("bigint").alias("header_length"), pairs.alias("detail"), parts.cast(PART).alias("parts"))


def _trx(c: Column, size: Column, version: int) -> Column:
    n, length = TRX_SLOTS[version], number(c, 4, little=True)
    header = 16 + 4 * n
    offsets = [number(c, 16 + 4 * k, little=True) for k in range(n)]
    parts = []
    for k, o in enumerate(offsets):
        ends = [F.when(later > o, later) for later in offsets[k + 1 :]] + [length]
        end = F.least(*ends) if len(ends) > 1 else length
        parts.append(F.when(o > 0, _part(k, TRX_NAMES[k], o, end - o)))
    fits = (number(c, 14, 2, little=True) == version) & (length <= F.least(size, F.lit(MAX_BYTES))) & (length >= header) & (F.greatest(*offsets) > 0)
    for o in offsets:
        fits &= (o == 0) | ((o >= header) & (o < length))
    detail = {"version": F.lit(version), "crc32": number(c, 8, little=True), "flags": number(c, 12, 2, little=True)}
    return F.when((F.substring(c, 1, 4) == F.lit(TRX)) & fits, _found("trx", F.lit(header), detail, F.array_compact(F.array(*parts))))


def _chk(c: Column, size: Column) -> Column:
    header, board = number(c, 4), number(c, 8)
    detail = {
        "board": F.when((board > 0) & (board <= CHK_BOARD_MOST) & (board + CHK_LEAST <= size), text(c, CHK_LEAST, board)),
        "kernel_length": number(c, 12),
        "rootfs_length": number(c, 16),
    }
    fits = (F.substring(c, 1, 4) == F.lit(CHK)) & (header >= CHK_LEAST) & (header <= F.least(size, F.lit(CHK_MOST)))
    return F.when(fits, _found("chk", header, detail, F.array(_part(0, "payload", header, size - header))))


def _shrs(c: Column, size: Column) -> Column:
    n = number(c, 4)
    fits = (F.substring(c, 1, 4) == F.lit(SHRS)) & (size >= SHRS_HEADER + SHRS_TAIL) & (n > 0) & (n <= MAX_BYTES) & (n + SHRS_HEADER <= size)
    return F.when(fits, _found("shrs", F.lit(SHRS_HEADER), {"decrypted_length": number(c, 8)}, F.array(_part(0, "payload", F.lit(SHRS_HEADER), n))))


def _bneg(c: Column, size: Column) -> Column:
    first, second = number(c, 12, little=True), number(c, 16, little=True)
    at = first + BNEG_HEADER
    parts = F.array_compact(F.array(_part(0, "part 0", F.lit(BNEG_HEADER), first), F.when((second > 0) & (at + second <= size), _part(1, "part 1", at, second))))
    return F.when((F.substring(c, 1, 4) == F.lit(BNEG)) & (first > 0) & (at <= size), _found("bneg", F.lit(BNEG_HEADER), {}, parts))


def _uimage(c: Column, size: Column) -> Column:
    detail = {"name": text(c, 32, 32), "load_address": number(c, 16), "entry_point": number(c, 20), "os": number(c, 28, 1), "architecture": number(c, 29, 1), "compression": number(c, 31, 1)}
    return F.when((F.substring(c, 1, 4) == F.lit(UIMAGE)) & (size >= UIMAGE_HEADER), _found("uimage", F.lit(UIMAGE_HEADER), detail, F.array(_part(0, "payload", F.lit(UIMAGE_HEADER), number(c, 12)))))


def _frm(c: Column, size: Column) -> Column:
    fits = (F.substring(c, 1, 4) == F.lit(FRM)) & (size >= FRM_HEADER) & (number(c, 8, little=True) == size)
    return F.when(fits, _found("frm", F.lit(FRM_HEADER), {"version": number(c, 4)}, F.array(_part(0, "payload", F.lit(FRM_HEADER), size - FRM_HEADER))))


def vendor_header(c: Column) -> Column:
    """The vendor's header that content begins with: format, header_length, detail, parts; null if there is none."""
    size = F.length(c).cast("bigint")
    return F.coalesce(_trx(c, size, 1), _trx(c, size, 2), _chk(c, size), _shrs(c, size), _bneg(c, size), _frm(c, size))


def parts(files: DataFrame) -> DataFrame:
    """path, format, header_length, detail, part, name, offset, length: the declared parts of each (path, content)."""
    c = F.col("content")
    found = F.coalesce(vendor_header(c), _uimage(c, F.length(c).cast("bigint")))
    return files.select("path", found.alias("_w")).where(F.col("_w").isNotNull()).select("path", "_w.format", "_w.header_length", "_w.detail", F.inline("_w.parts"))


def chain(files: DataFrame) -> DataFrame:
    """path, level, at, format, header_length, detail, parts: the headers of each (path, content), outermost first.

    A payload that begins with another vendor's header is looked into, MOST_NESTED headers at most;
    offsets are the file's. A payload begins behind its header, so no header is met twice.
    """
    rows = files.select("path", F.col("content").alias("_c"), F.lit(0).cast("bigint").alias("_at0"))
    for k in range(MOST_NESTED):
        at, found = F.col(f"_at{k}"), F.col(f"_w{k}")
        view = F.substring("_c", (at + 1).cast("int"), F.length("_c")) if k else F.col("_c")
        rows = rows.withColumn(f"_v{k}", F.when(at.isNotNull(), view)).withColumn(f"_w{k}", vendor_header(F.col(f"_v{k}")))
        inner = F.get(F.filter(found["parts"], lambda p: p["name"] == "payload"), F.lit(0))
        rows = rows.drop(f"_v{k}").withColumn(f"_at{k + 1}", at + inner["offset"])

    def level(k: int) -> Column:
        at, found = F.col(f"_at{k}"), F.col(f"_w{k}")
        moved = F.transform(found["parts"], lambda p: p.withField("offset", p["offset"] + at))
        return F.when(found.isNotNull(), F.struct(F.lit(k).alias("level"), at.alias("at"), found["format"].alias("format"), found["header_length"].alias("header_length"), found["detail"].alias("detail"), moved.alias("parts")))

    return rows.select("path", F.inline(F.array_compact(F.array(*(level(k) for k in range(MOST_NESTED))))))


def trailers(content: Column) -> Column:
    """The blocks that end an image, read backwards: start, metadata (a variant, null unless it is a JSON object), signature_block; null if there are none.

    Of several blocks with metadata the one nearest to the image's start counts. The blocks' checksums are not looked at.
    """
    start = F.struct(F.length(content).cast("bigint").alias("end"), F.lit(True).alias("goes"), F.expr("cast(array() as array<struct<kind:bigint,body:binary>>)").alias("blocks"))

    def step(state: Column, _: Column) -> Column:
        end = state["end"]
        at = (end - TRAILER).cast("int")
        size = number(content, at + 12, 4)
        fits = state["goes"] & (at >= 0) & F.coalesce((F.substring(content, at + 1, F.lit(4)) == F.lit(TRAILER_MAGIC)) & size.between(TRAILER, F.least(end, F.lit(TRAILER_BLOCK_MOST))), F.lit(False))
        block = F.struct(number(content, at + 8, 1).alias("kind"), F.substring(content, (end - size + 1).cast("int"), (size - TRAILER).cast("int")).alias("body"))
        return F.when(fits, F.struct((end - size).alias("end"), F.lit(True).alias("goes"), F.concat(state["blocks"], F.array(block)).alias("blocks"))).otherwise(F.struct(end.alias("end"), F.lit(False).alias("goes"), state["blocks"].alias("blocks")))

    def finish(state: Column) -> Column:
        body = F.try_element_at(F.filter(state["blocks"], lambda b: b["kind"] == METADATA), F.lit(-1))["body"]
        json = F.try_parse_json(F.btrim(F.try_validate_utf8(body.cast("string")), F.lit("\0")))
        fields = {"start": state["end"], "metadata": F.when(F.schema_of_variant(json).startswith("OBJECT"), json), "signature_block": F.exists(state["blocks"], lambda b: b["kind"] == SIGNATURE)}
        return F.when(F.size(state["blocks"]) > 0, F.struct(*(v.alias(k) for k, v in fields.items())))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_TRAILERS)), start, step, finish)


def metadata(files: DataFrame) -> DataFrame:
    """path, start, metadata, signature_block of each (path, content) that ends with such blocks."""
    return files.select("path", trailers(F.col("content")).alias("_t")).where(F.col("_t").isNotNull()).select("path", "_t.*")
