"""Scalar functions over names, versions, addresses and bytes, as columns. A null gives a null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.regexp_replace(value, "^\\s+|\\s+$", ""), F.lit(""))


def purl_base(purl: Column) -> Column:
    """A package URL without the version at its end."""
    return F.regexp_replace(purl, "@[^@/?#]+$", "")


def component_keys(name: Column, purl: Column) -> Column:
    """The keys a component may be found under, strongest first: its package URL without version, then its name; in lower case."""
    base, plain = F.lower(F.nullif(purl_base(purl), F.lit(""))), F.lower(text(name))
    return F.array_distinct(F.array_compact(F.array(base, plain)))


def component_key(name: Column, purl: Column) -> Column:
    """The strongest key; empty where there is none."""
    return F.coalesce(F.get(component_keys(name, purl), F.lit(0)), F.lit(""))


def depends(field: Column) -> Column:
    """Package names of a dependency field, in order: items between commas, up to a constraint or the first blank."""
    parts = F.transform(F.split(F.coalesce(field, F.lit("")), ","), lambda x: F.regexp_extract(x, "^\\s*([^\\s(]*)", 1))
    return F.filter(parts, lambda x: x != "")


def soname_key(name: Column) -> Column:
    """A library's file name up to and including its first ".so"; without one, the file name."""
    base = F.substring_index(name, "/", -1)
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(base, "^(.*?\\.so)", 1), F.lit("")), base), F.lit(""))


def bcd_date(value: Column) -> Column:
    """0xMMDDYYYY in binary-coded decimal as YYYY-MM-DD; null for what is no date between 1990 and 2099."""
    digits = F.lpad(F.hex(value), 8, "0")
    month, day, year = (F.substring(digits, a, n) for a, n in ((1, 2), (3, 2), (5, 4)))
    fits = digits.rlike("^[0-9]{8}$") & month.between("01", "12") & day.between("01", "31") & year.between("1990", "2099")
    return F.when(fits, F.concat_ws("-", year, month, day))


def cpuid_name(signature: Column) -> Column:
    """Display family, model and stepping as xx-xx-xx."""
    bits = lambda at, mask: F.shiftright(signature, at).bitwiseAND(mask)
    family, model = bits(8, 0xF), bits(4, 0xF)
    family = F.when(family == 0xF, family + bits(20, 0xFF)).otherwise(family)
    model = F.when(bits(8, 0xF).isin(0x6, 0xF), model + bits(16, 0xF) * 16).otherwise(model)
    return F.format_string("%02x-%02x-%02x", family, model, bits(0, 0xF))


def guid(data: Column) -> Column:
    """Sixteen bytes as the mixed-endian text of a GUID; other lengths as plain lower-case hex."""
    h = F.hex(data)
    pick = lambda *at: F.concat(*(F.substring(h, 2 * k + 1, 2) for k in at))
    whole = F.concat_ws("-", pick(3, 2, 1, 0), pick(5, 4), pick(7, 6), pick(8, 9), pick(*range(10, 16)))
    return F.when(F.length(data) == 16, whole).otherwise(F.lower(h))


def guid_key(data: Column) -> Column:
    """The bytes in lower-case hex with a space between."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def cstr(data: Column, at: Column, limit: int = 4096) -> Column:
    """The text from an offset to the next zero byte, as UTF-8 where it is that, else as Latin-1; null if none ends it within `limit` bytes."""
    h = F.hex(F.substring(data, at + 1, F.lit(limit)))
    ended = F.regexp_extract(h, "^((?:..)*?)00", 1)
    raw = F.when((at >= 0) & (at < F.length(data)) & h.rlike("^(?:..)*?00"), F.unhex(ended))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def utf16_text(data: Column) -> Column:
    """UTF-16LE text up to the first zero character; blank is null."""
    return text(F.substring_index(F.decode(data, "UTF-16LE"), "\0", 1))


def cpe23(declared: Column, version: Column) -> Column:
    """A CPE 2.2 URI as a 2.3 name; the version is the declared one, else the package's up to its last dash."""
    parts = F.split(F.substring(declared, 6, 1 << 20), ":")
    at = lambda k, other: F.coalesce(F.nullif(F.get(parts, F.lit(k)), F.lit("")), other)
    upstream = F.nullif(F.regexp_replace(F.coalesce(version, F.lit("")), "-[^-]*$", ""), F.lit(""))
    name = F.concat_ws(":", F.lit("cpe:2.3"), F.get(parts, F.lit(0)), at(1, F.lit("*")), at(2, F.lit("*")), at(3, F.coalesce(upstream, F.lit("*"))), F.lit("*:*:*:*:*:*:*"))
    return F.when(declared.startswith("cpe:/"), name)


def hex_offset(value: Column) -> Column:
    return F.format_string("0x%08X", value)


def column_name(index: Column) -> Column:
    """A sheet's column: 0 is A, 25 is Z, 26 is AA."""
    n, out, first = index.cast("bigint"), F.lit(None).cast("string"), 0
    for size in range(1, 8):  # names of so many letters stand one after another
        letters = F.concat(*(F.chr(F.lit(65) + F.pmod(F.floor((n - first) / 26 ** (size - 1 - k)), F.lit(26))) for k in range(size)))
        out = F.when((n >= first) & (n < first + 26**size), letters).otherwise(out)
        first += 26**size
    return out


def xml_escaped(value: Column) -> Column:
    """The text for an XML document: control characters that XML forbids go, four characters are escaped."""
    out = F.regexp_replace(value, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(ch), F.lit(name))
    return out


def spdx_id(*parts: Column) -> Column:
    """An SPDX reference from the parts that are not blank; other characters than letters, digits, dots and dashes become dashes."""
    joined = F.concat_ws("-", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))
    cleaned = F.regexp_replace(F.regexp_replace(joined, "[^A-Za-z0-9.-]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("SPDXRef-"), F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("Unnamed")))


def supplier(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Organization: "), F.nullif(name, F.lit(""))), F.lit("NOASSERTION"))


def version_token(value: Column) -> Column:
    """The first token that looks like a version of three numbers or more; null without one."""
    return F.nullif(F.regexp_extract(value, "\\bv?([0-9]+\\.[0-9]+(?:\\.[0-9]+)+(?:-[A-Za-z0-9]+)?)\\b", 1), F.lit(""))


def inverted_crc32(data: Column) -> Column:
    """The CRC-32 without its final inversion."""
    return F.lit(0xFFFFFFFF).cast("bigint").bitwiseXOR(F.crc32(data))


def byte_values(data: Column) -> Column:
    """The bytes as an array of numbers."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def xor8(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, b: acc.bitwiseXOR(b))


def sum8(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, b: (acc + b).bitwiseAND(0xFF))


def crc8(values: Column, poly: int, start: int = 0) -> Column:
    """CRC-8 with the polynomial, most significant bit first."""

    def step(acc: Column, b: Column) -> Column:
        # shifting a byte out depends on the byte alone: a table of 256 results, made from the rule
        return F.get(table, acc.bitwiseXOR(b))

    results = []
    for b in range(256):
        for _ in range(8):
            b = (b << 1 ^ poly) & 0xFF if b & 0x80 else b << 1 & 0xFF
        results.append(b)
    table = F.lit(results)
    return F.aggregate(values, F.lit(start), step)


def uefi_component_type(module: Column) -> Column:
    """The component type of a firmware module type."""
    drivers = ("driver", "peim", "smm", "combined-peim-driver", "combined-smm-dxe", "mm-standalone")
    return F.when(module.isin(*drivers), "device-driver").when(module == "application", "application").when(module == "firmware-volume-image", "container").when(module.isin("raw", "freeform"), "data").otherwise("firmware")


def url_stem(url: Column) -> Column:
    """The last part of a path, without its extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, "([^/?#]*)(?:[?#].*)?$", 1), "\\.[^.]*$", ""))
