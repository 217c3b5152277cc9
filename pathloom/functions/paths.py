"""Scalar functions on paths, values, references and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -(1 << 63)
#: Fixed value: the link of a reference.
LINK = "https://archive.softwareheritage.org/browse/revision/REF/#swh-revision-changes"
#: The form of an ISO time, and the first second after the last Unix time.
ISO = r"^(20[0-9]{2}|19[7-9][0-9])-(0[1-9]|1[0-2])-(3[0-1]|[0-2][0-9])T(2[0-3]|[0-1][0-9]):([0-5][0-9]):([0-5][0-9])Z\z"
UNIX_END = 4102444800


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_path(path: str | Column) -> Column:
    """Labels in reverse order: ``/a/b/c`` gives ``c/b/a/``, ``/a/b/`` gives ``/b/a/``."""
    labels = F.split(_col(path), "/", -1)
    last = F.element_at(labels, -1)
    before = F.reverse(F.filter(F.slice(labels, 1, F.size(labels) - 1), lambda x: x != ""))
    return F.concat(F.array_join(F.concat(F.array(last), before), "/"), F.lit("/"))


def unreverse_path(path: str | Column) -> Column:
    """The path that reverse_path() turned around (without empty labels)."""
    labels = F.split(_col(path), "/", -1)
    first = F.element_at(labels, 1)
    rest = F.reverse(F.slice(labels, 2, F.size(labels) - 2))
    return F.concat(F.lit("/"), F.array_join(F.concat(rest, F.array(first)), "/"))


def labels(path: str | Column) -> Column:
    """Labels of a path without its first character; empty labels at the end don't count."""
    rest = F.regexp_replace(F.substring(_col(path), 2, 1 << 30), "/+$", "")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "/", -1))


def depth(path: str | Column) -> Column:
    return F.size(labels(path))


def encode_value(value: str | Column) -> Column:
    """16 hex digits whose order as text is the order of the numbers."""
    return F.lpad(F.hex(_col(value).bitwiseXOR(F.lit(LOWEST))), 16, "0")


def decode_value(code: str | Column) -> Column:
    """The number of an encoded value: two halves, and the sign bit turned back."""
    code = _col(code)
    high = F.conv(F.substring(code, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(code, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(LOWEST))


def encode_path(path: str | Column) -> Column:
    """Bytes of a path and a closing zero."""
    return F.concat(F.encode(_col(path), "UTF-8"), F.lit(bytearray(b"\0")))


#: The bytes that stand for a separator and a star in encoded keys; no UTF-8 text has them.
SEPARATOR_BYTE, STAR_BYTE = "FF", "FD"


def _hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def key_path(path: str | Column) -> Column:
    """Bytes of a path in a key: its labels with SEPARATOR_BYTE between them, and a closing zero."""
    return F.unhex(F.concat(F.array_join(F.transform(F.split(_col(path), "/", -1), _hex), SEPARATOR_BYTE), F.lit("00")))


def decode_path(encoded: str | Column) -> Column:
    """The path of key_path()'s bytes."""
    code = F.hex(_col(encoded))
    pairs = F.regexp_replace(F.substring(code, F.lit(1), F.length(code) - 2), "(..)", "$1 ")
    labels = F.transform(F.split(pairs, SEPARATOR_BYTE + " ", -1), lambda x: F.decode(F.unhex(F.replace(x, F.lit(" "), F.lit(""))), "UTF-8"))
    return F.array_join(labels, "/")


def decode_key_path(encoded: str | Column, reversed_: bool = False) -> Column:
    """The path of a key's bytes, turned back if it was stored reversed."""
    path = decode_path(encoded)
    return unreverse_path(path) if reversed_ else path


def key_pattern(pattern: str | Column) -> Column:
    """Bytes of a pattern in a search key, without a closing zero: a star is STAR_BYTE, an escaped character itself."""
    # Escapes first become pairs that no separator or star is left in.
    parts = F.regexp_extract_all(_col(pattern), F.lit(r"(?s)(\\.|[^\\]|\\$)"), F.lit(0))
    one = lambda x: F.when(x == "/", SEPARATOR_BYTE).when(x == "*", STAR_BYTE).when((F.length(x) == 2) & x.startswith("\\"), _hex(F.substring(x, 2, 1))).otherwise(_hex(x))
    return F.unhex(F.array_join(F.transform(parts, one), ""))


def value_bytes(value: str | Column) -> Column:
    """The eight bytes of encode_value()."""
    return F.unhex(encode_value(value))


def encode_key(path: str | Column = "path", value: str | Column = "value", ref: str | Column = "ref") -> Column:
    """A key as bytes: struct (path, value, ref)."""
    return F.struct(key_path(path).alias("path"), value_bytes(value).alias("value"), ref_bytes(ref).alias("ref"))


def encode_search_key(pattern: str | Column, low: str | Column, high: str | Column, reversed_: bool = False) -> Column:
    """A query as bytes: struct (path, low, high); reversed_ turns the pattern's labels around first."""
    pattern = reverse_path(pattern) if reversed_ else _col(pattern)
    return F.struct(key_pattern(pattern).alias("path"), value_bytes(low).alias("low"), value_bytes(high).alias("high"))


#: Names of the index files by direction.
INDEX_NAMES = {False: "index_forward.bin", True: "index_backward.bin"}


def index_name(reversed_: bool) -> str:
    return INDEX_NAMES[reversed_]


#: Units of byte counts, largest first.
UNITS = (("TB", 10**12), ("GB", 10**9), ("MB", 10**6))


def byte_text(n: str | Column) -> Column:
    """A byte count in its largest whole unit, cut off: 2999999 is "2 MB"; below a megabyte in bytes."""
    n = _col(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in reversed(UNITS):
        out = F.when(n >= size, F.concat(F.floor(n / F.lit(size)).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def path_size(path: str | Column) -> Column:
    return F.octet_length(_col(path)) + 1


def pattern_size(pattern: str | Column) -> Column:
    """Encoded size of a pattern: an escape and its character are one."""
    return F.octet_length(F.regexp_replace(_col(pattern), r"(?s)\\(.)", "$1")) + 1


def key_size(path: str | Column) -> Column:
    """Path bytes, eight for the value and twenty for the reference."""
    return F.octet_length(_col(path)) + 28


def pack_sizes(path_length: str | Column, value_length: str | Column) -> Column:
    """Twelve bits of path length and four of value length."""
    return F.shiftleft(_col(path_length).cast("int"), 4).bitwiseOR(_col(value_length).cast("int").bitwiseAND(F.lit(15)))


def unpack_sizes(packed: str | Column) -> tuple[Column, Column]:
    packed = _col(packed)
    return F.shiftright(packed, 4), packed.bitwiseAND(F.lit(15))


def ref_bytes(ref: str | Column) -> Column:
    """Twenty bytes of a reference; anything but 40 hex digits raises."""
    ref = _col(ref)
    return F.when(F.rlike(ref, F.lit(r"^[0-9A-Fa-f]{40}\z")), F.unhex(ref)).otherwise(F.raise_error(F.concat(F.lit("not a reference: "), F.coalesce(ref, F.lit("null")))).cast("binary"))


def ref_text(ref: str | Column) -> Column:
    return F.lower(F.hex(_col(ref)))


def is_iso(text: str | Column) -> Column:
    return F.rlike(_col(text), F.lit(ISO))


def is_unix(text: str | Column) -> Column:
    """Digits only, below UNIX_END."""
    text = _col(text)
    return F.coalesce(F.rlike(text, F.lit(r"^[0-9]+\z")) & (text.try_cast("bigint") < UNIX_END), F.lit(False))


def iso_to_unix(text: str | Column) -> Column:
    """Seconds of an ISO time in UTC; another form raises."""
    text = _col(text)
    parsed = F.unix_seconds(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssX"))
    return F.when(is_iso(text), parsed).otherwise(F.raise_error(F.lit("not an ISO time")).cast("bigint"))


def unix_to_iso(text: str | Column) -> Column:
    """ISO time in UTC of digits; others raise. The session's time zone must be UTC."""
    text = _col(text)
    made = F.date_format(F.timestamp_seconds(text.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(is_unix(text), made).otherwise(F.raise_error(F.lit("not a Unix time")).cast("string"))


def is_direction(text: str | Column) -> Column:
    return _col(text).isin("0", "1", "auto")


def create_link(ref: str | Column, template: str = LINK) -> Column:
    before, _, after = template.partition("REF")
    return F.concat(F.lit(before), _col(ref), F.lit(after))


def replace_string(subject: str | Column, search: str, replacement: str) -> Column:
    return F.replace(_col(subject), F.lit(search), F.lit(replacement))


def alternate(dim: str | Column) -> Column:
    """The other dimension; a leaf has none."""
    dim = _col(dim)
    return F.when(dim == "PATH", "VALUE").when(dim == "VALUE", "PATH")
