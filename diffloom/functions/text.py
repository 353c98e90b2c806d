"""Rules for single texts: white space, display of raw bytes, C-style path quoting, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space when formatting is compared.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Well-formed UTF-8 sequences, written as one character for each byte.
UTF8 = r"[\x00-\x7F]+|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}"
#: One-letter escapes of quoted paths and the byte each stands for.
ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}


def let(value: Column, body) -> Column:
    """Binds a value once, so that it isn't computed again for each use."""
    return F.transform(F.array(value), body)[0]


def fenced(df):
    """The same rows behind a generator, so that costly columns are computed once and not again wherever they are used."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def byte_text(raw: Column) -> Column:
    """Bytes as a string with one character for each byte."""
    return F.decode(raw, "ISO-8859-1")


def raw_bytes(text: Column) -> Column:
    """The bytes of a string of byte_text."""
    return F.encode(text, "ISO-8859-1")


def well_formed(text: Column) -> Column:
    """Whether a string of byte_text is UTF-8."""
    return F.is_valid_utf8(raw_bytes(text))


def display(text: Column) -> Column:
    r"""A string of byte_text as UTF-8; bytes that are none stand as \xhh."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){UTF8}|."), F.lit(0))
    shown = F.transform(pieces, lambda p: F.when(well_formed(p), F.decode(raw_bytes(p), "UTF-8")).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(raw_bytes(p))))))
    return F.when(well_formed(text), F.decode(raw_bytes(text), "UTF-8")).otherwise(F.array_join(shown, ""))


def unquoted(value: Column) -> Column:
    """A path of byte_text without C-style quoting; null where the quoting is broken."""
    value = F.regexp_replace(value, r"\t$", "")
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-7]{1,3}|\\.|[^\\]+|\\$"), F.lit(0))

    def plain(p: Column) -> Column:
        rest = F.substring(p, F.lit(2), F.length(p))
        letter = F.coalesce(*[F.when(rest == k, F.lit(chr(v))) for k, v in ESCAPES.items()], rest)
        return F.when(~p.startswith("\\"), p).when(rest.rlike("^[0-7]"), F.char(F.conv(rest, 8, 10).cast("long"))).otherwise(letter)

    read = lambda found: F.when(~F.exists(found, lambda p: p == "\\"), F.array_join(F.transform(found, plain), ""))
    whole = value.endswith('"') & (F.length(value) > 1)
    return F.when(~value.startswith('"'), value).when(whole, let(pieces, read))


def quoted(path: Column, prefix: str = "") -> Column:
    """A path in C-style quotes, other than printable ASCII as three octal digits of each byte."""
    plain = r'[\x20\x21\x23-\x5B\x5D-\x7E]'
    # runs of printable characters stay whole
    pieces = F.regexp_extract_all(byte_text(F.encode(F.concat(F.lit(prefix), path), "UTF-8")), F.lit(f"(?s){plain}+|."), F.lit(0))
    octal = lambda c: F.concat(F.lit("\\"), F.lpad(F.conv(F.conv(F.hex(raw_bytes(c)), 16, 10), 10, 8), 3, "0"))
    return F.concat(F.lit('"'), F.array_join(F.transform(pieces, lambda c: F.when(c.rlike(f"^{plain}"), c).when(c.isin('"', "\\"), F.concat(F.lit("\\"), c)).otherwise(octal(c))), ""), F.lit('"'))


def ascii_json(text: Column) -> Column:
    r"""JSON text with what lies outside ASCII as \uhhhh, in pairs beyond the basic plane."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), r"([0-9a-f]{4})", r"\\u$1")
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[\x00-\x7F]"), p).otherwise(units(p))), "")


def canonical_json(value: Column) -> Column:
    """One line of compact ASCII JSON of a struct, nulls kept, with a line feed. The struct's fields are to be in order of their names (see sorted_fields)."""
    return F.concat(ascii_json(F.to_json(value, {"ignoreNullFields": "false"})), F.lit("\n"))


def sorted_fields(df, *names: str) -> Column:
    """A struct of these columns, or all, in order of their names."""
    return F.struct(*[F.col(c) for c in sorted(names or df.columns)])
