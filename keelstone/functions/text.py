"""Scalar text functions over Columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
# Invisible code points that are dropped, and odd spaces that become a plain one.
INVISIBLE = "​‌‍⁠﻿­‎‏‪‫‬‭‮"
ODD_SPACES = "    　"


def utrim(c: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's trim only knows U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def urtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return text_or_empty(utrim(c)) == ""


def scrub_invisible(c: Column) -> Column:
    """Drop invisible code points, map odd spaces to U+0020."""
    return F.translate(c, ODD_SPACES + INVISIBLE, " " * len(ODD_SPACES))


def normalize_name(c: Column) -> Column:
    """Trimmed, without a closing "(...@...)" at the end, lower-cased."""
    t = utrim(text_or_empty(c))
    return F.lower(urtrim(F.regexp_replace(t, r"(?s)\([^(]*@[^(]*\)\z", "")))


def normalize_note_name(c: Column) -> Column:
    return F.lower(utrim(scrub_invisible(text_or_empty(c))))


def canonical_body(c: Column) -> Column:
    return utrim(scrub_invisible(text_or_empty(c)))


def theme_hash(c: Column) -> Column:
    """Eight hex digits of SHA-256, the short content name of a text."""
    return F.substring(F.sha2(c, 256), 1, 8)


def escape_xml(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def utf8_prefix(c: Column, n_bytes: Column) -> Column:
    """The longest prefix of at most n_bytes bytes that ends on a code point boundary."""
    raw = F.encode(c, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n_bytes - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(c) <= n_bytes, c).otherwise(F.coalesce(*cuts, F.lit("")))


def first_line_value(c: Column, key: str) -> Column:
    """Value of the first "key: value" line, null if there is none."""
    found = F.regexp_extract(c, rf"(?m)^{key}:\s*(.+)$", 1)
    return F.when(found != "", found)


def without_first_line(c: Column, key: str) -> Column:
    """The text without its first "key: value" line, trimmed."""
    return utrim(F.regexp_replace(c, rf"(?ms)\A(.*?)^{key}:\s*[^\n]+$", "$1"))


def front_matter_body(c: Column) -> Column:
    """What follows the first "---", trimmed; the whole text if there is none."""
    at = F.instr(c, "---")
    return utrim(F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise(c))


def stable_digest(*cols: Column) -> Column:
    """32 bytes that name a tuple of columns; null and "" differ, field borders count."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])), 256))
