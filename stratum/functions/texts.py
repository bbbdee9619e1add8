"""Texts and figures: telling text from bytes, line ends, sizes for reading, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the size bins, exclusive (fixed values); the last bin has none.
SIZE_BINS = (64 << 10, 256 << 10, 1 << 20, 4 << 20, 16 << 20)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_binary(content: Column | str) -> Column:
    """By the first 4096 bytes: a zero byte, or control bytes (below 9, or 14 to 31) above a tenth, rounded down."""
    head = F.hex(F.substring(col(content), 1, 4096))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    n = F.floor(F.length(head) / 2)
    control = F.regexp_count(pairs, F.lit("(0[1-8]|0E|0F|1[0-9A-F]) "))
    return F.coalesce(pairs.contains("00 ") | (control > F.floor(n / 10)), F.lit(False))


def normalize_lines(text: Column | str, trim_end: bool = False) -> Column:
    out = F.regexp_replace(col(text), "\r\n|\r", "\n")
    return F.regexp_replace(out, r"(?m)[^\S\n]+$", "") if trim_end else out


def to_crlf(text: Column | str) -> Column:
    return F.regexp_replace(normalize_lines(text), "\n", "\r\n")


def size_bin(size: Column | str) -> Column:
    c, out = col(size), F.lit(len(SIZE_BINS))
    for i, most in reversed(list(enumerate(SIZE_BINS))):
        out = F.when(c < most, i).otherwise(out)
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(F.coalesce(col(b), F.lit(0)) == 0, 0.0).otherwise(col(a).cast("double") / col(b))


def mebibytes(size: Column | str) -> Column:
    return col(size) / F.lit(1048576.0)


def humanize(size: Column | str) -> Column:
    """With a unit, base 1024, at most two decimals."""
    c = col(size).cast("double")
    out = F.lit(None).cast("string")
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c / 1024.0**i), r"0+$", ""), r"\.$", "")
        out = F.when(c < 1024.0 ** (i + 1), F.concat(shown, F.lit(f" {unit}"))).otherwise(out if i < 4 else F.concat(shown, F.lit(" TB")))
    return out


def note_append(old: Column | str, more: Column | str) -> Column:
    """``more`` after ``old``, on a new line."""
    old, more = col(old), col(more)
    return F.when(F.coalesce(old, F.lit("")) == "", more).when(old.endswith("\n") | old.endswith("\r"), F.concat(old, more)).otherwise(F.concat(old, F.lit("\n"), more))
