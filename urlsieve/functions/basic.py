"""Small helpers shared by the other column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlsieve.constants import WHITESPACE

# Any character, but not the second half of a surrogate pair.
CHAR_START = r"[^\x{DC00}-\x{DFFF}]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column) -> Column:
    """Unicode strip; Spark's plain ``trim`` only removes U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def count_text(c: Column, text: str) -> Column:
    """Non-overlapping occurrences of a literal, without building arrays."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))
    return gone if len(text) == 1 else (gone / F.lit(len(text))).cast("int")


def count_any(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are one of ``chars``."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def round4(c: Column) -> Column:
    return F.bround(c, 4)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, or 0 when the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def md5_bucket(seed, key: Column, buckets: int = 100) -> Column:
    """Deterministic bucket of a key; any engine with md5 gets the same number."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
