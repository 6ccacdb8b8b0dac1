"""Label maps of the three corpus dialects; 1 = malicious, 0 = benign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlsieve.functions.basic import as_col, strip_ws


def _not_word(label: Column | str, word: str) -> Column:
    return (F.lower(strip_ws(as_col(label))) != F.lit(word)).cast("tinyint")


def label_a(label: Column | str) -> Column:
    """Anything but ``benign`` is malicious."""
    return _not_word(label, "benign")


def label_b(label: Column | str) -> Column:
    """Anything but ``good`` is malicious."""
    return _not_word(label, "good")


def label_c(label: Column | str) -> Column:
    """1 = legitimate in the source, so a number that truncates to 0 is malicious.

    Text that is no number counts as legitimate.
    """
    text = strip_ws(as_col(label))
    number = F.when(
        text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        text.try_cast("double"),
    )
    return F.coalesce((number > -1) & (number < 1), F.lit(False)).cast("tinyint")
