"""Natural order of strings, and lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits to which runs of digits are padded.
WIDTH = 20


def natural_key(c: Column) -> Column:
    """Sorts a2 before a10: every run of digits is padded on the left with zeros to WIDTH."""
    spread = F.regexp_replace(c, r"([0-9]+)", "0" * WIDTH + "$1")
    return F.regexp_replace(spread, r"0*([0-9]{%d})(?![0-9])" % WIDTH, "$1")


def natural_order(c: Column) -> Column:
    """Natural, case- and accent-insensitive sort key."""
    return F.collate(natural_key(c), "UNICODE_CI_AI")


def number(c: Column) -> Column:
    """A number, or a string that holds one; else null."""
    return c.try_cast("double")
