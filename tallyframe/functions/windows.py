"""Trailing windows aligned to bucket starts, and name rules."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters allowed in names and client ids.
ALLOWED = r"A-Za-z0-9._~:/?@!$()*+;=-"


def bounds(as_of: int, width: int, buckets: int) -> tuple[int, int]:
    """First microsecond and end of the last `buckets` buckets of `width` seconds as of a time."""
    w = width * 1_000_000
    newest = as_of // w * w
    return newest - (buckets - 1) * w, newest + w


def in_window(as_of: int, width: int, buckets: int) -> Column:
    a, b = bounds(as_of, width, buckets)
    return (F.col("us") >= a) & (F.col("us") < b)


def valid(name) -> Column:
    """Whether a name holds no other character (an empty one doesn't)."""
    letters = string.ascii_letters + string.digits + ALLOWED.removeprefix("A-Za-z0-9")
    return F.translate(name, letters, "") == ""  # an expression takes some 5 us a value


def sanitised(name) -> Column:
    return F.regexp_replace(name, f"[^{ALLOWED}]", "_")
