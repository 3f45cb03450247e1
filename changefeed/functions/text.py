"""Text that is valid UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_utf8(text: Column) -> Column:
    """Bytes that are not UTF-8 become U+FFFD; valid text, emoji included, is unchanged."""
    return F.make_valid_utf8(text)


def decode_bytes(raw: Column) -> Column:
    """BINARY read as UTF-8, bad sequences replaced by U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))
