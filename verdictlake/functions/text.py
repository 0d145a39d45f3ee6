"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(prefix: str, number: Column, width: int) -> Column:
    """prefix and the number with zeros before it."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("long").cast("string"), width, "0"))


def word_count(column: str) -> Column:
    """Words between runs of Unicode white space."""
    return F.size(F.filter(F.split(F.col(column), r"(?U)\s+"), lambda w: w != "")).cast("long")


def split_unit(salt: str, key: Column) -> Column:
    """A number from 0 to 1 made of the first eight bytes of a SHA-256 of salt and key."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
