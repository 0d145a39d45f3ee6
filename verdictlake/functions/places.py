"""Dense numbers over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in order, from 0: rows are dealt by ranges of the order, sorted inside and written out; a place is that in the
    partition plus the rows of the partitions before, of which there is one number each. Rows that are equal in all of
    order get theirs in any way."""
    spot = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the row in the lower 33
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", spot))
    part = F.shiftrightunsigned(F.col("_spot"), 33).alias("_part")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_before") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(offsets, "_part").withColumn(name, place).drop("_part", "_spot", "_before")
