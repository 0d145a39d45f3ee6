"""Inversions of a permutation, counted in blocks of places and blocks of values.

An inversion is a pair of rows of which the earlier one has the larger value. Two rows of one block of places are met in
that block's task, two of one block of values in that one's; for all others the blocks alone decide, and so the counts of
rows in the grid of blocks, as running sums by column and by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def count_inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j]: bit by bit from the highest, ones before zeros among values alike in all higher bits."""
    order = np.argsort(values, kind="stable")
    distinct = np.r_[False, values[order][1:] != values[order][:-1]] if len(values) else np.zeros(0, bool)
    left = np.empty(len(values), np.int64)
    left[order] = np.cumsum(distinct)  # equal values get equal numbers
    total = 0
    for bit in reversed(range(len(values).bit_length())):
        one = (left >> bit) & 1
        before = np.cumsum(one) - one
        alike = left >> (bit + 1)
        first = np.flatnonzero(np.r_[True, alike[1:] != alike[:-1]]) if len(alike) else np.zeros(0, np.int64)
        base = np.repeat(before[first], np.diff(np.r_[first, len(left)]))
        total += int((before - base)[one == 0].sum())
        left = left[np.argsort(left >> bit, kind="stable")]
    return total


def _in_order(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and blocks of places of a task's rows, by place."""
    order = np.argsort(rows.column("place").to_numpy(), kind="stable")
    return rows.column("value").to_numpy()[order], rows.column("at").to_numpy()[order]


def _inside(rows: pa.Table) -> pa.Table:
    """Inversions in a block of places."""
    return pa.table({"n": pa.array([count_inversions(_in_order(rows)[0])], pa.int64())})


def _beside(rows: pa.Table) -> pa.Table:
    """Inversions in a block of values between different blocks of places."""
    values, block = _in_order(rows)
    same = sum(count_inversions(part) for part in np.split(values, np.flatnonzero(np.diff(block)) + 1))
    return pa.table({"n": pa.array([count_inversions(values) - same], pa.int64())})


def inversions(permutation: DataFrame, n: int, block_rows: int = 1 << 16, max_blocks: int = 2048) -> DataFrame:
    """n, one row: inversions of permutation(place, value), both the numbers from 0 to n - 1.

    A block has block_rows rows, or more where there would be over max_blocks blocks; the grid has a row for each pair of
    blocks. No task holds more than a block or a line of the grid.
    """
    width = max(block_rows, -(-n // max_blocks))
    blocks = max(1, -(-n // width))
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    rows = staged(permutation.select("place", "value", cell("place").alias("at"), cell("value").alias("to")))
    inside = rows.groupBy("at").applyInArrow(_inside, "n long")
    beside = rows.groupBy("to").applyInArrow(_beside, "n long")
    counts = rows.groupBy("at", "to").agg(F.count("*").alias("c"))
    grid = rows.sparkSession.range(blocks * blocks).select(F.floor(F.col("id") / blocks).cast("long").alias("at"), (F.col("id") % blocks).alias("to"))
    grid = grid.join(counts, ["at", "to"], "left").select("at", "to", F.coalesce("c", F.lit(0)).alias("c"))
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("to").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("earlier", earlier)
    larger = F.coalesce(F.sum("earlier").over(Window.partitionBy("at").orderBy("to").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    between = grid.select((F.col("c").cast("decimal(19,0)") * larger.cast("decimal(19,0)")).alias("n"))
    parts = inside.unionByName(beside).select(F.col("n").cast("decimal(38,0)").alias("n")).unionByName(between.select(F.col("n").cast("decimal(38,0)").alias("n")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("decimal(38,0)")).alias("n"))
