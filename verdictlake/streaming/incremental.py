"""Votes and position counts over a stream of judgments (append-only facts), as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.export import FilterConfig, votes_per_pair
from ..operators.quality import position_counts


def running_votes(judgments: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Votes of each pair over a streaming frame; use with output mode update or complete."""
    return votes_per_pair(judgments, config)


def running_positions(judgments: DataFrame) -> DataFrame:
    """Left, right, tie and skip counts of each annotator over a streaming frame."""
    return position_counts(judgments)


def start(frame: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the result in an in-memory table of this name (for reports; write to files or a table elsewhere)."""
    return frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
