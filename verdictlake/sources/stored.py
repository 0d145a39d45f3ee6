"""The tables of a store, by the names and columns that reports read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .store import Store


@dataclass(frozen=True)
class StoreTables:
    """Lazy preference tables over a store, as `PreferenceTables` has them over general tables."""

    store: Store

    @property
    def prompts(self) -> DataFrame:
        return self.store.table("prompt").select("id", "text", "category", "tags")

    @property
    def responses(self) -> DataFrame:
        rows = self.store.table("response")
        return rows.select("id", "prompt_id", "model", "text", word_count("text").alias("n_words"), F.char_length("text").cast("long").alias("n_chars"), F.col("provenance.source").alias("source"))

    @property
    def annotators(self) -> DataFrame:
        return self.store.table("annotator").select("id", "kind", "display_name")

    @property
    def sessions(self) -> DataFrame:
        return self.store.table("session").drop("seq")

    @property
    def gold_pairs(self) -> DataFrame:
        return self.store.table("gold").select("id", "prompt_id", "better_response_id", "worse_response_id")

    @property
    def judgments(self) -> DataFrame:
        columns = ("id", "seq", "session_id", "annotator_id", "prompt_id", "left_response_id", "right_response_id", "choice", "pair_kind", "repeat_of")
        return self.store.table("pairwise").select(*columns)

    @property
    def ranked(self) -> DataFrame:
        return self.store.table("ranked").select("id", "annotator_id", "prompt_id", "ranking")
