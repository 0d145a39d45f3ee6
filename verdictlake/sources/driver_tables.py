"""Preference tables derived from general tables by integer rules, so that any engine derives the same ones.

Six documents, one of each model, are the responses to a prompt: those whose id leaves its number modulo the number of prompts,
which grows with the documents, so that every document but for the last few is compared. A prompt's text is that of a benchmark
item, in turn. Each event is a judgment of two responses to one prompt. Only ids, labels and events are read for judgments, never a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import padded, word_count

MODELS = 6
#: Digits of prompt, response and judgment ids.
WIDTH = 12
ANNOTATORS = 12


def _div(x: Column, n: Column | int) -> Column:
    return F.floor((x - x % n) / n).cast("long")


@dataclass(frozen=True)
class PreferenceTables:
    """Lazy preference tables over a folder of general tables; nothing is read before it is used."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_prompts(self) -> int:
        """One for every six documents, one at least; the count comes from file footers."""
        return max(1, self.table("documents").count() // MODELS)

    @property
    def prompts(self) -> DataFrame:
        """id, text. Item ids run from 0 on, so that each prompt has one of them."""
        items = self.table("benchmark").select("item_id", "text")
        numbers = self.spark.range(self.n_prompts).withColumn("item_id", F.col("id") % max(1, items.count()))
        return numbers.join(items, "item_id", "left").select(padded("p", F.col("id") + 1, WIDTH).alias("id"), "text")

    @property
    def responses(self) -> DataFrame:
        """id, prompt_id, model, doc_id, text, n_words, n_chars, source. Columns that aren't used aren't read."""
        doc = F.col("doc_id")
        return self.table("documents").select(
            padded("r", doc, WIDTH).alias("id"),
            padded("p", doc % self.n_prompts + 1, WIDTH).alias("prompt_id"),
            F.concat(F.lit("model-"), F.chr(F.lit(97) + _div(doc, self.n_prompts) % MODELS)).alias("model"),
            "doc_id",
            "text",
            word_count("text").alias("n_words"),
            F.char_length("text").cast("long").alias("n_chars"),
            F.lit("import").alias("source"),
        )

    @property
    def annotators(self) -> DataFrame:
        return self.spark.range(1, ANNOTATORS + 1).select(padded("ann-", F.col("id"), 2).alias("id"), F.lit("simulated").alias("kind"))

    @property
    def sessions(self) -> DataFrame:
        return self.annotators.select(F.concat(F.lit("s-"), "id").alias("id"), F.col("id").alias("annotator_id"), F.lit("import").alias("client"))

    @cached_property
    def _placed(self) -> DataFrame:
        n, k = self.n_prompts, MODELS
        event = F.col("event_id")
        q = _div(event, n)
        left = q % k
        ev = self.table("events").select(
            event.alias("seq"),
            (F.col("user_id") % ANNOTATORS).alias("number"),
            (event % n).alias("prompt_no"),
            left.alias("left_k"),
            ((left + 1 + _div(q, k) % (k - 1)) % k).alias("right_k"),
            ((event * 7919 + 13) % 100).alias("u"),
            "event_type",
            "value",
        )
        gap = F.col("right_k") - F.col("left_k")
        bar = F.when(F.col("number") == 9, F.lit(80)).when(F.col("number") == 7, F.lit(50)).when(F.col("number") == 5, 50 - 15 * gap).otherwise(50 + 9 * gap)
        choice = (
            F.when((F.col("event_type") == "error") & (F.col("value") < 5), "skip")
            .when((F.col("event_type") == "signup") & (F.abs(gap) == 1) & (F.col("value") < 20), "tie")
            .when(F.col("u") < bar, "left")
            .otherwise("right")
        )
        return ev.withColumns(
            {
                "annotator_id": padded("ann-", F.col("number") + 1, 2),
                "prompt_id": padded("p", F.col("prompt_no") + 1, WIDTH),
                "left_doc": F.col("left_k") * n + F.col("prompt_no"),
                "right_doc": F.col("right_k") * n + F.col("prompt_no"),
                "choice": choice,
            }
        )

    @cached_property
    def gold_pairs(self) -> DataFrame:
        """id, prompt_id, better_response_id, worse_response_id: compared pairs whose documents differ in quality."""
        labels = self.table("labels").select("doc_id", "quality").where("quality is not null")
        pairs = self._placed.select("prompt_id", F.least("left_doc", "right_doc").alias("a"), F.greatest("left_doc", "right_doc").alias("b")).distinct()
        x = labels.select(F.col("doc_id").alias("a"), F.col("quality").alias("qa"))
        y = labels.select(F.col("doc_id").alias("b"), F.col("quality").alias("qb"))
        found = pairs.join(x, "a").join(y, "b").where("qa <> qb")
        better = F.when(F.col("qa") > F.col("qb"), F.col("a")).otherwise(F.col("b"))
        return found.select(
            F.concat(F.lit("g-"), padded("r", F.col("a"), WIDTH), F.lit("-"), padded("r", F.col("b"), WIDTH)).alias("id"),
            "prompt_id",
            padded("r", better, WIDTH).alias("better_response_id"),
            padded("r", F.col("a") + F.col("b") - better, WIDTH).alias("worse_response_id"),
        )

    @cached_property
    def judgments(self) -> DataFrame:
        """id, seq, session_id, annotator_id, prompt_id, left/right_response_id, choice, pair_kind, repeat_of. Every event is
        one, but for later ones on a gold pair by the same annotator; a later one on another pair is a control of the one before."""
        rows = self._placed.select("seq", "annotator_id", "prompt_id", padded("r", F.col("left_doc"), WIDTH).alias("left_response_id"), padded("r", F.col("right_doc"), WIDTH).alias("right_response_id"), "choice")
        rows = rows.withColumns({"id": padded("j", F.col("seq"), WIDTH), "a_id": F.least("left_response_id", "right_response_id"), "b_id": F.greatest("left_response_id", "right_response_id")})
        same = Window.partitionBy("annotator_id", "prompt_id", "a_id", "b_id").orderBy("seq")
        rows = rows.withColumns({"turn": F.row_number().over(same), "before": F.lag("id").over(same)})
        gold = self.gold_pairs.select("prompt_id", F.least("better_response_id", "worse_response_id").alias("a_id"), F.greatest("better_response_id", "worse_response_id").alias("b_id"), F.lit(True).alias("is_gold"))
        rows = rows.join(gold, ["prompt_id", "a_id", "b_id"], "left")
        kind = F.when(F.col("is_gold"), F.when(F.col("turn") == 1, "gold")).otherwise(F.when(F.col("turn") == 1, "regular").otherwise("control"))
        rows = rows.withColumn("pair_kind", kind).where("pair_kind is not null")
        return rows.select(
            "id",
            "seq",
            F.concat(F.lit("s-"), "annotator_id").alias("session_id"),
            "annotator_id",
            "prompt_id",
            "left_response_id",
            "right_response_id",
            "choice",
            "pair_kind",
            F.when(F.col("pair_kind") == "control", F.col("before")).alias("repeat_of"),
        )

    @property
    def ranked(self) -> DataFrame:
        """id, annotator_id, prompt_id, ranking (best first): every event ranks all responses of its prompt as well."""
        n, k = self.n_prompts, MODELS
        rows = self._placed
        keys = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(((i * 37 + F.col("seq") * 11) % 101).alias("key"), i.alias("k"))))
        return rows.select(padded("k", F.col("seq"), WIDTH).alias("id"), "annotator_id", "prompt_id", F.transform(keys, lambda x: padded("r", x["k"] * n + F.col("prompt_no"), WIDTH)).alias("ranking"))
