"""From votes to training rows: decisions with drop reasons, leak-free splits, DPO, KTO and reward-model rows, card."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_unit
from .comparisons import canonical

REASONS = ("no_votes", "too_few_votes", "tie", "low_agreement")
SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class FilterConfig:
    min_votes: int = 1
    min_agreement: float = 0.5
    drop_ties: bool = True
    exclude_annotators: Sequence[str] = ()
    pair_kinds: Sequence[str] = ("regular",)


@dataclass(frozen=True)
class SplitConfig:
    """Shares of prompts, and the salt of the hash that places a prompt."""

    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1
    salt: str = "split"

    def __post_init__(self):
        if abs(self.train + self.validation + self.test - 1) > 1e-9:
            raise ValueError("split fractions must sum to 1")


def votes_per_pair(judgments: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """prompt_id, a_id, b_id, n_a, n_b, n_tie, n_skip, n_excluded, annotators. A skip counts as one whoever skips."""
    rows = canonical(judgments).where(F.col("pair_kind").isin(list(config.pair_kinds)))
    excluded = F.col("annotator_id").isin(list(config.exclude_annotators)) if config.exclude_annotators else F.lit(False)
    skip = F.col("choice") == "skip"
    counted = ~skip & ~excluded
    count = lambda label: F.count_if(counted & (F.col("label") == label))
    return rows.groupBy("prompt_id", "a_id", "b_id").agg(
        count("a_wins").alias("n_a"),
        count("b_wins").alias("n_b"),
        count("tie").alias("n_tie"),
        F.count_if(skip).alias("n_skip"),
        F.count_if(~skip & excluded).alias("n_excluded"),
        F.array_sort(F.collect_set(F.when(counted, F.col("annotator_id")))).alias("annotators"),
    )


def decisions(votes: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """votes with n_votes, agreement, chosen and rejected (null for a tie), the reasons to drop, and kept.
    A tie's agreement is 0 if all votes are ties, so ties need a lower min_agreement to stay."""
    n = F.col("n_a") + F.col("n_b") + F.col("n_tie")
    rows = votes.withColumn("n_votes", n)
    best = F.greatest("n_a", "n_b")
    rows = rows.withColumns(
        {
            "agreement": F.when(F.col("n_votes") > 0, best / F.col("n_votes")),
            "is_tie": F.col("n_a") == F.col("n_b"),
            "chosen": F.when(F.col("n_a") > F.col("n_b"), F.col("a_id")).when(F.col("n_b") > F.col("n_a"), F.col("b_id")),
            "rejected": F.when(F.col("n_a") > F.col("n_b"), F.col("b_id")).when(F.col("n_b") > F.col("n_a"), F.col("a_id")),
        }
    )
    some = F.filter(
        F.array(
            F.when(F.col("n_votes") < config.min_votes, "too_few_votes"),
            F.when(F.col("is_tie") & F.lit(config.drop_ties), "tie"),
            F.when(F.col("agreement") < config.min_agreement, "low_agreement"),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("reasons", F.when(F.col("n_votes") == 0, F.array(F.lit("no_votes"))).otherwise(some))
    return rows.withColumn("kept", F.size("reasons") == 0)


def drop_counts(decided: DataFrame) -> DataFrame:
    """reason, n: every reason, also those that dropped nothing."""
    found = decided.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    names = decided.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return names.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def with_split(rows: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """rows with the split of their prompt, a pure function of salt and prompt_id."""
    u = split_unit(config.salt, F.col("prompt_id"))
    return rows.withColumn("split", F.when(u < config.train, "train").when(u < config.train + config.validation, "validation").otherwise("test"))


def _texts(rows: DataFrame, responses: DataFrame, column: str, name: str) -> DataFrame:
    return rows.join(responses.select(F.col("id").alias(column), F.col("text").alias(name)), column)


def _prompts(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """rows with their prompt's text. It is met before any response's, so that the shuffle for it carries ids alone."""
    return rows.join(prompts.select(F.col("id").alias("prompt_id"), F.col("text").alias("prompt")), "prompt_id")


def dpo_rows(decided: DataFrame, prompts: DataFrame, responses: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """split, prompt, chosen, rejected and ids of kept pairs that aren't ties."""
    rows = decided.where("kept and not is_tie").select("prompt_id", "a_id", "b_id", F.col("chosen").alias("chosen_id"), F.col("rejected").alias("rejected_id"), "n_votes", "agreement")
    return with_split(_texts(_texts(_prompts(rows, prompts), responses, "chosen_id", "chosen"), responses, "rejected_id", "rejected"), config)


def kto_rows(decided: DataFrame, prompts: DataFrame, responses: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """split, prompt_id, response_id, wins, losses, label, prompt, completion; as many wins as losses: no row."""
    sides = F.array(F.struct(F.col("chosen").alias("id"), F.lit(1).alias("w")), F.struct(F.col("rejected").alias("id"), F.lit(0).alias("w")))
    ends = decided.where("kept and not is_tie").select("prompt_id", F.explode(sides).alias("s"))
    rows = ends.groupBy("prompt_id", F.col("s.id").alias("response_id")).agg(F.sum("s.w").alias("wins"), F.sum(1 - F.col("s.w")).alias("losses"))
    rows = rows.where("wins <> losses").withColumn("label", F.col("wins") > F.col("losses"))
    return with_split(_texts(_prompts(rows, prompts), responses, "response_id", "completion"), config)


def rm_rows(decided: DataFrame, prompts: DataFrame, responses: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """split, prompt, both responses and p_a, the share of votes for the first, of all kept pairs."""
    rows = decided.where("kept").select("prompt_id", "a_id", "b_id", "n_votes", ((F.col("n_a") + 0.5 * F.col("n_tie")) / F.col("n_votes")).alias("p_a"))
    return with_split(_texts(_texts(_prompts(rows, prompts), responses, "a_id", "response_a"), responses, "b_id", "response_b"), config)


ROWS = {"dpo": dpo_rows, "kto": kto_rows, "rm": rm_rows}


def card_splits(decided: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """split, n_prompts, n_pairs of kept pairs; every split has a row."""
    found = with_split(decided.where("kept"), config).groupBy("split").agg(F.countDistinct("prompt_id").alias("n_prompts"), F.count("*").alias("n_pairs"))
    names = decided.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(found, "split", "left").fillna(0, ["n_prompts", "n_pairs"])


def card_summary(decided: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: pairs and votes of all decisions, means over kept ones, and all judgments and annotators (of any kind)."""
    kept = F.col("kept")
    pairs = decided.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(kept & F.col("is_tie")).alias("n_kept_ties"),
        F.coalesce(F.sum("n_votes"), F.lit(0)).alias("n_votes_counted"),
        F.coalesce(F.sum("n_excluded"), F.lit(0)).alias("n_votes_excluded"),
        F.avg(F.when(kept, F.col("n_votes"))).alias("mean_votes_per_kept_pair"),
        F.avg(F.when(kept, F.coalesce("agreement", F.lit(0.0)))).alias("mean_agreement_kept"),
    )
    return pairs.crossJoin(judgments.agg(F.count("*").alias("n_judgments"), F.countDistinct("annotator_id").alias("n_annotators")))


def card_provenance(decided: DataFrame, responses: DataFrame) -> DataFrame:
    """model, source, n: responses that kept pairs use."""
    used = decided.where("kept").select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    return responses.join(used, "id", "left_semi").groupBy("model", "source").agg(F.count("*").alias("n"))
