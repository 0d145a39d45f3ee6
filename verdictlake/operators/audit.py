"""The audit of annotators and the summary of a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import lasting, scratch, staged
from .dawid_skene import reliability
from .length import length_bias
from .quality import annotator_kappa, gold_accuracy, item_labels, pair_kappa, position_bias, preference_edges, self_consistency, transitivity

FLAGS = ("position", "length", "consistency", "intransitive", "gold", "spammer", "reversed")


@dataclass(frozen=True)
class AuditConfig:
    alpha: float = 0.05
    confidence: float = 0.95
    min_gold_accuracy: float = 0.7
    min_spammer_score: float = 0.1
    min_ds_accuracy: float = 0.5
    min_ds_labels: int = 20
    min_triads: int = 10
    chance_level: float = 0.5
    random_draws: int = 2000
    seed: int = 0


def checks(judgments: DataFrame, responses: DataFrame, gold_pairs: DataFrame, config: AuditConfig = AuditConfig()) -> dict[str, DataFrame]:
    """The result frame of each check, by name."""
    return {
        "position": position_bias(judgments, config.alpha, config.confidence),
        "length": length_bias(judgments, responses, config.alpha, config.confidence),
        "consistency": self_consistency(judgments, config.alpha, config.confidence),
        "transitivity": transitivity(preference_edges(judgments, responses), config.min_triads, config.chance_level, config.random_draws, config.seed),
        "gold": gold_accuracy(judgments, gold_pairs, config.min_gold_accuracy, config.confidence),
        "agreement": annotator_kappa(pair_kappa(item_labels(judgments))),
        "reliability": reliability(judgments, min_labels=config.min_ds_labels, min_spammer_score=config.min_spammer_score, min_accuracy=config.min_ds_accuracy),
    }


def reasons(found: dict[str, DataFrame], config: AuditConfig = AuditConfig()) -> DataFrame:
    """annotator_id, place, flag, reason: one row for each flag that is raised."""
    n = lambda c: F.col(c).cast("string")
    f = lambda c, d: F.format_string(f"%.{d}f", F.col(c))
    p = F.concat(F.lit(", p adj "), F.format_string("%.2g", F.col("p_adjusted")))

    def raised(frame: str, flag: str, on: Column, *parts) -> DataFrame:
        text = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
        return found[frame].where(on & F.col("annotator_id").isNotNull()).select("annotator_id", F.lit(FLAGS.index(flag)).alias("place"), F.lit(flag).alias("flag"), text.alias("reason"))

    is_on = F.col("flagged")
    rows = [
        raised("position", "position", is_on, "left ", n("n_left"), " of ", n("n_decisive"), " decisive choices", p),
        raised("length", "length", is_on, "length slope ", F.format_string("%+.2f", F.col("coefficient")), " log-odds per unit log ratio of ", F.col("unit"), p),
        raised("consistency", "consistency", is_on, "repeated own label ", n("n_consistent"), " of ", n("n_compared"), p),
        raised("transitivity", "intransitive", is_on, n("n_cycles"), " of ", n("n_triads"), " triads cyclic, P(at most as cyclic) ", f("p_value", 2)),
        raised("gold", "gold", is_on, "gold accuracy ", n("n_correct"), "/", n("n_answered"), ", upper bound ", f("ci_upper", 2), f" < {config.min_gold_accuracy}"),
        raised("reliability", "spammer", F.col("spammer"), "spammer score ", f("spammer_score", 3), f" < {config.min_spammer_score} over ", n("n_labels"), " labels"),
        raised("reliability", "reversed", F.col("reversed"), "estimated accuracy ", f("accuracy", 2), f" < {config.min_ds_accuracy} over ", n("n_labels"), " labels"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def once(judgments: DataFrame, responses: DataFrame, gold_pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three frames written out, so that each check reads a narrow table instead of deriving it again; no text is in them."""
    judged = [c for c in ("id", "seq", "annotator_id", "prompt_id", "left_response_id", "right_response_id", "choice", "pair_kind", "repeat_of")]
    return staged(judgments.select(*judged)), staged(responses.select("id", "model", "n_words", "n_chars")), staged(gold_pairs.select("prompt_id", "better_response_id", "worse_response_id"))


def verdicts(judgments: DataFrame, responses: DataFrame, gold_pairs: DataFrame, config: AuditConfig = AuditConfig(), truth: DataFrame | None = None) -> DataFrame:
    """annotator_id, flags, reasons (in the fixed order), flagged: of everyone with a judgment. With truth(annotator_id, archetype) how each was
    planted stands beside the flags."""
    with scratch(judgments.sparkSession):
        rows = _verdicts(*once(judgments, responses, gold_pairs), config)
        return lasting(rows if truth is None else rows.join(truth.select("annotator_id", "archetype"), "annotator_id", "left"))


def _verdicts(judgments: DataFrame, responses: DataFrame, gold_pairs: DataFrame, config: AuditConfig) -> DataFrame:
    raised = reasons(checks(judgments, responses, gold_pairs, config), config)
    lists = raised.groupBy("annotator_id").agg(F.array_sort(F.collect_list(F.struct("place", "flag", "reason"))).alias("r"))
    everyone = judgments.select("annotator_id").distinct()
    rows = everyone.join(lists, "annotator_id", "left")
    empty = F.array().cast("array<string>")
    return rows.select("annotator_id", F.coalesce(F.col("r.flag"), empty).alias("flags"), F.coalesce(F.col("r.reason"), empty).alias("reasons"), F.col("r").isNotNull().alias("flagged"))


def summary(tables) -> DataFrame:
    """name, value: rows of each table, choices, kinds, responses of each model, and the least and largest load of an
    annotator, those without a judgment included. tables has prompts, responses, annotators, gold_pairs, judgments."""
    judgments = tables.judgments
    counts = [getattr(tables, t).agg(F.count("*").alias("value")).select(F.lit(t).alias("name"), "value") for t in ("prompts", "responses", "annotators", "gold_pairs", "judgments")]
    counts.append(judgments.groupBy(F.concat(F.lit("choice "), "choice").alias("name")).agg(F.count("*").alias("value")))
    counts.append(judgments.groupBy(F.concat(F.lit("kind "), "pair_kind").alias("name")).agg(F.count("*").alias("value")))
    counts.append(tables.responses.groupBy(F.concat(F.lit("responses "), "model").alias("name")).agg(F.count("*").alias("value")))
    load = judgments.groupBy("annotator_id").agg(F.count("*").alias("n"))
    load = tables.annotators.select(F.col("id").alias("annotator_id")).join(load, "annotator_id", "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("lo"), F.max(F.coalesce("n", F.lit(0))).alias("hi"))
    counts.append(load.select(F.lit("load min").alias("name"), F.col("lo").alias("value")))
    counts.append(load.select(F.lit("load max").alias("name"), F.col("hi").alias("value")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
