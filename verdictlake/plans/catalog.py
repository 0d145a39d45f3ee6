"""All registered queries of the preference engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, comparisons, dawid_skene, export, length, quality, ranking
from ..sources.driver_tables import PreferenceTables
from ..sources.validation import violations
from . import oracle


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded; no negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def _models(t: PreferenceTables) -> DataFrame:
    return t.responses.select("id", "model")


def _games(t: PreferenceTables) -> DataFrame:
    return comparisons.games(t.judgments, _models(t))


def _matrix(t: PreferenceTables) -> DataFrame:
    return comparisons.win_matrix(_games(t))


def _decided(t: PreferenceTables) -> DataFrame:
    return export.decisions(export.votes_per_pair(t.judgments))


def _edges(t: PreferenceTables) -> DataFrame:
    return quality.preference_edges(t.judgments, _models(t))


def _lengths(t: PreferenceTables) -> DataFrame:
    return length.decisive_lengths(t.judgments, t.responses)


_REPLICATES = ranking.BootstrapConfig()

#: So close to the end that four digits don't depend on how a fit gets there.
_REST = 1e-13


def _bootstrap_scores(t: PreferenceTables, config: ranking.BootstrapConfig = _REPLICATES) -> DataFrame:
    scores = ranking.replicate_matrices(_games(t), config).groupBy("rep", "item").agg((F.sum("wins") / F.sum("games")).alias("estimate"))
    return _round(ranking.intervals(scores))


def _tau(t: PreferenceTables) -> DataFrame:
    fitted = ranking.bradley_terry(_matrix(t)).select("item", "strength", (-F.ascii(F.substring("item", -1, 1))).alias("truth"))
    return _round(ranking.kendall_tau(fitted, "strength", "truth"))


def _tau_with_length(t: PreferenceTables) -> DataFrame:
    """Whether responses that win more of their games have more words: one item a response, with many ties of both."""
    scores = comparisons.item_scores(comparisons.win_matrix(comparisons.games(t.judgments))).select("item", (F.col("score") / F.col("games")).alias("rate"))
    return _round(ranking.kendall_tau(scores.join(t.responses.select(F.col("id").alias("item"), "n_words"), "item"), "rate", "n_words"))


def _planted_violations(t: PreferenceTables) -> DataFrame:
    """The integrity rules over judgments of which one in five hundred has each of six faults."""
    fault = F.col("seq") % 500
    put = lambda n, value, own: F.when(fault == n, value).otherwise(F.col(own))
    changes = {
        "choice": put(1, F.lit("both"), "choice"), "right_response_id": put(2, F.col("left_response_id"), "right_response_id"), "session_id": put(3, F.lit("s-none"), "session_id"),
        "repeat_of": put(4, F.col("id"), "repeat_of"), "prompt_id": put(5, F.lit("p0"), "prompt_id"), "id": put(6, F.lit("bad id"), "id"),
    }
    return violations(t.prompts, t.responses, t.annotators, t.sessions, t.gold_pairs, t.judgments.withColumns(changes))


_QUERIES: dict[str, Callable[[PreferenceTables], DataFrame]] = {
    "canonical_labels": lambda t: comparisons.canonical(t.judgments).select("id", "annotator_id", "prompt_id", "a_id", "b_id", "label", "pair_kind"),
    "game_selection_drops": lambda t: comparisons.game_drops(t.judgments, _models(t), excluded=("ann-08", "ann-10")),
    "games_model_level": lambda t: _games(t).groupBy("cluster", "first", "second", "score").agg(F.count("*").alias("n")),
    "games_response_level": lambda t: comparisons.games(t.judgments).groupBy("cluster", "first", "second", "score").agg(F.count("*").alias("n")),
    "win_matrix": _matrix,
    "empirical_win_rates": lambda t: _round(comparisons.win_rates(_matrix(t))),
    "item_scores": lambda t: comparisons.item_scores(_matrix(t)),
    "ranked_implied_pairs": lambda t: comparisons.implied_pairs(t.ranked).select("id", "prompt_id", "better", "worse"),
    "games_with_rankings": lambda t: comparisons.game_drops(t.judgments, _models(t), ranked=t.ranked),
    "bt_strengths": lambda t: _round(ranking.bradley_terry(_matrix(t)).select("item", "strength"), 4),
    "bt_predicted": lambda t: _round(ranking.predicted(ranking.bradley_terry(_matrix(t))), 4),
    "bt_fit_gap": lambda t: _round(ranking.fit_gap(_matrix(t), ranking.bradley_terry(_matrix(t))), 4),
    "bt_log_likelihood": lambda t: _round(ranking.log_likelihood(_matrix(t), ranking.bradley_terry(_matrix(t))), 4),
    "kendall_tau_vs_truth": _tau,
    "kendall_tau_with_length": _tau_with_length,
    "elo_single_pass": lambda t: _round(ranking.elo(_games(t), permutations=0).select("item", "rating"), 4),
    "elo_averaged": lambda t: _round(ranking.elo(_games(t)), 4),
    "bootstrap_weights": lambda t: ranking.bootstrap_weights(_games(t), _REPLICATES),
    "bootstrap_score_ci": _bootstrap_scores,
    "bootstrap_score_ci_games": lambda t: _bootstrap_scores(t, ranking.BootstrapConfig(n_replicates=20, unit="games")),
    "bt_bootstrap_ci": lambda t: _round(ranking.bootstrap_bradley_terry(_games(t)), 4),
    "elo_bootstrap_ci": lambda t: _round(ranking.bootstrap_elo(_games(t)), 4),
    "rank_responses": lambda t: _round(ranking.bradley_terry(comparisons.win_matrix(comparisons.games(t.judgments))), 4),
    "position_bias": lambda t: _round(quality.position_bias(t.judgments).select("annotator_id", "n_left", "n_right", "n_tie", "n_skip", "ci_lower", "ci_upper", "p_value", "p_adjusted", "flagged")),
    "position_pooled": lambda t: _round(quality.position_pooled(t.judgments).select("n_left", "n_right", "left_rate", "ci_lower", "ci_upper")),
    "gold_accuracy": lambda t: _round(quality.gold_accuracy(t.judgments, t.gold_pairs).select("annotator_id", "n_gold", "n_answered", "n_correct", "n_tie", "n_skip", "accuracy", "ci_lower", "ci_upper", "flagged")),
    "self_consistency": lambda t: _round(quality.self_consistency(t.judgments).select("annotator_id", "n_controls", "n_flipped", "n_compared", "n_consistent", "n_same_side", "ci_lower", "ci_upper", "p_value", "p_adjusted", "flagged")),
    "pair_kappa": lambda t: _round(quality.pair_kappa(quality.item_labels(t.judgments))),
    "annotator_kappa": lambda t: _round(quality.annotator_kappa(quality.pair_kappa(quality.item_labels(t.judgments)))),
    "fleiss": lambda t: _round(quality.fleiss(quality.item_labels(t.judgments))),
    "length_unit": lambda t: length.length_unit(_lengths(t)),
    "length_counts": lambda t: length.length_counts(_lengths(t), "words"),
    "length_bias": lambda t: _round(length.length_bias(t.judgments, t.responses).drop("separated", "wald_z", "wald_p", "odds_ratio"), 3),
    "preference_edges": _edges,
    "triad_cycles": lambda t: quality.triads(_edges(t)),
    "scc_summary": lambda t: quality.component_summary(_edges(t)),
    "scc_summary_responses": lambda t: quality.component_summary(quality.preference_edges(t.judgments), task_rows=0),
    "cycle_p_value": lambda t: _round(quality.transitivity(_edges(t))),
    "dawid_skene_reliability": lambda t: _round(dawid_skene.reliability(t.judgments, tol=_REST).select("annotator_id", "n_labels", "accuracy", "spammer_score", "spammer", "reversed"), 4),
    "dawid_skene_full": lambda t: _round(dawid_skene.reliability(t.judgments, tol=_REST, symmetric=False).select("annotator_id", "n_labels", "right_a", "right_b", "accuracy", "spammer_score", "spammer", "reversed"), 3),
    "audit_verdicts": lambda t: audit.verdicts(t.judgments, t.responses, t.gold_pairs),
    "votes_per_pair": lambda t: export.votes_per_pair(t.judgments).withColumn("n_people", F.size("annotators").cast("long")).drop("n_excluded", "annotators"),
    "pair_decisions": lambda t: _round(_decided(t).select("prompt_id", "a_id", "b_id", "n_votes", "chosen", "rejected", "agreement", F.array_join("reasons", ",").alias("reasons"))),
    "drop_reason_counts": lambda t: export.drop_counts(_decided(t)),
    "prompt_split": lambda t: _round(export.with_split(_decided(t).where("kept")).select("prompt_id", "split", export.split_unit("split", F.col("prompt_id")).alias("u")).distinct(), 9),
    "dpo_rows": lambda t: export.dpo_rows(_decided(t), t.prompts, t.responses).select("split", "prompt_id", "prompt", "chosen", "rejected", "n_votes"),
    "kto_rows": lambda t: export.kto_rows(_decided(t), t.prompts, t.responses).select("split", "prompt_id", "response_id", "wins", "losses", "label"),
    "rm_rows": lambda t: _round(export.rm_rows(_decided(t), t.prompts, t.responses).select("split", "prompt_id", "a_id", "b_id", "p_a", "n_votes")),
    "card_split_stats": lambda t: export.card_splits(_decided(t)),
    "card_summary": lambda t: _round(export.card_summary(_decided(t), t.judgments).select("n_pairs", "n_kept", "n_votes_counted", "mean_votes_per_kept_pair", "mean_agreement_kept", "n_judgments", "n_annotators")),
    "card_provenance": lambda t: export.card_provenance(_decided(t), t.responses),
    "store_summary": lambda t: audit.summary(t),
    "integrity_violations_planted": _planted_violations,
    "integrity_violations": lambda t: violations(t.prompts, t.responses, t.annotators, t.sessions, t.gold_pairs, t.judgments),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """(spark, sf_dir) -> DataFrame by name."""
    return {name: (lambda spark, sf_dir, f=f: f(PreferenceTables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
