"""From judgments to games: canonical pairs, selection with drop reasons, orientation, win matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGULAR = ("regular",)


def canonical(judgments: DataFrame) -> DataFrame:
    """judgments with a_id < b_id and label: a_wins, b_wins, tie or null (skip)."""
    left, right = F.col("left_response_id"), F.col("right_response_id")
    winner = F.when(F.col("choice") == "left", left).when(F.col("choice") == "right", right)
    label = F.when(F.col("choice") == "tie", "tie").when(winner == F.least(left, right), "a_wins").when(winner.isNotNull(), "b_wins")
    return judgments.withColumns({"a_id": F.least(left, right), "b_id": F.greatest(left, right), "label": label})


def drop_reason(kinds: Sequence[str], excluded: Sequence[str]) -> Column:
    """The first reason that applies, null for a game: kind, then annotator, then skip."""
    if not kinds:
        raise ValueError("at least one pair kind is needed")
    out = ~F.col("annotator_id").isin(list(excluded)) if excluded else F.lit(True)
    return F.when(~F.col("pair_kind").isin(list(kinds)), "pair_kind").when(~out, "excluded_annotator").when(F.col("choice") == "skip", "skip")


def _outcomes(judgments: DataFrame, responses: DataFrame | None, kinds: Sequence[str], excluded: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Each judgment with its items, why it is no game, and `more` columns. responses(id, model) maps to models; without, items are responses."""
    score = F.when(F.col("choice") == "left", 1.0).when(F.col("choice") == "tie", 0.5).when(F.col("choice") == "right", 0.0)
    rows = judgments.select("prompt_id", F.col("left_response_id").alias("x"), F.col("right_response_id").alias("y"), score.alias("score"), drop_reason(kinds, excluded).alias("dropped"), *more)
    if responses is not None:
        for side in ("x", "y"):
            model = responses.select(F.col("id").alias(side), F.col("model").alias(f"{side}_item"))
            rows = rows.join(model, side, "left")
        # a judgment of a response that isn't there is an error, as it is where records are checked one by one
        missing = F.when(F.col("x_item").isNull() | F.col("y_item").isNull(), F.raise_error("a judged response does not exist"))
        rows = rows.select("prompt_id", F.coalesce(F.col("x_item"), missing).alias("x"), F.coalesce(F.col("y_item"), missing).alias("y"), "score", "dropped", *more)
    return rows.withColumn("dropped", F.coalesce("dropped", F.when(F.col("x") == F.col("y"), "same_item")))


def _oriented(rows: DataFrame) -> DataFrame:
    flip = F.col("x") > F.col("y")
    return rows.select(
        F.col("prompt_id").alias("cluster"),
        F.least("x", "y").alias("first"),
        F.greatest("x", "y").alias("second"),
        F.when(flip, 1.0 - F.col("score")).otherwise(F.col("score")).alias("score"),
    )


def implied_pairs(ranked: DataFrame) -> DataFrame:
    """id, prompt_id, annotator_id, better, worse: all ordered pairs of each ranking."""
    placed = ranked.select("id", "annotator_id", "prompt_id", "ranking", F.posexplode("ranking").alias("pos", "better"))
    return placed.select("id", "annotator_id", "prompt_id", "better", F.explode(F.expr("slice(ranking, pos + 2, size(ranking))")).alias("worse"))


def games(judgments: DataFrame, responses: DataFrame | None = None, kinds: Sequence[str] = REGULAR, excluded: Sequence[str] = (), ranked: DataFrame | None = None) -> DataFrame:
    """cluster, first, second, score (of first). With ranked, each implied pair of a ranking is a game as well."""
    rows = _outcomes(judgments, responses, kinds, excluded)
    if ranked is not None:
        pairs = _ranked_outcomes(ranked, responses, excluded).where("dropped is null")
        rows = rows.unionByName(pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies"))
    return _oriented(rows.where("dropped is null"))


def _ranked_outcomes(ranked: DataFrame, responses: DataFrame | None, excluded: Sequence[str]) -> DataFrame:
    """As `_outcomes`, with how many rankings imply the pair (copies). Rankings are dealt by prompt, and their pairs counted there, so that items are looked
    up once for each pair of a prompt, and pairs of single rankings are never shuffled or sorted."""
    kept = ranked.where(~F.col("annotator_id").isin(list(excluded))) if excluded else ranked
    dealt = kept.select("id", "annotator_id", "prompt_id", "ranking").repartition("prompt_id")
    counted = implied_pairs(dealt).groupBy("prompt_id", "better", "worse").agg(F.count("*").alias("copies"))
    pairs = counted.select(F.lit(None).cast("string").alias("annotator_id"), "prompt_id", F.col("better").alias("left_response_id"), F.col("worse").alias("right_response_id"), F.lit("left").alias("choice"), F.lit("regular").alias("pair_kind"), "copies")
    return _outcomes(pairs, responses, REGULAR, (), ("copies",))


def game_drops(judgments: DataFrame, responses: DataFrame | None = None, kinds: Sequence[str] = REGULAR, excluded: Sequence[str] = (), ranked: DataFrame | None = None) -> DataFrame:
    """reason, n: why judgments are no games (a ranking of an excluded annotator counts once, a pair within one
    item counts as a pair), and the games."""
    rows = _outcomes(judgments, responses, kinds, excluded).select("dropped", F.lit(1).cast("long").alias("copies"))
    if ranked is not None:
        rows = rows.unionByName(_ranked_outcomes(ranked, responses, excluded).select("dropped", "copies"))
        rows = rows.unionByName(ranked.where(F.col("annotator_id").isin(list(excluded))).select(F.lit("excluded_annotator").alias("dropped"), F.lit(1).cast("long").alias("copies"))) if excluded else rows
    return rows.groupBy(F.coalesce("dropped", F.lit("game")).alias("reason")).agg(F.sum("copies").alias("n"))


def win_matrix(played: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """item, opponent, wins, games, both directions; `by` columns (a replicate) are kept, games count `weight` times."""
    w = weight if weight is not None else F.lit(1.0)
    # sums of one direction first, so that only item pairs are doubled
    half = played.groupBy(*by, "first", "second").agg(F.sum(w * F.col("score")).alias("won"), F.sum(w).cast("double").alias("played"))
    sides = F.array(F.struct(F.col("first").alias("item"), F.col("second").alias("opponent"), F.col("won").alias("wins")), F.struct(F.col("second").alias("item"), F.col("first").alias("opponent"), (F.col("played") - F.col("won")).alias("wins")))
    return half.select(*by, F.explode(sides).alias("s"), F.col("played").alias("games")).select(*by, "s.item", "s.opponent", "s.wins", "games")


def win_rates(matrix: DataFrame) -> DataFrame:
    """item, opponent, rate: of pairs that met."""
    return matrix.where("games > 0").select("item", "opponent", (F.col("wins") / F.col("games")).alias("rate"))


def item_scores(matrix: DataFrame) -> DataFrame:
    """item, score, games: points and games of each item."""
    return matrix.groupBy("item").agg(F.sum("wins").alias("score"), F.sum("games").alias("games"))
