"""Length bias: a logistic fit for each annotator, adjusted for the quality that the others agree on, in two rounds.

All fits run at once, as sums over judgments: in each pass Spark adds up likelihood, slope and curvature of every fit
at the point it tries, before and after one shuffle of a row a fit and task, and the next point follows from these few
numbers by column arithmetic. So a fit over all judgments is no different from that of one annotator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_survival, holm, normal_quantile, normal_two_sided
from ..staging import lasting, scratch, staged
from .comparisons import games, win_matrix
from .ranking import BradleyTerryConfig, bradley_terry


def decisive_lengths(judgments: DataFrame, responses: DataFrame, kinds: Sequence[str] = ("regular",)) -> DataFrame:
    """Decisive judgments with both sides' model, words and characters. responses(id, model, n_words, n_chars)."""
    rows = judgments.where(F.col("pair_kind").isin(list(kinds)) & F.col("choice").isin("left", "right"))
    for side in ("left", "right"):
        own = responses.select(F.col("id").alias(f"{side}_response_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("model", "n_words", "n_chars")))
        rows = rows.join(own, f"{side}_response_id")
    return rows


def length_unit(decisive: DataFrame) -> DataFrame:
    """unit: chars where more pairs tie on words but not on characters than differ in words, else words."""
    words = F.col("left_n_words") == F.col("right_n_words")
    counts = decisive.agg(F.count_if(words & (F.col("left_n_chars") != F.col("right_n_chars"))).alias("tied"), F.count_if(~words).alias("differ"))
    return counts.select("tied", "differ", F.when(F.col("tied") > F.col("differ"), "chars").otherwise("words").alias("unit"))


def with_ratio(decisive: DataFrame, unit: str) -> DataFrame:
    """log_ratio of the left to the right length, and what was chosen: longer, shorter or equal."""
    size = lambda side: F.greatest(F.lit(1), F.col(f"{side}_n_{unit}")).cast("double")
    rows = decisive.withColumn("log_ratio", F.log(size("left") / size("right")))
    picked = F.when(F.col("log_ratio") == 0, "equal").when((F.col("log_ratio") > 0) == (F.col("choice") == "left"), "longer").otherwise("shorter")
    return rows.withColumn("picked", picked)


def length_counts(decisive: DataFrame, unit: str) -> DataFrame:
    """annotator_id, n_decisive, n_longer, n_shorter, n_equal."""
    return with_ratio(decisive, unit).groupBy("annotator_id").agg(F.count("*").alias("n_decisive"), *(F.count_if(F.col("picked") == p).alias(f"n_{p}") for p in ("longer", "shorter", "equal")))


def consensus_without_each(judgments: DataFrame, responses: DataFrame, distrusted: DataFrame | None = None) -> DataFrame:
    """fit, item, strength: model strengths from the regular games of all annotators but one and those of distrusted(annotator_id). A fit
    is named = and the annotator that it leaves out; * leaves none out.

    Win counts add up, so each annotator's are subtracted from the total instead of counting the others' games again.
    Models left without games have no strength."""
    trusted = judgments if distrusted is None else judgments.join(distrusted, "annotator_id", "left_anti")
    owned = games(trusted.withColumn("prompt_id", F.col("annotator_id")), responses.select("id", "model"))
    each = staged(win_matrix(owned.withColumnRenamed("cluster", "owner"), ["owner"]))
    total = each.groupBy("item", "opponent").agg(F.sum("wins").alias("wins"), F.sum("games").alias("games"))
    people = judgments.select(F.col("annotator_id").alias("left_out")).distinct()
    cells = total.crossJoin(people)  # annotators times pairs of models, which is what the fits need
    own = each.select(F.col("owner").alias("left_out"), "item", "opponent", F.col("wins").alias("w"), F.col("games").alias("g"))
    rest = cells.join(own, ["left_out", "item", "opponent"], "left").select("left_out", "item", "opponent", (F.col("wins") - F.coalesce("w", F.lit(0.0))).alias("wins"), (F.col("games") - F.coalesce("g", F.lit(0.0))).alias("games"))
    rest = rest.withColumn("fit", F.concat(F.lit("="), "left_out")).drop("left_out").unionByName(total.withColumn("fit", F.lit("*"))).where("games > 0")
    return bradley_terry(rest, BradleyTerryConfig(), ["fit"]).drop("converged")


@dataclass(frozen=True)
class LogisticConfig:
    """Ridges of the slopes and of the intercept; tol: relative change of the penalised likelihood at the end."""

    slope_ridge: float = 1.0
    intercept_ridge: float = 1e-8
    tol: float = 1e-10
    max_iter: int = 100


_B, _S = ("b0", "b1", "b2"), ("s0", "s1", "s2")


def logistic_fits(rows: DataFrame, fits: DataFrame, config: LogisticConfig = LogisticConfig()) -> DataFrame:
    """fit, model, b0, b1, b2, value, variance (of b1), separated: logistic fits of y on 1, x1, x2 over rows(fit, x1, x2, y), for each of fits(fit, model, use1, use2), which say whether
    a model has x1 and x2; a coefficient it doesn't have is 0.

    Each pass evaluates all open fits where they stand plus their step. What is no better halves its step; else the fit moves
    there, and its next step is Newton's."""
    used = [F.lit(1.0), F.col("use1"), F.col("use2")]
    ridge = [config.intercept_ridge, config.slope_ridge, config.slope_ridge]
    zero = F.lit(0.0)
    state = fits.select("fit", "model", "use1", "use2", *(zero.alias(c) for c in (*_B, *_S)), zero.alias("share"), F.lit(None).cast("double").alias("value"), zero.alias("variance"), F.lit(False).alias("separated"), F.lit(False).alias("rests"))
    state = staged(state)
    for _ in range(config.max_iter):
        tried = state.where(~F.col("rests")).select("fit", "model", "use1", "use2", *((F.col(b) + F.col("share") * F.col(s)).alias(b) for b, s in zip(_B, _S)))
        x = [F.lit(1.0), F.col("x1") * F.col("use1"), F.col("x2") * F.col("use2")]
        at = rows.join(tried, "fit").withColumn("eta", sum((F.col(b) * v for b, v in zip(_B[1:], x[1:])), F.col("b0")))
        p = 1 / (1 + F.exp(-F.col("eta")))
        at = at.withColumns({"off": F.col("y") - p, "curve": p * (1 - p)})
        likelihood = F.col("y") * F.col("eta") - F.greatest(F.col("eta"), zero) - F.log1p(F.exp(-F.abs("eta")))
        moments = {f"g{i}": F.sum(F.col("off") * x[i]) for i in range(3)} | {f"h{i}{j}": F.sum(F.col("curve") * x[i] * x[j]) for i in range(3) for j in range(i, 3)}
        sums = at.groupBy("fit", "model").agg(
            F.sum(likelihood).alias("likelihood"), *(c.alias(n) for n, c in moments.items()),
            F.min(F.when(F.col("y") > 0.5, F.col("eta")).otherwise(-F.col("eta"))).alias("margin"), F.min(F.abs("off")).alias("closest"),
        )
        state = staged(_moved(state.join(sums, ["fit", "model"], "left"), used, ridge, config.tol).select(*state.columns))
        if state.where(~F.col("rests")).isEmpty():
            break
    return state.select("fit", "model", *_B, "value", "variance", "separated")


def _moved(found: DataFrame, used: list[Column], ridge: list[float], tol: float) -> DataFrame:
    """The state after a pass; fits that rest have no sums and stay."""
    at = [F.col(b) + F.col("share") * F.col(s) for b, s in zip(_B, _S)]
    value = F.col("likelihood") - 0.5 * sum((r * b * b for r, b in zip(ridge, at)), F.lit(0.0))
    g = [F.col(f"g{i}") - ridge[i] * at[i] for i in range(3)]
    # a model without a column has nothing in its row but a one, so that its coefficient stays 0
    h = {(i, j): F.col(f"h{i}{j}") + (ridge[i] + F.when(used[i] == 0, 1.0).otherwise(0.0) if i == j else 0.0) for i in range(3) for j in range(i, 3)}
    found = found.withColumns({f"at{i}": at[i] for i in range(3)} | {"tried": value} | {f"g{i}": g[i] for i in range(3)} | {f"h{i}{j}": v for (i, j), v in h.items()})
    h = {k: F.col(f"h{k[0]}{k[1]}") for k in h}
    minor = {
        (0, 0): h[1, 1] * h[2, 2] - h[1, 2] * h[1, 2], (0, 1): h[0, 2] * h[1, 2] - h[0, 1] * h[2, 2], (0, 2): h[0, 1] * h[1, 2] - h[0, 2] * h[1, 1],
        (1, 1): h[0, 0] * h[2, 2] - h[0, 2] * h[0, 2], (1, 2): h[0, 1] * h[0, 2] - h[0, 0] * h[1, 2], (2, 2): h[0, 0] * h[1, 1] - h[0, 1] * h[0, 1],
    }
    found = found.withColumn("determinant", h[0, 0] * minor[0, 0] + h[0, 1] * minor[0, 1] + h[0, 2] * minor[0, 2])
    newton = [sum((minor[min(i, j), max(i, j)] * F.col(f"g{j}") for j in range(3)), F.lit(0.0)) / F.col("determinant") for i in range(3)]
    passed, new = F.col("tried").isNotNull(), F.col("tried")
    close = F.col("value").isNotNull() & (F.abs(new - F.col("value")) <= tol * (1 + F.abs(new)))
    # at the end rounding may make it a little worse, which is no reason to halve the step
    better = passed & (F.col("value").isNull() | (new >= F.col("value")) | close | (F.col("share") <= 1e-10))
    pick = lambda moved, halved, same: F.when(better, moved).when(passed, halved).otherwise(same)
    columns = {b: pick(F.col(f"at{i}"), F.col(b), F.col(b)) for i, b in enumerate(_B)}
    columns |= {s: pick(newton[i], F.col(s), F.col(s)) for i, s in enumerate(_S)}
    columns |= {"value": pick(new, F.col("value"), F.col("value")), "share": pick(F.lit(1.0), F.col("share") / 2, F.col("share"))}
    columns |= {"variance": pick(minor[1, 1] / F.col("determinant"), F.col("variance"), F.col("variance"))}
    columns |= {"separated": pick((F.col("margin") > 0) | (F.col("closest") < 1e-8), F.col("separated"), F.col("separated")), "rests": F.col("rests") | (better & close) | ~passed}
    return found.withColumns(columns)


def _fits(rows: DataFrame, min_decisive: int, config: LogisticConfig) -> DataFrame:
    """A row for each fit of rows(fit, log_ratio, gap, chose_left): with the ratio's slope and without it, so that the two can be compared."""
    rows = staged(rows.select("fit", F.col("log_ratio").alias("x1"), F.col("gap").alias("x2"), F.col("chose_left").alias("y")))
    varies = lambda c: F.max(c) > F.min(c)
    known = staged(rows.groupBy("fit").agg(F.count("*").alias("n_decisive"), (varies("x1") & (F.count("*") >= min_decisive)).alias("estimable"), varies("x2").alias("has_gap")))
    models = F.explode(F.array(F.struct(F.lit("full").alias("model"), F.lit(1.0).alias("use1")), F.struct(F.lit("without").alias("model"), F.lit(0.0).alias("use1")))).alias("m")
    fits = known.where("estimable").select("fit", models, F.col("has_gap").cast("double").alias("use2")).select("fit", "m.model", "m.use1", "use2")
    found = logistic_fits(rows, fits, config)
    full = found.where("model = 'full'").drop("model")
    without = found.where("model = 'without'").select("fit", F.col("value").alias("value_without"))
    out = known.join(full, "fit", "left").join(without, "fit", "left")
    return out.select(
        "fit", "n_decisive", "estimable", F.col("b1").alias("coefficient"), F.sqrt("variance").alias("std_error"), F.col("b0").alias("position_coefficient"), F.when(F.col("has_gap"), F.col("b2")).alias("quality_coefficient"),
        F.greatest(F.lit(0.0), 2 * (F.col("value") - F.col("value_without"))).alias("lr_statistic"), F.coalesce("separated", F.lit(False)).alias("separated"),
    ).withColumn("lr_statistic", F.when(F.col("estimable"), F.col("lr_statistic")))


def length_bias(judgments: DataFrame, responses: DataFrame, alpha: float = 0.05, confidence: float = 0.95, min_decisive: int = 10, slope_ridge: float = 1.0, intercept_ridge: float = 1e-8, unit: str = "auto", adjust_for_quality: bool = True) -> DataFrame:
    """annotator_id (null: all together), slopes, their interval, Wald's z and p, the likelihood ratio test and flag; odds_ratio is that of a side twice as long. Annotators
    that the first round flags are left out of the consensus of the second."""
    with scratch(judgments.sparkSession):
        return lasting(_length_bias(judgments, responses, alpha, confidence, min_decisive, LogisticConfig(slope_ridge, intercept_ridge), unit, adjust_for_quality))


def _length_bias(judgments: DataFrame, responses: DataFrame, alpha: float, confidence: float, min_decisive: int, config: LogisticConfig, unit: str, adjust: bool) -> DataFrame:
    decisive = staged(decisive_lengths(judgments, responses).select("annotator_id", "choice", *(f"{side}_{c}" for side in ("left", "right") for c in ("model", "n_words", "n_chars"))))
    if unit == "auto":
        unit = length_unit(decisive).first()["unit"]
    rows = staged(with_ratio(decisive, unit).select("annotator_id", "left_model", "right_model", "log_ratio", F.when(F.col("choice") == "left", 1.0).otherwise(0.0).alias("chose_left")))

    def with_gap(own: DataFrame, strengths: DataFrame | None, key: Column) -> DataFrame:
        """own with the fit's key and the gap of the models' strengths where the fit's annotator is left out."""
        own = own.withColumn("fit", key)
        if strengths is None:
            return own.withColumn("gap", F.lit(0.0))
        for side in ("left", "right"):
            own = own.join(strengths.select("fit", F.col("item").alias(f"{side}_model"), F.col("strength").alias(side)), ["fit", f"{side}_model"], "left")
        return own.withColumn("gap", F.coalesce("left", F.lit(0.0)) - F.coalesce("right", F.lit(0.0)))

    # a fit is named by the annotator that it leaves out of the consensus, or * for all together
    each, pooled = F.concat(F.lit("="), "annotator_id"), F.lit("*")

    def tested(fits: DataFrame) -> DataFrame:
        fits = fits.select(F.when(F.col("fit") != "*", F.expr("substring(fit, 2)")).alias("annotator_id"), *(c for c in fits.columns if c != "fit"))
        return fits.withColumn("p_value", F.when(F.col("estimable"), chi2_survival(F.col("lr_statistic"))).otherwise(F.lit(1.0)))

    def judged(fits: DataFrame) -> DataFrame:
        return holm(fits, "p_value", F.col("estimable")).withColumn("flagged", F.col("estimable") & (F.col("p_adjusted") <= alpha))

    strengths = staged(consensus_without_each(judgments, responses)) if adjust else None
    found = staged(judged(tested(_fits(with_gap(rows, strengths, each), min_decisive, config))))
    first = found.where("flagged").select("annotator_id")
    if adjust and not first.isEmpty():
        strengths = staged(consensus_without_each(judgments, responses, first))
        both = staged(tested(_fits(with_gap(rows, strengths, each).unionByName(with_gap(rows, strengths, pooled)), min_decisive, config)))
        found, together = judged(both.where("annotator_id is not null")), both.where("annotator_id is null")
    else:
        together = tested(_fits(with_gap(rows, strengths, pooled), min_decisive, config))
    together = together.withColumns({"p_adjusted": F.col("p_value"), "flagged": F.col("estimable") & (F.col("p_value") <= alpha)})
    z = normal_quantile(confidence)
    out = found.unionByName(together).withColumn("unit", F.lit(unit))
    wald = F.when(F.col("std_error") > 0, F.col("coefficient") / F.col("std_error"))
    return out.withColumns(
        {"ci_lower": F.col("coefficient") - z * F.col("std_error"), "ci_upper": F.col("coefficient") + z * F.col("std_error"), "wald_z": wald, "wald_p": normal_two_sided(wald), "odds_ratio": F.exp(F.col("coefficient") * F.log(F.lit(2.0)))}
    )
