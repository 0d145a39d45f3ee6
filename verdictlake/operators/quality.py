"""Annotator checks: position, gold accuracy, self-consistency, agreement, transitivity. Plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import binomial_lower_half, binomial_two_sided_half, holm, wilson
from ..staging import lasting, scratch, staged
from .comparisons import canonical
from .graphs import strong_components


def position_counts(judgments: DataFrame, by: Sequence[str] = ("annotator_id",)) -> DataFrame:
    """n_left, n_right, n_tie, n_skip over all kinds of judgments."""
    return judgments.groupBy(*by).agg(*(F.count_if(F.col("choice") == c).alias(f"n_{c}") for c in ("left", "right", "tie", "skip")))


def _position_test(counts: DataFrame, confidence: float) -> DataFrame:
    n = F.col("n_left") + F.col("n_right")
    rows = counts.withColumn("n_decisive", n)
    lower, upper = wilson(F.col("n_left"), F.col("n_decisive"), confidence)
    rate = F.when(F.col("n_decisive") > 0, F.col("n_left") / F.col("n_decisive"))
    return rows.withColumns({"left_rate": rate, "ci_lower": lower, "ci_upper": upper, "p_value": binomial_two_sided_half(F.col("n_left"), F.col("n_decisive"))})


def position_bias(judgments: DataFrame, alpha: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """One row for each annotator; Holm's family is those with a decisive choice."""
    rows = holm(_position_test(position_counts(judgments), confidence), "p_value", F.col("n_decisive") > 0)
    return rows.withColumn("flagged", (F.col("p_adjusted") <= alpha) & (F.col("n_decisive") > 0))


def position_pooled(judgments: DataFrame, alpha: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """One row for all annotators together, not adjusted."""
    return _position_test(position_counts(judgments, ()), confidence).withColumn("flagged", F.col("p_value") <= alpha)


def gold_accuracy(judgments: DataFrame, gold_pairs: DataFrame, min_accuracy: float = 0.7, confidence: float = 0.95) -> DataFrame:
    """Gold judgments against the expected label. Skips are out, ties are misses; flagged if the upper bound of the
    accuracy is below min_accuracy. n_unmatched: gold judgments of pairs that are not in gold_pairs."""
    expected = F.when(F.col("better_response_id") < F.col("worse_response_id"), "a_wins").otherwise("b_wins")
    gold = gold_pairs.select("prompt_id", F.least("better_response_id", "worse_response_id").alias("a_id"), F.greatest("better_response_id", "worse_response_id").alias("b_id"), expected.alias("expected"))
    rows = canonical(judgments.where("pair_kind = 'gold'")).join(gold, ["prompt_id", "a_id", "b_id"], "left")
    known, answered = F.col("expected").isNotNull(), F.col("expected").isNotNull() & F.col("label").isNotNull()
    counts = rows.groupBy("annotator_id").agg(
        F.count_if(known).alias("n_gold"),
        F.count_if(answered).alias("n_answered"),
        F.count_if(answered & (F.col("label") == F.col("expected"))).alias("n_correct"),
        F.count_if(known & (F.col("label") == "tie")).alias("n_tie"),
        F.count_if(known & F.col("label").isNull()).alias("n_skip"),
        F.count_if(~known).alias("n_unmatched"),
    )
    lower, upper = wilson(F.col("n_correct"), F.col("n_answered"), confidence)
    accuracy = F.when(F.col("n_answered") > 0, F.col("n_correct") / F.col("n_answered"))
    return counts.withColumns({"accuracy": accuracy, "ci_lower": lower, "ci_upper": upper, "flagged": upper < min_accuracy})


def self_consistency(judgments: DataFrame, alpha: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """Controls against the judgments they repeat, with a one-sided test against chance. Holm's family is annotators
    with a comparison. A control that repeats nothing is an error."""
    rows = canonical(judgments)
    control = rows.where("pair_kind = 'control' and repeat_of is not null").select("annotator_id", "repeat_of", F.col("left_response_id").alias("left"), F.col("choice").alias("choice"), F.col("label").alias("label"))
    original = rows.select(F.col("id").alias("repeat_of"), F.col("right_response_id").alias("o_right"), F.col("choice").alias("o_choice"), F.col("label").alias("o_label"))
    pairs = control.join(original, "repeat_of", "left").withColumn("o_choice", F.coalesce("o_choice", F.when(F.col("o_right").isNull(), F.raise_error("a control repeats a judgment that does not exist"))))
    compared = F.col("label").isNotNull() & F.col("o_label").isNotNull()
    decisive = F.col("choice").isin("left", "right") & F.col("o_choice").isin("left", "right")
    counts = pairs.groupBy("annotator_id").agg(
        F.count("*").alias("n_controls"),
        F.count_if(F.col("left") == F.col("o_right")).alias("n_flipped"),
        F.count_if(compared).alias("n_compared"),
        F.count_if(compared & (F.col("label") == F.col("o_label"))).alias("n_consistent"),
        F.count_if(compared & decisive & (F.col("choice") == F.col("o_choice"))).alias("n_same_side"),
        F.count_if(~compared).alias("n_skipped"),
    )
    lower, upper = wilson(F.col("n_consistent"), F.col("n_compared"), confidence)
    rate = F.when(F.col("n_compared") > 0, F.col("n_consistent") / F.col("n_compared"))
    rows = counts.withColumns({"rate": rate, "ci_lower": lower, "ci_upper": upper, "p_value": binomial_lower_half(F.col("n_consistent"), F.col("n_compared"))})
    return holm(rows, "p_value", F.col("n_compared") > 0).withColumn("flagged", (F.col("p_adjusted") <= alpha) & (F.col("n_compared") > 0))


def item_labels(judgments: DataFrame, kinds: Sequence[str] = ("regular", "gold")) -> DataFrame:
    """prompt_id, a_id, b_id, annotator_id, label: the first label that isn't a skip, by seq."""
    rows = canonical(judgments).where(F.col("pair_kind").isin(list(kinds)) & F.col("label").isNotNull())
    return rows.groupBy("prompt_id", "a_id", "b_id", "annotator_id").agg(F.min_by("label", "seq").alias("label"))


def pair_kappa(labels: DataFrame, min_shared: int = 1) -> DataFrame:
    """annotator_x < annotator_y, n_shared, observed, expected, kappa (null where chance agrees always). Labels of an
    item meet once; what travels on is one count for each pair of annotators and labels."""
    left = labels.select("prompt_id", "a_id", "b_id", F.col("annotator_id").alias("annotator_x"), F.col("label").alias("lx"))
    right = labels.select("prompt_id", "a_id", "b_id", F.col("annotator_id").alias("annotator_y"), F.col("label").alias("ly"))
    met = left.join(right, ["prompt_id", "a_id", "b_id"]).where("annotator_x < annotator_y")
    count = lambda c, v: F.count_if(F.col(c) == v).cast("double")
    rows = met.groupBy("annotator_x", "annotator_y").agg(
        F.count("*").alias("n_shared"),
        F.count_if(F.col("lx") == F.col("ly")).alias("agree"),
        sum((count("lx", v) * count("ly", v) for v in ("a_wins", "b_wins")), count("lx", "tie") * count("ly", "tie")).alias("chance"),
    )
    rows = rows.where(F.col("n_shared") >= min_shared)
    rows = rows.select("annotator_x", "annotator_y", "n_shared", (F.col("agree") / F.col("n_shared")).alias("observed"), (F.col("chance") / (F.col("n_shared") * F.col("n_shared"))).alias("expected"))
    return rows.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def annotator_kappa(pairs: DataFrame) -> DataFrame:
    """annotator_id, n_partners, n_shared, mean_kappa: weighted by shared items over the kappas that are defined."""
    ends = pairs.select(F.explode(F.array("annotator_x", "annotator_y")).alias("annotator_id"), "n_shared", "kappa")
    weight = F.when(F.col("kappa").isNotNull(), F.col("n_shared"))
    return ends.groupBy("annotator_id").agg(F.count("*").alias("n_partners"), F.sum("n_shared").alias("n_shared"), (F.sum(F.col("kappa") * F.col("n_shared")) / F.sum(weight)).alias("mean_kappa"))


def fleiss(labels: DataFrame) -> DataFrame:
    """n_raters, n_items, n_excluded, kappa over the items with the most common number of raters (the larger of two)."""
    items = labels.groupBy("prompt_id", "a_id", "b_id").agg(*(F.count_if(F.col("label") == v).alias(f"n_{v}") for v in ("a_wins", "b_wins", "tie")), F.count("*").alias("m"))
    sizes = items.where("m >= 2").groupBy("m").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "m")).alias("best")).select(F.col("best.m").alias("n_raters"))
    m = F.col("n_raters")
    agreement = (F.col("n_a_wins") ** 2 + F.col("n_b_wins") ** 2 + F.col("n_tie") ** 2 - m) / (m * (m - 1))
    rows = items.crossJoin(F.broadcast(sizes))  # sizes: one row
    used = F.col("m") == m
    sums = rows.groupBy("n_raters").agg(
        F.count_if(used).alias("n_items"), F.count_if(~used).alias("n_excluded"), F.avg(F.when(used, agreement)).alias("po"), *(F.sum(F.when(used, F.col(f"n_{v}"))).alias(v) for v in ("a_wins", "b_wins", "tie"))
    )
    total = F.col("n_items") * m
    pe = (F.col("a_wins") / total) ** 2 + (F.col("b_wins") / total) ** 2 + (F.col("tie") / total) ** 2
    return sums.withColumn("pe", pe).select("n_raters", "n_items", "n_excluded", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def preference_edges(judgments: DataFrame, responses: DataFrame | None = None, kinds: Sequence[str] = ("regular", "gold")) -> DataFrame:
    """annotator_id, u < v, sign: 1 where u was preferred more often, -1 where v, 0 for a level pair. Nodes are responses,
    or models where responses(id, model) is given; a pair of one model is no pair."""
    rows = judgments.where(F.col("pair_kind").isin(list(kinds)))
    rows = rows.select("annotator_id", F.col("left_response_id").alias("x"), F.col("right_response_id").alias("y"), "choice")
    if responses is not None:
        for side in ("x", "y"):
            rows = rows.join(responses.select(F.col("id").alias(side), F.col("model").alias(f"m{side}")), side)
        rows = rows.select("annotator_id", F.col("mx").alias("x"), F.col("my").alias("y"), "choice").where("x <> y")
    net = F.when(F.col("choice") == "left", 1).when(F.col("choice") == "right", -1).otherwise(0) * F.when(F.col("x") < F.col("y"), 1).otherwise(-1)
    return rows.groupBy("annotator_id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.signum(F.sum(net)).cast("int").alias("sign"))


def _triples(edges: DataFrame) -> DataFrame:
    """annotator_id, a, b, c, ab, ac, bc: complete triples of decided pairs once each, with 1 where the first of a pair was preferred.

    Pairs point from the node with fewer pairs to the one with more, so that no node has many that leave it: two of these are a wedge,
    and the pair that closes it is looked up. A node that everyone was compared with costs no square of its pairs."""
    e = edges.where("sign <> 0").select("annotator_id", "u", "v", "sign")
    degree = e.select("annotator_id", F.explode(F.array("u", "v")).alias("node")).groupBy("annotator_id", "node").agg(F.count("*").alias("d"))
    for end in ("u", "v"):
        e = e.join(degree.select("annotator_id", F.col("node").alias(end), F.struct("d", F.col("node").alias("name")).alias(f"r{end}")), ["annotator_id", end])
    up = F.col("ru") < F.col("rv")
    e = e.select("annotator_id", F.when(up, F.col("ru")).otherwise(F.col("rv")).alias("x"), F.when(up, F.col("rv")).otherwise(F.col("ru")).alias("y"), F.when(up, F.col("sign")).otherwise(-F.col("sign")).alias("s"))
    one = e.select("annotator_id", F.col("x").alias("a"), F.col("y").alias("b"), F.col("s").alias("ab"))
    two = e.select("annotator_id", F.col("x").alias("a"), F.col("y").alias("c"), F.col("s").alias("ac"))
    close = e.select("annotator_id", F.col("x").alias("b"), F.col("y").alias("c"), F.col("s").alias("bc"))
    found = one.join(two, ["annotator_id", "a"]).where("b < c").join(close, ["annotator_id", "b", "c"])
    return found.select("annotator_id", *(F.col(f"{n}.name").alias(n) for n in "abc"), "ab", "ac", "bc")


def triads(edges: DataFrame) -> DataFrame:
    """annotator_id, n_triads, n_cycles: complete triples of decided pairs."""
    return _triples(edges).groupBy("annotator_id").agg(F.count("*").alias("n_triads"), F.count_if((F.col("ab") == F.col("bc")) & (F.col("ac") == -F.col("ab"))).alias("n_cycles"))


def _components(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Number of the strongly connected component of each node: forward and backward reach of one node at a time."""
    label = np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        reach = []
        for a, b in ((source, target), (target, source)):
            seen = np.zeros(n, bool)
            seen[root] = True
            while True:
                more = seen.copy()
                more[b[seen[a]]] = True
                if (more == seen).all():
                    break
                seen = more
            reach.append(seen)
        label[reach[0] & reach[1]] = root
    return label


def component_summary(edges: DataFrame, task_rows: int = 20_000) -> DataFrame:
    """annotator_id, n_nodes, n_edges, n_level, n_cyclic_components, largest_component (0 without a cycle).

    Level pairs make nodes, too. Annotators with at most `task_rows` pairs are a task each; if one has more, components are found by frames."""
    with scratch(edges.sparkSession):
        rows = staged(edges.select("annotator_id", "u", "v", "sign"))
        most = rows.groupBy("annotator_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        return lasting(_summary_in_tasks(rows) if most <= task_rows else _summary_by_frames(rows))


def _summary_by_frames(edges: DataFrame) -> DataFrame:
    won = F.col("sign") > 0
    arcs = edges.where("sign <> 0").select("annotator_id", F.when(won, F.col("u")).otherwise(F.col("v")).alias("source"), F.when(won, F.col("v")).otherwise(F.col("u")).alias("target"))
    sizes = strong_components(arcs, ("annotator_id",)).groupBy("annotator_id", "component").agg(F.count("*").alias("size")).where("size > 1")
    cyclic = sizes.groupBy("annotator_id").agg(F.count("*").alias("n_cyclic_components"), F.max("size").alias("largest_component"))
    nodes = edges.select("annotator_id", F.explode(F.array("u", "v")).alias("node")).distinct().groupBy("annotator_id").agg(F.count("*").alias("n_nodes"))
    counts = edges.groupBy("annotator_id").agg(F.count_if(F.col("sign") != 0).alias("n_edges"), F.count_if(F.col("sign") == 0).alias("n_level"))
    out = nodes.join(counts, "annotator_id").join(cyclic, "annotator_id", "left").na.fill(0, ["n_cyclic_components", "largest_component"])
    return out.select("annotator_id", "n_nodes", "n_edges", "n_level", "n_cyclic_components", "largest_component")


def _summary_in_tasks(edges: DataFrame) -> DataFrame:
    """The kernel sees one annotator's pairs at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.r_[rows["u"].to_numpy(str), rows["v"].to_numpy(str)], return_inverse=True)
        u, v, sign = codes[: len(rows)], codes[len(rows) :], rows["sign"].to_numpy()
        source = np.where(sign > 0, u, v)[sign != 0]
        target = np.where(sign > 0, v, u)[sign != 0]
        sizes = np.bincount(_components(len(names), source, target), minlength=1)
        cyclic = sizes[sizes > 1]
        values = (rows["annotator_id"].iloc[0], len(names), int((sign != 0).sum()), int((sign == 0).sum()), len(cyclic), int(cyclic.max()) if len(cyclic) else 0)
        return pd.DataFrame([values], columns=["annotator_id", "n_nodes", "n_edges", "n_level", "n_cyclic_components", "largest_component"])

    return edges.groupBy("annotator_id").applyInPandas(run, "annotator_id string, n_nodes long, n_edges long, n_level long, n_cyclic_components long, largest_component long")


_COINS = 32


def _coins(seed: int, word: Column, u: Column, v: Column) -> Column:
    """32 coin flips of a pair, as the bits of a number: the first of an MD5 over seed, word and the pair's nodes in order."""
    text = F.concat_ws("|", F.lit(f"{seed}|coin"), word.cast("string"), F.least(u, v), F.greatest(u, v))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_cycles(edges: DataFrame, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """annotator_id, p_value, random_rate of those with triads: how often as few triads are cyclic when every pair is a coin flip (add-one
    estimate), and the share that then is. Every annotator has the same seed.

    Draws go 32 at a time: the flips of a pair are the bits of a number, those in which a triad is cyclic the bits of another, which are
    added up bit by bit over the triads, before and after one shuffle."""
    found = triads(edges)
    triples = _triples(edges)
    words = -(-n_draws // _COINS)
    each = triples.select("annotator_id", "a", "b", "c", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"))

    def toward(x: str, y: str) -> Column:
        """Flips of a pair as those of x against y: turned over where y comes first."""
        flips = _coins(seed, F.col("word"), F.col(x), F.col(y))
        return F.when(F.col(x) < F.col(y), flips).otherwise(flips.bitwiseXOR(F.lit((1 << _COINS) - 1)))

    ab, bc, ca = toward("a", "b"), toward("b", "c"), toward("c", "a")
    # cyclic where all three go the same way round
    cyclic = F.bitwise_not(ab.bitwiseXOR(bc)).bitwiseAND(F.bitwise_not(bc.bitwiseXOR(ca)))
    each = each.select("annotator_id", "word", cyclic.alias("cyclic"))
    counts = each.groupBy("annotator_id", "word").agg(*(F.sum(F.shiftright("cyclic", k).bitwiseAND(F.lit(1))).alias(f"n{k}") for k in range(_COINS)))
    draws = counts.select("annotator_id", F.posexplode(F.array(*(f"n{k}" for k in range(_COINS)))).alias("bit", "n"), "word").where(F.col("word") * _COINS + F.col("bit") < n_draws)
    rows = draws.join(found, "annotator_id").groupBy("annotator_id", "n_triads").agg(F.count_if(F.col("n") <= F.col("n_cycles")).alias("low"), F.avg("n").alias("mean"))
    return rows.select("annotator_id", ((F.col("low") + 1) / (n_draws + 1)).alias("p_value"), (F.col("mean") / F.col("n_triads")).alias("random_rate"))


def transitivity(edges: DataFrame, min_triads: int = 10, chance_level: float = 0.5, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """All of an annotator's graph; flagged with enough triads that are no less cyclic than coin flips. Without triads p_value is 1."""
    rows = component_summary(edges).join(triads(edges), "annotator_id", "left").join(random_cycles(edges, n_draws, seed), "annotator_id", "left")
    rows = rows.fillna(0, ["n_triads", "n_cycles"]).fillna(1.0, ["p_value"])
    rate = F.when(F.col("n_triads") > 0, F.col("n_cycles") / F.col("n_triads"))
    return rows.withColumns({"cycle_rate": rate, "flagged": (F.col("n_triads") >= min_triads) & (F.col("p_value") > chance_level)})
