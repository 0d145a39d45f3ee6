"""Hand-worked values of the preference operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import inversions, stats
from verdictlake.operators import comparisons, dawid_skene, export, graphs, length, quality, ranking

J = "id string, seq long, annotator_id string, prompt_id string, left_response_id string, right_response_id string, choice string, pair_kind string, repeat_of string"


def judgments(spark, rows):
    """rows: (annotator, prompt, left, right, choice, kind, repeat_of)."""
    full = [(f"j{n}", n, a, p, x, y, c, *(rest or ["regular", None])) for n, (a, p, x, y, c, *rest) in enumerate(rows)]
    return spark.createDataFrame([r if len(r) == 9 else (*r, None) for r in full], J)


def one(df):
    return df.first().asDict()


def test_binomial_wilson_and_holm(spark):
    rows = spark.createDataFrame([(9, 10), (10, 10), (5, 10), (0, 0), (8, 10), (0, 12)], "k long, n long")
    lower, upper = stats.wilson(F.col("k"), F.col("n"))
    got = {(r.k, r.n): r for r in rows.select("k", "n", stats.binomial_two_sided_half(F.col("k"), F.col("n")).alias("p"), lower.alias("lo"), upper.alias("hi")).collect()}
    assert got[9, 10].p == pytest.approx(22 / 1024)
    assert got[10, 10].p == pytest.approx(2 / 1024)
    assert got[5, 10].p == 1 and got[0, 0].p == 1
    assert (got[0, 0].lo, got[0, 0].hi) == (0, 1)
    assert got[8, 10].lo == pytest.approx(0.4902, abs=1e-4) and got[8, 10].hi == pytest.approx(0.9433, abs=1e-4)
    assert got[0, 12].hi == pytest.approx(0.2425, abs=1e-4) and got[0, 12].lo == 0
    p = spark.createDataFrame([("a", 0.01, True), ("b", 1.0, False), ("c", 0.04, True), ("d", 1.0, False)], "x_id string, p double, t boolean")
    assert {r.x_id: r.p_adjusted for r in stats.holm(p, "p", F.col("t")).collect()} == pytest.approx({"a": 0.02, "b": 1, "c": 0.04, "d": 1})
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "x_id string, p double")
    assert {r.x_id: r.p_adjusted for r in stats.holm(p, "p", F.lit(True)).collect()} == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02})


def test_special_functions_are_those_of_math(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.4999, 2.5, 3.0, 5.0, 8.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e"), stats.log_gamma(F.col("x") + 0.3).alias("g")).collect()
    for r in got:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-10) and r.g == pytest.approx(math.lgamma(r.x + 0.3), rel=1e-12, abs=1e-13)
    assert one(spark.range(1).select(stats.normal_two_sided(F.lit(-1.959963984540054)).alias("p")))["p"] == pytest.approx(0.05)


def test_binomial_tests_for_any_chance(spark):
    pmf = lambda k, n, p: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    rows = [(k, n, p) for n in (0, 1, 2, 7, 40) for k in range(n + 1) for p in (0.0, 0.03, 0.5, 0.8, 1.0)]
    k, n, p = F.col("k"), F.col("n"), F.col("p")
    got = spark.createDataFrame(rows, "k long, n long, p double").select("k", "n", "p", stats.binomial_cdf(k, n, p).alias("cdf"), stats.binomial_two_sided(k, n, p).alias("test")).collect()
    assert len(got) == len(rows)
    for r in got:
        each = [pmf(i, r.n, r.p) for i in range(r.n + 1)]
        assert r.cdf == pytest.approx(math.fsum(each[: r.k + 1]), abs=1e-11)
        assert r.test == pytest.approx(math.fsum(x for x in each if x <= each[r.k] * (1 + 1e-7)), abs=1e-10)
    large = one(spark.range(1).select(stats.binomial_cdf(F.lit(500_300), F.lit(1_000_000), F.lit(0.5)).alias("c"), stats.binomial_two_sided_half(F.lit(500_300), F.lit(1_000_000)).alias("t")))
    assert large["c"] == pytest.approx(0.5 * math.erfc(-300.5 / 500 / math.sqrt(2)), abs=1e-6) and large["t"] == pytest.approx(2 * (1 - 0.5 * math.erfc(-299.5 / 500 / math.sqrt(2))), abs=1e-6)


def test_games_drop_in_order_and_flip(spark):
    rows = judgments(
        spark,
        [("x", "p", "b", "a", "left"), ("x", "p", "a", "b", "tie"), ("x", "p", "a", "b", "skip"), ("y", "p", "a", "b", "skip"), ("x", "p", "a", "b", "left", "gold", None)],
    )
    drops = {r.reason: r.n for r in comparisons.game_drops(rows, excluded=["y"]).collect()}
    assert drops == {"game": 2, "skip": 1, "excluded_annotator": 1, "pair_kind": 1}
    assert sorted((r.first, r.second, r.score) for r in comparisons.games(rows, excluded=["y"]).select(F.col("first").alias("first"), "second", "score").collect()) == [("a", "b", 0.0), ("a", "b", 0.5)]
    with pytest.raises(ValueError):
        comparisons.games(rows, kinds=[])
    same = spark.createDataFrame([("a", "m"), ("b", "m")], "id string, model string")
    assert {r.reason: r.n for r in comparisons.game_drops(rows, same).collect()}["same_item"] == 2
    ranked = spark.createDataFrame([("k", "x", "p", ["c", "a", "b"])], "id string, annotator_id string, prompt_id string, ranking array<string>")
    assert {(r.better, r.worse) for r in comparisons.implied_pairs(ranked).collect()} == {("c", "a"), ("c", "b"), ("a", "b")}


def played(spark, rows):
    return spark.createDataFrame(rows, "cluster string, first string, second string, score double")


def test_bradley_terry_chain_and_gap(spark):
    chain = played(spark, [("c", "a", "b", s) for s in (1.0, 1.0, 1.0, 0.0)] + [("c", "b", "c", s) for s in (1.0, 1.0, 1.0, 0.0)])
    fit = {r.item: r.strength for r in ranking.bradley_terry(comparisons.win_matrix(chain), ranking.BradleyTerryConfig(prior=0)).collect()}
    assert fit == pytest.approx({"a": math.log(3), "b": 0, "c": -math.log(3)}, abs=1e-6)
    p = {(r.item, r.opponent): r.p_win for r in ranking.predicted(spark.createDataFrame(list(fit.items()), "item string, strength double")).collect()}
    assert p["a", "c"] == pytest.approx(0.9, abs=1e-6)
    with pytest.raises(Exception, match="connected"):
        ranking.bradley_terry(comparisons.win_matrix(played(spark, [("c", "a", "b", 1.0)])), ranking.BradleyTerryConfig(prior=0)).collect()
    rps = played(spark, [("c", "a", "b", 1.0)] * 9 + [("c", "b", "c", 1.0)] * 9 + [("c", "a", "c", 0.0)] * 9)
    m = comparisons.win_matrix(rps)
    assert one(ranking.fit_gap(m, ranking.bradley_terry(m)))["fit_gap"] == pytest.approx(0.5, abs=1e-6)
    tie = comparisons.win_matrix(played(spark, [("c", "a", "b", 1.0), ("c", "a", "b", 0.5)]))
    p = {(r.item, r.opponent): r.p_win for r in ranking.predicted(ranking.bradley_terry(tie, ranking.BradleyTerryConfig(prior=0))).collect()}
    assert p["a", "b"] == pytest.approx(0.75, abs=1e-6)


def test_win_rates(spark):
    m = comparisons.win_matrix(played(spark, [("c", "a", "b", s) for s in (1.0, 0.5, 0.0)] + [("c", "b", "c", 0.0)]))
    rates = {(r.item, r.opponent): r.rate for r in comparisons.win_rates(m).collect()}
    assert rates["a", "b"] == 0.5 and rates["c", "b"] == 1 and ("a", "c") not in rates


def test_elo(spark):
    config = ranking.EloConfig(k=32)
    got = {r.item: r.rating for r in ranking.elo(played(spark, [("c", "a", "b", 1.0)]), config, 0).collect()}
    assert got == {"a": 1016, "b": 984}
    assert {r.rating for r in ranking.elo(played(spark, [("c", "a", "b", 0.5)]), config, 0).collect()} == {1000}


def test_inversions_in_blocks(spark):
    rng = np.random.default_rng(4)
    assert inversions.count_inversions(np.array([], np.int64)) == 0 and inversions.count_inversions(np.array([2, 2, 1, 2])) == 2
    for n in (0, 1, 5, 333):
        order = rng.permutation(n)
        want = sum(int((order[:k] > order[k]).sum()) for k in range(n))
        assert inversions.count_inversions(order) == want
        frame = spark.createDataFrame([(k, int(v)) for k, v in enumerate(order)], "place long, value long")
        assert [int(one(inversions.inversions(frame, n, rows, blocks))["n"]) for rows, blocks in ((10, 2048), (1000, 2048), (1, 8))] == [want] * 3


def test_tau_and_intervals(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", 3.0, 2.0)], "item string, x double, y double")
    assert one(ranking.kendall_tau(rows, "x", "y"))["tau"] == pytest.approx(1 / 3)
    assert one(ranking.kendall_tau(rows.limit(1), "x", "y"))["tau"] is None
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 30, 400).astype(float), rng.integers(0, 12, 400).astype(float)
    y[:150] = 3.0  # a hot value
    wide = [*((f"i{k}", a, b) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))), ("n", None, 1.0), ("m", 1.0, float("nan"))]
    upper = np.triu_indices(400, 1)
    want = (np.sign(x[:, None] - x)[upper] * np.sign(y[:, None] - y)[upper]).mean()
    for block in (7, 64, 1 << 16):
        assert one(ranking.kendall_tau(spark.createDataFrame(wide, "item string, x double, y double"), "x", "y", block))["tau"] == pytest.approx(want, abs=1e-12)
    est = spark.range(101).select(F.col("id").alias("rep"), F.lit("a").alias("item"), F.col("id").cast("double").alias("estimate"))
    got = one(ranking.intervals(est, 0.9))
    assert (got["ci_lower"], got["ci_upper"]) == pytest.approx((5, 95))


def test_bootstrap_recovers_the_order(spark):
    games = ranking.sample_games({"a": 1.0, "b": 0.0, "c": -1.0}, spark, 60, 2, seed=3)
    rows = {r.item: r for r in ranking.bootstrap_bradley_terry(games, ranking.BootstrapConfig(40)).collect()}
    assert rows["a"].ci_lower > rows["c"].ci_upper and rows["a"].rank_lower == 1
    weights = ranking.bootstrap_weights(games, ranking.BootstrapConfig(5)).groupBy("rep").agg(F.sum("weight").alias("n"))
    assert {r.n for r in weights.collect()} == {60}


def test_agreement(spark):
    labels = [(n, "x", x, "y", y) for n, (x, y) in enumerate([("a_wins", "a_wins")] * 20 + [("a_wins", "b_wins")] * 5 + [("b_wins", "a_wins")] * 10 + [("b_wins", "b_wins")] * 15)]
    rows = [(str(n), "a", "b", who, label) for n, a, la, b, lb in labels for who, label in ((a, la), (b, lb))]
    frame = spark.createDataFrame(rows, "prompt_id string, a_id string, b_id string, annotator_id string, label string")
    got = one(quality.pair_kappa(frame))
    assert (got["observed"], got["expected"], got["kappa"]) == pytest.approx((0.7, 0.5, 0.4))
    assert one(quality.fleiss(frame))["n_items"] == 50


def test_gold_and_consistency(spark):
    gold = spark.createDataFrame([("g", "p", "a", "b")], "id string, prompt_id string, better_response_id string, worse_response_id string")
    rows = judgments(spark, [("x", "p", "a", "b", c, "gold", None) for c in ("left", "right", "tie", "skip")] + [("x", "p", "b", "a", "right", "gold", None)])
    got = one(quality.gold_accuracy(rows, gold))
    assert (got["n_gold"], got["n_answered"], got["n_correct"], got["n_tie"], got["n_skip"], got["accuracy"]) == (5, 4, 2, 1, 1, 0.5)
    rows = judgments(spark, [("x", "p", "a", "b", "left"), ("x", "p", "b", "a", "right", "control", "j0"), ("x", "p", "b", "a", "left", "control", "j0"), ("x", "p", "a", "b", "skip", "control", "j0")])
    got = one(quality.self_consistency(rows))
    assert (got["n_controls"], got["n_flipped"], got["n_compared"], got["n_consistent"], got["n_same_side"], got["n_skipped"]) == (3, 2, 2, 1, 1, 1)
    with pytest.raises(Exception, match="does not exist"):
        quality.self_consistency(judgments(spark, [("x", "p", "a", "b", "left", "control", "zz")])).collect()


def test_position(spark):
    rows = judgments(spark, [("x", "p", "a", "b", "left")] * 9 + [("x", "p", "a", "b", "right"), ("y", "p", "a", "b", "tie")])
    got = {r.annotator_id: r for r in quality.position_bias(rows).collect()}
    assert got["x"].p_value == pytest.approx(22 / 1024) and got["x"].flagged
    assert got["y"].p_adjusted == 1 and not got["y"].flagged


def test_graph(spark):
    edges = [(i, (i + d) % 5) for i in range(5) for d in (1, 2)]
    rows = judgments(spark, [("x", "p", f"m{a}", f"m{b}", "left") for a, b in edges] + [("x", "p", "m0", "m9", "tie")])
    e = quality.preference_edges(rows)
    got = one(quality.transitivity(e, n_draws=200))
    assert (got["n_triads"], got["n_cycles"], got["n_nodes"], got["n_level"], got["largest_component"]) == (10, 5, 6, 1, 5)
    line = judgments(spark, [("x", "p", f"m{a}", f"m{b}", "left") for a in range(5) for b in range(a + 1, 5)])
    got = one(quality.transitivity(quality.preference_edges(line), n_draws=200))
    assert (got["n_triads"], got["n_cycles"], got["largest_component"]) == (10, 0, 0)


def test_fits_in_one_task_in_components_and_as_frames_agree(spark):
    rng = np.random.default_rng(5)
    rows = []
    for part in range(3):  # the last one is larger than a task of 12 rows
        names = [f"i{part}{k}" for k in range(3 if part < 2 else 6)]
        for _ in range(40):
            x, y = sorted(rng.choice(names, 2, replace=False))
            rows.append((f"c{rng.integers(2)}", x, y, float(rng.choice([0.0, 0.5, 1.0]))))
    matrix = comparisons.win_matrix(played(spark, rows), ["cluster"])
    fits = [{(r.cluster, r.item): r.strength for r in ranking.bradley_terry(matrix, ranking.BradleyTerryConfig(task_rows=n), ["cluster"]).collect()} for n in (10_000, 12)]
    assert fits[0].keys() == fits[1].keys() and len(fits[0]) == 24
    assert all(fits[0][k] == pytest.approx(fits[1][k], abs=1e-7) for k in fits[0])
    # the score is zero at the end: what an item has won is what the strengths say
    shift = {}
    for r in matrix.where("cluster = 'c0'").collect():
        x, y = fits[1]["c0", r.item], fits[1]["c0", r.opponent]
        shift[r.item] = shift.get(r.item, 0) + r.wins - r.games / (1 + np.exp(y - x))
    assert max(map(abs, shift.values())) < 0.3 and abs(sum(fits[1][k] for k in fits[1] if k[0] == "c0")) < 1e-9


def test_a_fit_may_have_a_null_key(spark):
    rows = played(spark, [(c, "a", "b", s) for c in (None, "x") for s in (1.0, 1.0, 0.0)])
    got = {(r.cluster, r.item): r.strength for r in ranking.bradley_terry(comparisons.win_matrix(rows, ["cluster"]), by=["cluster"]).collect()}
    assert len(got) == 4 and got[None, "a"] == pytest.approx(got["x", "a"]) and got[None, "a"] > 0


def test_a_fit_without_a_prior_needs_wins_both_ways_as_frames_too(spark):
    ring = [("c", "a", "b", 1.0), ("c", "b", "d", 1.0), ("c", "a", "d", 0.0), ("c", "a", "d", 1.0)]
    config = ranking.BradleyTerryConfig(prior=0, task_rows=1)
    fit = {r.item: r.strength for r in ranking.bradley_terry(comparisons.win_matrix(played(spark, ring)), config).collect()}
    want = {r.item: r.strength for r in ranking.bradley_terry(comparisons.win_matrix(played(spark, ring)), ranking.BradleyTerryConfig(prior=0)).collect()}
    assert fit == pytest.approx(want, abs=1e-7)
    with pytest.raises(ValueError, match="connected"):
        ranking.bradley_terry(comparisons.win_matrix(played(spark, ring[:2])), config)


def test_strong_components_of_small_parts_are_found_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    small = [(g, f"{c}-{a}", f"{c}-{b}") for g in "xy" for c in range(8) for a, b in rng.integers(0, 5, (7, 2))]
    large = [("x", f"l{a}", f"l{b}") for a in range(5) for b in range(5) if a != b]
    frame = spark.createDataFrame(small + large, "g string, source string, target string")
    own, by_frames = graphs._strong_by_frames, []

    def seen(arcs, keys):
        by_frames.append(arcs.count())
        return own(arcs, keys)

    found = {}
    monkeypatch.setattr(graphs, "_strong_by_frames", seen)
    for rows in (10, 1000):
        found[rows] = sorted(map(tuple, graphs.strong_components(frame, ("g",), task_rows=rows).collect()))
    assert by_frames == [20] and found[10] == found[1000] and [r[2] for r in found[10] if r[1][0] == "l"] == ["l4"] * 5


def test_strong_components(spark):
    rng = np.random.default_rng(2)
    arcs = [(g, f"n{a}", f"n{b}") for g in "xy" for a, b in rng.integers(0, 14, (18 if g == "x" else 26, 2))]
    got = {(r.g, r.node): r.component for r in graphs.strong_components(spark.createDataFrame(arcs, "g string, source string, target string"), ("g",)).collect()}
    reach = {k: {k} for k in {(g, n) for g, a, b in arcs if a != b for n in (a, b)}}
    for _ in range(30):
        for g, a, b in arcs:
            if a != b:
                reach[g, a] |= reach[g, b]
    assert got.keys() == reach.keys()
    for x in reach:
        for y in reach:
            assert (got[x] == got[y] and x[0] == y[0]) == (x in reach[y] and y in reach[x])


def test_dawid_skene_keeps_tie_items(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in range(120):
        truth = rng.random() < 0.5
        for who, acc in (("a", 0.9), ("b", 0.85), ("c", 0.8), ("d", 0.1), ("e", 0.5)):
            right = rng.random() < acc
            rows.append((who, f"p{n}", "x", "y", "left" if truth == right else "right"))
    rows += [("f", "tied", "x", "y", "tie")]
    got = {r.annotator_id: r for r in dawid_skene.reliability(judgments(spark, rows)).collect()}
    assert got["a"].accuracy > 0.8 and got["d"].reversed and got["e"].spammer and not got["a"].spammer
    assert (got["f"].n_labels, got["f"].accuracy) == (0, 0.5)


@pytest.mark.parametrize("symmetric", [True, False])
def test_dawid_skene_over_patterns_equals_a_fit_over_items(spark, symmetric):
    rng = np.random.default_rng(1)
    items = [tuple(sorted((w, int(rng.random() < 0.7)) for w in rng.choice(4, 3, replace=False))) for _ in range(80)] + [()] * 3
    rows = [(f"p{n}", "x", "y", f"w{w}", ("a_wins", "b_wins")[x]) for n, item in enumerate(items) for w, x in item] + [(f"p{n}", "x", "y", "w0", "tie") for n, item in enumerate(items) if not item]
    labels = spark.createDataFrame(rows, "prompt_id string, a_id string, b_id string, annotator_id string, label string")
    found, turns, rests = dawid_skene.fit(labels, dawid_skene.ReliabilityConfig(symmetric=symmetric, tol=1e-14))
    got = {r.annotator_id: r for r in found.collect()}
    # the same model item by item, in plain loops
    q = [sum(x for _, x in i) / len(i) if i else 0.5 for i in items]
    for _ in range(2000):
        prior = [(sum(1 - x for x in q) + 0.5) / (len(q) + 1), (sum(q) + 0.5) / (len(q) + 1)]
        seen = np.zeros((4, 2, 2))
        for i, x in zip(items, q):
            for w, own in i:
                seen[w, own] += [1 - x, x]
        if symmetric:
            right = (seen[:, 0, 0] + seen[:, 1, 1] + 0.5) / (seen.sum(axis=(1, 2)) + 1)
            chance = right[:, None, None] * np.eye(2) + (1 - right)[:, None, None] * (1 - np.eye(2))
        else:
            chance = (seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 1)
        like = [[prior[k] * np.prod([chance[w, x, k] for w, x in i]) for k in (0, 1)] for i in items]
        q = [b / (a + b) for a, b in like]
    assert rests and turns < 100
    for w in range(4):
        assert np.allclose([got[f"w{w}"].a, got[f"w{w}"].b], [chance[w, 0, 0], chance[w, 1, 1]], atol=1e-6)


@pytest.mark.parametrize("symmetric", [True, False])
def test_dawid_skene_of_few_people_is_that_by_frames_in_a_job_a_turn(spark, symmetric):
    rng = np.random.default_rng(4)
    rows = [(f"p{n}", "x", "y", f"w{w}", "tie" if n % 9 == 0 else ("a_wins", "b_wins")[int((rng.random() < 0.8) == (n % 2))]) for n in range(60) for w in rng.choice(5, 3, replace=False)]
    labels = spark.createDataFrame([*rows, ("p0", "x", "y", "ties", "tie")], "prompt_id string, a_id string, b_id string, annotator_id string, label string")
    fits, jobs = [], []
    for turns, collected in ((2, 1000), (5, 1000), (5, 5)):
        spark.sparkContext.setJobGroup(f"fit {symmetric} {turns} {collected}", "")
        found, n, _ = dawid_skene.fit(labels, dawid_skene.ReliabilityConfig(symmetric=symmetric, tol=0, max_iter=turns, collected=collected))
        fits.append({r.annotator_id: r for r in found.collect()})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {symmetric} {turns} {collected}")))
        assert n == turns
    spark.sparkContext.setJobGroup("", "")
    _, got, want = fits
    assert got.keys() == want.keys() and got["ties"].n_labels == 0
    # a shuffle's stage and what reads it are jobs of their own
    assert jobs[1] - jobs[0] <= 2 * 3
    for w, r in want.items():
        assert got[w].n_labels == r.n_labels and np.allclose([got[w].a, got[w].b], [r.a, r.b], atol=1e-9)


def test_votes_reasons_and_rows(spark):
    rows = [("a", "p", "x", "y", "left"), ("b", "p", "x", "y", "left"), ("c", "p", "x", "y", "right"), ("d", "p", "x", "y", "tie"), ("e", "p", "x", "y", "skip"), ("a", "q", "x", "y", "left"), ("b", "q", "x", "y", "right"), ("a", "r", "x", "y", "skip")]
    votes = export.votes_per_pair(judgments(spark, rows))
    got = {r.prompt_id: r for r in export.decisions(votes).collect()}
    assert (got["p"].n_votes, got["p"].agreement, got["p"].chosen, got["p"].kept) == (4, 0.5, "x", True)
    assert got["q"].reasons == ["tie"] and got["r"].reasons == ["no_votes"]
    assert {r.reason: r.n for r in export.drop_counts(export.decisions(votes)).collect()} == {"no_votes": 1, "tie": 1, "too_few_votes": 0, "low_agreement": 0}
    prompts = spark.createDataFrame([("p", "ask")], "id string, text string")
    responses = spark.createDataFrame([(c, c * 3) for c in "abc"], "id string, text string")
    rows = [("u", "p", "a", "b", "left"), ("u", "p", "b", "c", "left"), ("v", "p", "a", "c", "tie")]
    decided = export.decisions(export.votes_per_pair(judgments(spark, rows)), export.FilterConfig(drop_ties=False, min_agreement=0))
    assert {r.response_id: r.label for r in export.kto_rows(decided, prompts, responses).collect()} == {"a": True, "c": False}
    assert {(r.a_id, r.b_id): r.p_a for r in export.rm_rows(decided, prompts, responses).collect()} == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 0.5}
    assert export.dpo_rows(decided, prompts, responses).count() == 2
    assert export.card_splits(decided).count() == 3


def test_logistic_fits_rest_where_the_slope_is_zero(spark):
    rng = np.random.default_rng(3)
    data = {f: (rng.normal(size=n), rng.normal(size=n) * scale) for f, n, scale in (("a", 80, 1.0), ("b", 300, 5.0), ("c", 40, 0.0), ("d", 30, 1.0))}
    chosen = {f: (rng.random(len(x)) < 1 / (1 + np.exp(-(0.4 + 1.5 * x - 0.7 * g)))).astype(float) for f, (x, g) in data.items()}
    data["d"] = (data["d"][0] + 3 * np.sign(data["d"][0]), data["d"][1] / 10)
    chosen["d"] = (data["d"][0] > 0).astype(float)
    rows = spark.createDataFrame([(f, float(a), float(b), float(y)) for f, (x, g) in data.items() for a, b, y in zip(x, g, chosen[f])], "fit string, x1 double, x2 double, y double")
    fits = spark.createDataFrame([(f, m, float(m == "full"), float(f != "c")) for f in data for m in ("full", "without")], "fit string, model string, use1 double, use2 double")
    got = {(r.fit, r.model): r for r in length.logistic_fits(rows, fits).collect()}
    for (f, m), r in got.items():
        x = np.column_stack([np.ones(len(data[f][0])), data[f][0] * (m == "full"), data[f][1] * (f != "c")])
        b, ridge = np.array([r.b0, r.b1, r.b2]), np.array([1e-8, 1.0, 1.0])
        p = 1 / (1 + np.exp(-x @ b))
        assert np.abs(x.T @ (chosen[f] - p) - ridge * b).max() < 1e-3
        assert r.value == pytest.approx(float((chosen[f] * np.log(p) + (1 - chosen[f]) * np.log(1 - p)).sum() - 0.5 * (ridge * b * b).sum()))
        if m == "full":
            inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + np.diag([0.0, 0.0, float(f == "c")]))
            assert r.variance == pytest.approx(inverse[1, 1], rel=1e-3)
    assert got["d", "full"].separated and not got["a", "full"].separated and got["c", "full"].b2 == 0 == got["a", "without"].b1


def test_length_bias_finds_who_likes_long_answers(spark):
    responses = spark.createDataFrame([("s", "m", 10, 50), ("l", "n", 40, 200)], "id string, model string, n_words long, n_chars long")
    rows = judgments(spark, [("x", f"p{n}", *(("l", "s", "left") if n % 2 else ("s", "l", "right"))) for n in range(30)] + [("y", f"p{n}", "s", "l", "left" if n % 2 else "right") for n in range(30)])
    got = {r.annotator_id: r for r in length.length_bias(rows, responses, adjust_for_quality=False).collect()}
    assert got["x"].flagged and got["x"].p_value < 1e-6 and not got["y"].flagged
    cjk = spark.createDataFrame([("s", "m", 1, 5), ("l", "n", 1, 20)], "id string, model string, n_words long, n_chars long")
    assert one(length.length_unit(length.decisive_lengths(rows, cjk)))["unit"] == "chars"


def test_registered_refits_run_the_defaults(monkeypatch):
    import inspect

    from verdictlake.operators import ranking
    from verdictlake.plans import catalog

    run = {}
    monkeypatch.setattr(catalog, "_games", lambda t: "games")
    monkeypatch.setattr(catalog, "_round", lambda df, digits=6: df)
    for name, f in (("elo_averaged", "elo"), ("bt_bootstrap_ci", "bootstrap_bradley_terry"), ("elo_bootstrap_ci", "bootstrap_elo")):
        signature = inspect.signature(getattr(ranking, f))

        def seen(*args, own=name, signature=signature, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            run[own] = bound.arguments

        monkeypatch.setattr(ranking, f, seen)
        catalog._QUERIES[name](None)
    assert run["elo_averaged"]["config"].n_permutations == 100 and run["elo_averaged"]["permutations"] in (None, 100)
    assert [run[n]["config"].n_replicates for n in ("bt_bootstrap_ci", "elo_bootstrap_ci")] == [500, 500]
    assert run["elo_bootstrap_ci"]["permutations"] == 10 and run["elo_bootstrap_ci"]["rating"].n_permutations == 100


def _rated(games, config, order):
    ratings = {}
    for first, second, score in (games[n] for n in order):
        x, y = ratings.setdefault(first, config.initial), ratings.setdefault(second, config.initial)
        change = config.k * (score - 1 / (1 + config.base ** ((y - x) / config.scale)))
        ratings[first], ratings[second] = x + change, y - change
    return ratings


def test_elo_in_canonical_order_and_over_all_orders(spark):
    rng = np.random.default_rng(8)
    rows = sorted((f"c{rng.integers(9)}", *sorted(rng.choice(list("abcde"), 2, False).tolist()), float(rng.choice([0, 0.5, 1]))) for _ in range(400))
    games, config = played(spark, rows).repartition(7), ranking.EloConfig(k=32, n_permutations=200)
    got = {r.item: r.rating for r in ranking.elo(games, config, 0).collect()}
    assert got == pytest.approx(_rated([r[1:] for r in rows], config, range(len(rows))), abs=1e-9)
    orders = [_rated([r[1:] for r in rows], config, rng.permutation(len(rows))) for _ in range(400)]
    for r in ranking.elo(games, config).collect():
        own = np.array([o[r.item] for o in orders])
        assert abs(r.rating - own.mean()) < 5 * own.std() * (1 / 200 + 1 / 400) ** 0.5 and r.rating_sd == pytest.approx(own.std(), rel=0.3)


def test_elo_orders_need_no_row_a_game():
    # 40 million games: their order alone would be 320 MB
    copies = np.full(40, 1_000_000)
    parts = ranking.arranged(copies, np.random.default_rng(1))
    some = [next(parts) for _ in range(3)]
    assert max(len(p) for p in some) == 1 << 16 and np.abs(np.bincount(np.concatenate(some), minlength=40) / (3 << 16) - 1 / 40).max() < 0.002
    small = np.concatenate(list(ranking.arranged(np.array([5, 0, 9, 300]), np.random.default_rng(1), 7)))
    assert np.bincount(small).tolist() == [5, 0, 9, 300]


def test_elo_orders_side_by_side_are_those_one_by_one():
    config = ranking.EloConfig()
    first, second, score = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([1.0, 0.5, 0.0, 1.0])
    draw = lambda k: ranking.arranged(np.array([3, 70, 2000 + 900 * k, k]), np.random.default_rng([k]), 1000)
    got = ranking.elo_passes(first, second, score, 4, [draw(k) for k in range(5)], config)
    for k in range(5):
        one_by_one = [config.initial] * 4
        for codes in draw(k):
            ranking.elo_pass(one_by_one, list(zip(first.tolist(), second.tolist(), score.tolist())), codes, config)
        assert got[k].tolist() == pytest.approx(one_by_one, abs=1e-8)


def test_bootstrap_elo_around_the_rating(spark):
    games = ranking.sample_games({"a": 1.0, "b": 0.0, "c": -1.0}, spark, 30, 2)
    got = {r.item: r for r in ranking.bootstrap_elo(games, ranking.BootstrapConfig(40), ranking.EloConfig(n_permutations=20)).collect()}
    assert set(got) == {"a", "b", "c"} and all(r.ci_lower < r.rating < r.ci_upper for r in got.values()) and got["a"].rank_upper == 1


def test_rankings_are_counted_by_prompt_before_items_are_looked_up(spark):
    rows = judgments(spark, [("x", "p", "b", "a", "left")])
    ranked = spark.createDataFrame([(f"k{n}", "x" if n < 90 else "y", f"p{n % 3}", ["c", "a", "b"]) for n in range(100)], "id string, annotator_id string, prompt_id string, ranking array<string>")
    models = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "id string, model string")
    assert {r.reason: r.n for r in comparisons.game_drops(rows, models, excluded=["y"], ranked=ranked).collect()} == {"game": 180, "same_item": 91, "excluded_annotator": 10}
    assert {(r["first"], r["second"], r.score, r.n) for r in comparisons.games(rows, models, ranked=ranked).groupBy("first", "second", "score").agg(F.count("*").alias("n")).collect()} == {("m", "n", 0.0, 200)}
    assert comparisons._ranked_outcomes(ranked, models, []).count() == 9  # not 300


def test_prompts_are_met_before_texts(spark):
    decided = spark.createDataFrame([("p", "a", "b", "a", "b", 1, 1.0, True, False, 1, 0, 0)], "prompt_id string, a_id string, b_id string, chosen string, rejected string, n_votes long, agreement double, kept boolean, is_tie boolean, n_a long, n_b long, n_tie long")
    prompts = spark.createDataFrame([("p", "why")], "id string, text string")
    responses = spark.createDataFrame([("a", "yes"), ("b", "no")], "id string, text string")
    for kind, make in export.ROWS.items():
        rows = make(decided, prompts, responses).collect()
        assert {r.prompt for r in rows} == {"why"} and len(rows) == (2 if kind == "kto" else 1)
    plan = export.dpo_rows(decided, prompts, responses)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and "prompt_id" in joins[-1]


def test_draws_of_a_task_are_bounded(spark, monkeypatch):
    games = ranking.sample_games({"a": 1.0, "b": 0.0}, spark, 60)
    for unit in ("clusters", "games"):
        config = ranking.BootstrapConfig(20, unit=unit)
        rows = lambda: sorted(map(tuple, ranking.bootstrap_weights(ranking.units(games, unit), config).collect()))
        matrix = lambda: sorted(map(tuple, ranking.replicate_matrices(games, config).collect()))
        want = rows(), matrix()
        assert sum(w for _, _, w in want[0]) == 1200
        with monkeypatch.context() as m:
            m.setattr(ranking, "_DRAWS", 100)
            _, drawn, parts = ranking._draws(ranking.units(games, unit), config)
            assert parts == 12 and max(r.n for r in drawn.groupBy(F.spark_partition_id()).agg(F.sum("weight").alias("n")).collect()) < 400
            assert (rows(), matrix()) == want


def test_games_that_are_drawn_are_numbered_once(spark, monkeypatch):
    games = ranking.sample_games({"a": 1.0, "b": 0.0, "c": 0.5}, spark, 20)
    own, sorted_by = ranking.numbered, []
    monkeypatch.setattr(ranking, "numbered", lambda rows, order, name: sorted_by.append(name) or own(rows, order, name))
    got = sorted(map(tuple, ranking.replicate_matrices(games, ranking.BootstrapConfig(5, unit="games")).collect()))
    assert sorted_by == ["n"]
    # each game as a cluster of its own
    assert got == sorted(map(tuple, ranking.replicate_matrices(ranking.units(games, "games"), ranking.BootstrapConfig(5)).collect()))


def test_the_few_kinds_of_games_are_broadcast_not_the_games(spark):
    games = ranking.staged(ranking.sample_games({"a": 1.0, "b": 0.0}, spark, 5000, 4))
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(ranking._coded(games)[1]) < size(games)


def test_a_logistic_fit_rests_where_only_rounding_makes_it_worse(spark):
    from verdictlake.operators.length import _B, _S, _moved

    names = [*_B, *_S, "use1", "use2", "share", "value", "variance", "likelihood", *(f"g{i}" for i in range(3)), *(f"h{i}{j}" for i in range(3) for j in range(i, 3)), "margin", "closest"]
    row = dict.fromkeys(names, 0.0) | {"use1": 1.0, "use2": 1.0, "share": 1.0, "value": -1000.0, "h00": 9.0, "h11": 9.0, "h22": 9.0, "margin": -1.0, "closest": 0.1}
    rows = [(*(row | {"likelihood": x}).values(), False, False) for x in (-1000.0 - 1e-9, -1000.1)]
    found = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", separated boolean, rests boolean")
    got = _moved(found, [F.lit(1.0), F.col("use1"), F.col("use2")], [0.0, 1.0, 1.0], 1e-10).select("likelihood", "rests", "share").collect()
    assert {(r.likelihood, r.rests, r.share) for r in got} == {(-1000.0 - 1e-9, True, 1.0), (-1000.1, False, 0.5)}
