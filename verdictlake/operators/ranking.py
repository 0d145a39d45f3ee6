"""Rankings from games: Bradley-Terry, Elo, bootstrap intervals, fit gap, Kendall's tau.

Win counts are aggregated by Spark into sparse rows, one for each pair that met. A fit of few rows is a task of its own, one of many falls
into components, and a large component is fitted by joins and sums. Replicates are independent fits. Randomness is a hash of (seed, stream, keys), so that it doesn't depend on
partitions and any engine can draw the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.inversions import inversions
from ..functions.places import numbered
from ..staging import lasting, scratch, staged
from .comparisons import item_scores, win_matrix
from .graphs import strong_components, weak_components


@dataclass(frozen=True)
class BradleyTerryConfig:
    """prior: wins and losses of each item against an average one. tol: largest change of a strength at the end. task_rows: pairs of
    a fit that one task takes."""

    prior: float = 0.1
    tol: float = 1e-9
    max_iter: int = 100
    task_rows: int = 20_000


_TINY = 1e-300
#: Of conjugate gradients: squared share of the residual at the end, and share of the curvature below which a direction is the one that nothing depends on.
_SOLVED, _FLAT = 1e-22, 1e-13
_NOT_CONNECTED = "without a prior the items must be connected by wins in both directions"


@dataclass(frozen=True)
class EloConfig:
    k: float = 4.0
    scale: float = 400.0
    base: float = 10.0
    initial: float = 1000.0
    n_permutations: int = 100
    seed: int = 0


@dataclass(frozen=True)
class BootstrapConfig:
    """unit: what is drawn, clusters or single games."""

    n_replicates: int = 500
    level: float = 0.95
    seed: int = 0
    unit: str = "clusters"


def hash_unit(*keys) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of an MD5 over the keys."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _newton(item: np.ndarray, opponent: np.ndarray, wins: np.ndarray, games: np.ndarray, n: int, config: BradleyTerryConfig) -> tuple[np.ndarray, bool]:
    """Log strengths of n items from sparse rows in both directions, and whether the last step was small enough.

    Newton's method on the log-likelihood, which is concave; the system of a step is solved by conjugate gradients with products over the rows, so that
    memory is that of the rows, and steps are halved while they make things worse."""
    prior, theta = config.prior, np.zeros(n)

    def value(t: np.ndarray) -> float:
        # each game is in two rows
        return float((wins * -np.logaddexp(0, t[opponent] - t[item])).sum() - prior * (np.logaddexp(0, t) + np.logaddexp(0, -t)).sum())

    now = value(theta)
    for _ in range(config.max_iter):
        p, own = 1 / (1 + np.exp(theta[opponent] - theta[item])), 1 / (1 + np.exp(-theta))
        slope = np.bincount(item, wins - games * p, n) + prior * (1 - 2 * own)
        weight = games * p * (1 - p)
        diagonal = np.bincount(item, weight, n) + 2 * prior * own * (1 - own)
        step, rest = np.zeros(n), slope
        scaled = rest / np.maximum(diagonal, _TINY)
        way, size = scaled, float(rest @ scaled)
        enough = size * _SOLVED
        for _ in range(10 * n + 100):
            if size <= enough:
                break
            product = diagonal * way - np.bincount(item, weight * way[opponent], n)
            bend = float(way @ product)
            if bend <= _FLAT * float(way @ (diagonal * way)):
                break
            length = size / bend
            step, rest = step + length * way, rest - length * product
            scaled = rest / np.maximum(diagonal, _TINY)
            last, size = size, float(rest @ scaled)
            way = scaled + size / last * way
        share = 1.0
        while (then := value(theta + share * step)) < now - 1e-9 * abs(now) and share > 1e-9:
            share /= 2
        theta, now = theta + share * step, then
        if np.abs(share * step).max(initial=0.0) <= config.tol:
            return theta, True
    return theta, False


def connected(item: np.ndarray, opponent: np.ndarray, wins: np.ndarray, n: int) -> bool:
    """Whether wins lead from every item to every other (needed without a prior)."""
    won = wins > 0
    for a, b in ((item[won], opponent[won]), (opponent[won], item[won])):
        seen = np.zeros(n, bool)
        seen[0] = True
        while True:
            more = seen.copy()
            more[b[seen[a]]] = True
            if (more == seen).all():
                break
            seen = more
        if not seen.all():
            return False
    return True


def _fit_groups(rows: DataFrame, keys: list[str], config: BradleyTerryConfig) -> DataFrame:
    """keys, item, strength (not centred), converged: a task for each group of rows, whose number the caller has checked."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["item string, strength double, converged boolean"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.r_[group["item"].to_numpy(str), group["opponent"].to_numpy(str)], return_inverse=True)
        i, j = codes[: len(group)], codes[len(group) :]
        wins, games = group["wins"].to_numpy(float), group["games"].to_numpy(float)
        if not config.prior and not connected(i, j, wins, len(names)):
            raise ValueError(_NOT_CONNECTED)
        theta, ok = _newton(i, j, wins, games, len(names), config)
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "item": names, "strength": theta, "converged": ok}, columns=[*keys, "item", "strength", "converged"])

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _fit_frames(rows: DataFrame, keys: list[str], config: BradleyTerryConfig) -> DataFrame:
    """As `_fit_groups`, for groups of any size: the same method with its products as joins of nodes and rows, and its sums as
    aggregations. State is one row an item, written out in each round; of each fit a few sums come to the driver."""
    spark, prior = rows.sparkSession, config.prior
    rows = staged(rows.select(*keys, "item", "opponent", "wins", "games"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def sums(df: DataFrame, **columns: Column) -> dict[tuple, dict[str, float]]:
        return {tuple(r[k] for k in keys): r.asDict() for r in df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in columns.items())).collect()}

    def with_scalar(df: DataFrame, name: str, values: dict[tuple, float]) -> DataFrame:
        """One row for each fit, broadcast."""
        table = spark.createDataFrame([(*k, float(v)) for k, v in values.items()], f"{kinds}, {name} double")
        return df.join(F.broadcast(table), keys)

    def ends(nodes: DataFrame, *columns: str) -> DataFrame:
        """rows with the columns of both ends: x_ of the item, y_ of the opponent."""
        out = rows
        for end, mark in (("item", "x"), ("opponent", "y")):
            out = out.join(nodes.select(*keys, F.col("item").alias(end), *(F.col(c).alias(f"{mark}_{c}") for c in columns)), [*keys, end])
        return out

    def value(nodes: DataFrame, column: str) -> dict[tuple, float]:
        soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        games_part = sums(ends(nodes, column), v=-F.col("wins") * soft(F.col(f"y_{column}") - F.col(f"x_{column}")))
        prior_part = sums(nodes, v=-prior * (soft(F.col(column)) + soft(-F.col(column))))
        return {k: games_part[k]["v"] + prior_part[k]["v"] for k in prior_part}

    nodes = staged(rows.select(*keys, "item").distinct().withColumn("theta", F.lit(0.0)))
    now, moved = value(nodes, "theta"), {}
    for _ in range(config.max_iter):
        p = 1 / (1 + F.exp(F.col("y_theta") - F.col("x_theta")))
        weighed = staged(ends(nodes, "theta").select(*keys, "item", "opponent", (F.col("wins") - F.col("games") * p).alias("pull"), (F.col("games") * p * (1 - p)).alias("weight")))
        own = 1 / (1 + F.exp(-F.col("theta")))
        summed = weighed.groupBy(*keys, "item").agg(F.sum("pull").alias("pull"), F.sum("weight").alias("weight"))
        diagonal = F.greatest(F.col("weight") + 2 * prior * own * (1 - own), F.lit(_TINY))
        state = nodes.join(summed, [*keys, "item"]).select(*keys, "item", "theta", diagonal.alias("diagonal"), (F.col("pull") + prior * (1 - 2 * own)).alias("rest"), F.lit(0.0).alias("step"))
        state = staged(state.withColumn("way", F.col("rest") / F.col("diagonal")))
        size = {k: r["s"] for k, r in sums(state, s=F.col("rest") * F.col("way")).items()}
        enough = {k: s * _SOLVED for k, s in size.items()}
        for _ in range(10_000):
            if all(size[k] <= enough[k] for k in size):
                break
            others = weighed.join(state.select(*keys, F.col("item").alias("opponent"), "way"), [*keys, "opponent"]).groupBy(*keys, "item").agg(F.sum(F.col("weight") * F.col("way")).alias("others"))
            along = staged(state.join(others, [*keys, "item"]).withColumn("product", F.col("diagonal") * F.col("way") - F.col("others")))
            bend = sums(along, bend=F.col("way") * F.col("product"), scale=F.col("way") * F.col("way") * F.col("diagonal"))
            size = {k: s if bend[k]["bend"] > _FLAT * bend[k]["scale"] else 0.0 for k, s in size.items()}
            along = with_scalar(along, "length", {k: s / bend[k]["bend"] if s > enough[k] else 0.0 for k, s in size.items()})
            along = along.withColumns({"step": F.col("step") + F.col("length") * F.col("way"), "rest": F.col("rest") - F.col("length") * F.col("product")}).drop("length", "product", "others")
            along = staged(along)
            then = {k: r["s"] for k, r in sums(along, s=F.col("rest") * F.col("rest") / F.col("diagonal")).items()}
            ratio = {k: then[k] / size[k] if size[k] > enough[k] else 0.0 for k in size}
            state = with_scalar(along, "ratio", ratio).withColumn("way", F.col("rest") / F.col("diagonal") + F.col("ratio") * F.col("way")).drop("ratio")
            size = {k: then[k] if size[k] > enough[k] else 0.0 for k in size}
        share = dict.fromkeys(size, 1.0)
        while True:
            tried = staged(with_scalar(state.select(*keys, "item", "theta", "step"), "share", share).withColumn("theta", F.col("theta") + F.col("share") * F.col("step")))
            then = value(tried, "theta")
            worse = [k for k in share if then[k] < now[k] - 1e-9 * abs(now[k]) and share[k] > 1e-9]
            if not worse:
                break
            share |= {k: share[k] / 2 for k in worse}
        largest = {tuple(r[k] for k in keys): r["m"] for r in tried.groupBy(*keys).agg(F.max(F.abs(F.col("share") * F.col("step"))).alias("m")).collect()}
        nodes, now = tried.select(*keys, "item", "theta"), then
        moved = {k: m <= config.tol for k, m in largest.items()}
        if all(moved.values()):
            break
    rests = with_scalar(nodes, "rests", {k: float(ok) for k, ok in moved.items()})
    return rests.select(*keys, "item", F.col("theta").alias("strength"), (F.col("rests") > 0).alias("converged"))


def bradley_terry(matrix: DataFrame, config: BradleyTerryConfig = BradleyTerryConfig(), by: Sequence[str] = ()) -> DataFrame:
    """`by` columns, item, strength (centred), converged. One fit for each group of `by`, whose rows are pairs of items, not games.

    With a prior, items that no games lead between are fitted apart, so a fit with more than `task_rows` rows falls into its weak components, many
    of which make a task; a component that is larger still is fitted as frames, whose keys can't be null. Without a prior wins have to lead from every item to every other."""
    spark = matrix.sparkSession
    with scratch(spark):
        rows = staged(matrix.select(*by, "item", "opponent", "wins", "games"))
        keys = list(by) or ["_fit"]
        if not by:
            rows = rows.withColumn("_fit", F.lit(0))
        most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= config.task_rows:
            fitted = _fit_groups(rows, keys, config)
        elif not config.prior:
            won = rows.where("wins > 0").select(*keys, F.col("opponent").alias("source"), F.col("item").alias("target"))
            parts = strong_components(won, tuple(keys)).select(*keys, F.col("node").alias("item"), "component")
            apart = rows.select(*keys, "item").distinct().join(parts, [*keys, "item"], "left").groupBy(*keys).agg(F.count_distinct(F.coalesce("component", "item")).alias("n"))
            if not apart.where("n > 1").isEmpty():
                raise ValueError(_NOT_CONNECTED)
            fitted = _fit_frames(rows, keys, config)
        else:
            labels = weak_components(rows.select(F.col("item").alias("x"), F.col("opponent").alias("y")).distinct()).select(F.col("node").alias("item"), F.col("label").alias("component"))
            placed = staged(rows.join(labels, "item"))
            sizes = placed.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy("component").agg(F.max("n").alias("n"))
            placed = placed.join(sizes, "component")
            tasks = -(-most // config.task_rows)
            small = placed.where(F.col("n") <= config.task_rows).withColumn("_task", F.pmod(F.xxhash64("component"), F.lit(4 * tasks)).cast("int"))
            fitted = _fit_groups(small.drop("component", "n"), [*keys, "_task"], config).drop("_task")
            large = placed.where(F.col("n") > config.task_rows)
            if not large.isEmpty():
                fitted = fitted.unionByName(_fit_frames(large, keys, config))
        fitted = staged(fitted)
        mean = fitted.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.avg("strength").alias("mean"), F.bool_and("converged").alias("all"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]  # a fit's key may be null
        out = fitted.drop("converged").join(mean, same).select(*by, "item", (F.col("strength") - F.col("mean")).alias("strength"), F.col("all").alias("converged"))
        return lasting(out)


def predicted(strengths: DataFrame) -> DataFrame:
    """item, opponent, p_win for all pairs of items."""
    x = strengths.select("item", F.col("strength").alias("x"))
    y = strengths.select(F.col("item").alias("opponent"), F.col("strength").alias("y"))
    return x.join(y, F.col("item") != F.col("opponent")).select("item", "opponent", (1 / (1 + F.exp(F.col("y") - F.col("x")))).alias("p_win"))


def with_predictions(matrix: DataFrame, strengths: DataFrame) -> DataFrame:
    """matrix rows with p_win: two equi-joins on items, never all pairs."""
    x = strengths.select("item", F.col("strength").alias("x"))
    y = strengths.select(F.col("item").alias("opponent"), F.col("strength").alias("y"))
    return matrix.join(x, "item").join(y, "opponent").withColumn("p_win", 1 / (1 + F.exp(F.col("y") - F.col("x"))))


def fit_gap(matrix: DataFrame, strengths: DataFrame) -> DataFrame:
    """fit_gap: mean distance of empirical and predicted win rates over played pairs, weighted by games; 0 without any."""
    rows = with_predictions(matrix, strengths).where("games > 0")
    return rows.agg(F.coalesce(F.sum(F.col("games") * F.abs(F.col("wins") / F.col("games") - F.col("p_win"))) / F.sum("games"), F.lit(0.0)).alias("fit_gap"))


def log_likelihood(matrix: DataFrame, strengths: DataFrame, config: BradleyTerryConfig = BradleyTerryConfig()) -> DataFrame:
    """log_likelihood: of all games, with the prior's pseudo games."""
    games_part = with_predictions(matrix, strengths).agg(F.sum(F.col("wins") * F.log("p_win")).alias("g"))
    prior = strengths.agg(F.sum(config.prior * (F.log(1 / (1 + F.exp(-F.col("strength")))) + F.log(1 / (1 + F.exp("strength"))))).alias("p"))
    return games_part.crossJoin(prior).select((F.coalesce("g", F.lit(0.0)) + F.col("p")).alias("log_likelihood"))


#: Draws of a task, and games that one sorts.
_DRAWS, _SORTED = 1 << 19, 1 << 20
#: Games that a random order is drawn for at once, games that are stepped side by side at once, and orders that a task steps side by side.
_ARRANGED, _STEPPED, _SIDE_BY_SIDE = 1 << 16, 2048, 1000


def elo_pass(ratings: list[float], kinds: list[tuple[int, int, float]], codes: np.ndarray, config: EloConfig) -> None:
    """Moves ratings by games in order, each of which is the code of its kind (first, second, score)."""
    k, scale, base = float(config.k), config.scale, config.base
    for code in codes.tolist():
        i, j, score = kinds[code]
        change = k * (score - 1 / (1 + base ** ((ratings[j] - ratings[i]) / scale)))
        ratings[i] += change
        ratings[j] -= change


def arranged(copies: np.ndarray, rng: np.random.Generator, most: int = _ARRANGED) -> Iterator[np.ndarray]:
    """A random order of copies[c] games of each kind c, as their codes, `most` at a time: how many of each kind are in a
    part is drawn without replacement and their order in it is shuffled, so that all orders are equally likely (below 10^9 games, numpy's bound)."""
    left, total = copies.astype(np.int64), int(copies.sum())
    most = max(most, len(copies))
    while total:
        n = min(most, total)
        part = left if n == total else rng.multivariate_hypergeometric(left, n, method="marginals")
        codes = np.repeat(np.arange(len(left), dtype=np.min_scalar_type(len(left))), part)
        rng.shuffle(codes)
        yield codes
        left, total = left - part, total - n


def elo_passes(first: np.ndarray, second: np.ndarray, score: np.ndarray, n: int, orders: list[Iterator[np.ndarray]], config: EloConfig) -> np.ndarray:
    """Ratings after each of several orders of games of the kinds (first, second, score), which are stepped side by side; they may end at different games."""
    unit = np.log(config.base) / config.scale
    # what has come to its end plays a tie of two items that nobody else plays
    first, second, gain = np.append(first, n), np.append(second, n + 1), np.append(score, 0.5) * config.k * unit
    ratings = np.zeros(len(orders) * (n + 2))
    row, k, ended = np.arange(len(orders)) * (n + 2), config.k * unit, len(score)
    while True:
        parts = [next(o, None) for o in orders]
        longest = max((len(p) for p in parts if p is not None), default=0)
        if not longest:
            return ratings.reshape(len(orders), n + 2)[:, :n] / unit + config.initial
        codes = np.full((len(orders), longest), ended, np.min_scalar_type(ended))
        for own, part in zip(codes, parts):
            if part is not None:
                own[: len(part)] = part
        for start in range(0, longest, _STEPPED):
            some = np.ascontiguousarray(codes[:, start : start + _STEPPED].T)
            for i, j, won in zip(first[some] + row, second[some] + row, gain[some]):
                x, y = ratings.take(i), ratings.take(j)
                change = y - x
                np.exp(change, out=change)
                change += 1
                np.divide(k, change, out=change)
                np.subtract(won, change, out=change)
                ratings[i] = x + change
                ratings[j] = y - change


def _coded(played: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names(item, number), kinds(code, i, j, score) and games(cluster, code): items by number, in order of their names, and
    games by what they are, so that tasks hold numbers only."""
    names = staged(numbered(played.select(F.explode(F.array("first", "second")).alias("item")).distinct(), [F.asc("item")], "number"))
    end = lambda c, n: names.select(F.col("item").alias(c), F.col("number").alias(n))
    distinct = played.select("first", "second", "score").distinct().join(end("first", "i"), "first").join(end("second", "j"), "second")
    # written out, so that Spark knows how few they are and doesn't broadcast the games instead
    kinds = staged(numbered(distinct, [F.asc("i"), F.asc("j"), F.asc("score")], "code"))
    return names, kinds.select("code", "i", "j", "score"), played.join(kinds, ["first", "second", "score"]).select("cluster", "code")


def _canonical_pass(names: DataFrame, kinds: DataFrame, games: DataFrame, parts: int, config: EloConfig) -> DataFrame:
    """item, rating after one pass in the canonical order. Games are sorted by ranges and packed there, a code each; the pass itself, which is sequential, reads
    these packs one after another and holds a rating an item."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            codes = batch.column("code").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"part": [part], "place": [place], "codes": [codes.astype("<i4").tobytes()], "kinds": [None]}, pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratings = [], []
        for batch in batches:
            for blob, table in zip(batch.column("codes"), batch.column("kinds")):
                if table.is_valid:
                    known += [(r["i"], r["j"], r["score"]) for r in table.as_py()]
                    ratings += [float(config.initial)] * (max((max(i, j) for i, j, _ in known), default=-1) + 1 - len(ratings))
                else:
                    elo_pass(ratings, known, np.frombuffer(blob.as_py(), "<i4"), config)
        yield pa.RecordBatch.from_pydict({"number": pa.array(range(len(ratings)), pa.int64()), "rating": pa.array(ratings, pa.float64())})

    kind = pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("score", pa.float64())]))
    fields = [("part", pa.int32()), ("place", pa.int32()), ("codes", pa.binary()), ("kinds", kind)]
    schema = "part int, place int, codes binary, kinds array<struct<i: bigint, j: bigint, score: double>>"
    order = ["cluster", "code"]
    packs = games.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("code").mapInArrow(packed, schema)
    block = F.floor(F.col("code") / 10_000).cast("int")
    told = kinds.groupBy(block.alias("place")).agg(F.array_sort(F.collect_list(F.struct("code", "i", "j", "score"))).alias("all"))
    told = told.select(F.lit(-1).alias("part"), "place", F.lit(None).cast("binary").alias("codes"), F.transform("all", lambda k: F.struct(k["i"].alias("i"), k["j"].alias("j"), k["score"].alias("score"))).alias("kinds"))
    passed = told.unionByName(packs).repartition(1).sortWithinPartitions("part", "place").mapInArrow(run, "number bigint, rating double")
    return passed.join(names, "number").select("item", "rating")


def _random_passes(names: DataFrame, counts: DataFrame, tasks: int, seeds: Sequence[int], permutations: int, config: EloConfig) -> DataFrame:
    """rep, item, rating: means over random orders of the games of each rep, of counts(rep, i, j, score, copies). Generators are seeded by
    (seeds, rep), so results don't depend on how reps are dealt to tasks, each of which gets as many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames, ignore_index=True)
        if rows.empty:
            return
        rows = rows.sort_values(["rep", "i", "j", "score"], ignore_index=True)
        reps = [(int(rep), own.reset_index(drop=True)) for rep, own in rows.groupby("rep")]
        per = max(1, _SIDE_BY_SIDE // permutations)
        for start in range(0, len(reps), per):
            some = reps[start : start + per]
            kinds = pd.concat([own for _, own in some])[["i", "j", "score"]].drop_duplicates().sort_values(["i", "j", "score"], ignore_index=True)
            items = np.unique(kinds[["i", "j"]].to_numpy())
            first, second = (np.searchsorted(items, kinds[c].to_numpy()) for c in ("i", "j"))
            score = kinds["score"].to_numpy(float)
            orders = []
            for rep, own in some:
                copies = kinds.merge(own, "left", ["i", "j", "score"])["copies"].fillna(0).to_numpy(np.int64)
                # only kinds that a rep has, so that its draws are its own whatever shares the task
                held = np.flatnonzero(copies).astype(np.min_scalar_type(len(copies)))
                orders += [map(held.take, arranged(copies[held], rng)) for rng in np.random.default_rng([*seeds, rep]).spawn(permutations)]
            if len(orders) < 16:  # so few are faster one by one
                found, each = np.full((len(orders), len(items)), float(config.initial)), list(zip(first.tolist(), second.tolist(), score.tolist()))
                for own, order in zip(found, orders):
                    ratings = own.tolist()
                    for codes in order:
                        elo_pass(ratings, each, codes, config)
                    own[:] = ratings
            else:
                found = elo_passes(first, second, score, len(items), orders, config)
            means = found.reshape(len(some), permutations, len(items)).mean(axis=1)
            for (rep, own), ratings in zip(some, means):
                played = np.isin(items, own[["i", "j"]].to_numpy())
                yield pd.DataFrame({"rep": rep, "number": items[played], "rating": ratings[played]})

    dealt = counts.select((F.col("rep") % tasks).cast("int").alias("task"), "rep", "i", "j", "score", "copies").repartitionById(tasks, "task")
    return dealt.drop("task").mapInPandas(run, "rep long, number long, rating double").join(names, "number").select("rep", "item", "rating")


def elo(played: DataFrame, config: EloConfig = EloConfig(), permutations: int | None = None) -> DataFrame:
    """item, rating, rating_sd: mean and population deviation over seeded random orders; with permutations = 0 one pass in
    the canonical order. A pass is sequential by nature; passes are independent.

    In a random order only what a game is counts (who met and how it ended), so a pass gets the number of games of each kind, and draws its order part
    by part: it neither reads nor holds the games."""
    n_orders = config.n_permutations if permutations is None else permutations
    with scratch(played.sparkSession):
        played = staged(played.select("cluster", "first", "second", "score"))
        names, kinds, games = _coded(played)
        if not n_orders:
            parts = -(-max(1, played.count()) // _SORTED)
            return lasting(_canonical_pass(names, kinds, games, parts, config).select("item", "rating", F.lit(0.0).alias("rating_sd")))
        counts = games.groupBy("code").agg(F.count("*").alias("copies")).join(kinds, "code")
        turns = counts.crossJoin(F.broadcast(played.sparkSession.range(n_orders).select(F.col("id").alias("rep"))))  # n_permutations rows, a parameter
        passes = _random_passes(names, turns, n_orders, [config.seed], 1, config)
        return lasting(passes.groupBy("item").agg(F.avg("rating").alias("rating"), F.coalesce(F.stddev_pop("rating"), F.lit(0.0)).alias("rating_sd")))


def _numbered_games(played: DataFrame) -> DataFrame:
    return numbered(played, [F.asc(c) for c in ("cluster", "first", "second", "score")], "n")


def units(played: DataFrame, unit: str) -> DataFrame:
    """played with `cluster` as what is drawn: the clusters as they are, or each game by its number in the canonical order."""
    if unit == "clusters":
        return played
    if unit != "games":
        raise ValueError("what is drawn are clusters or games")
    return _numbered_games(played).withColumn("cluster", F.format_string("g%012d", "n")).drop("n")


def _drawn(spark: SparkSession, count: int, config: BootstrapConfig) -> tuple[DataFrame, int]:
    """drawn(rep, n, weight) of numbers below count, dealt by n into so many partitions, whose number grows with replicates times count. A draw is a
    hash of replicate and draw number, so that draws need no order and nothing of what is drawn."""
    parts = max(1, -(-count * config.n_replicates // _DRAWS))
    ids = spark.range(0, count * config.n_replicates, 1, parts)
    ids = ids.select(F.expr(f"id div {max(1, count)}").alias("rep"), (F.col("id") % max(1, count)).alias("draw"))
    chosen = F.floor(hash_unit(config.seed, "clusters", F.col("rep"), F.col("draw")) * F.lit(count)).cast("long")
    return ids.select("rep", chosen.alias("n")).repartition(parts, "n").groupBy("rep", "n").agg(F.count("*").alias("weight")), parts


def _draws(played: DataFrame, config: BootstrapConfig) -> tuple[DataFrame, DataFrame, int]:
    """clusters(cluster, n), drawn(rep, n, weight), both dealt by n into so many partitions; clusters are numbered by ranges."""
    clusters = staged(numbered(played.select("cluster").distinct(), [F.asc("cluster")], "n"))
    drawn, parts = _drawn(played.sparkSession, clusters.count(), config)
    return clusters.repartition(parts, "n"), drawn, parts


def bootstrap_weights(played: DataFrame, config: BootstrapConfig = BootstrapConfig()) -> DataFrame:
    """rep, cluster, weight: clusters drawn with replacement, as often as there are clusters."""
    clusters, drawn, _ = _draws(played, config)
    return drawn.join(clusters, "n").select("rep", "cluster", "weight")


def _weighted(sums: DataFrame, played: DataFrame, config: BootstrapConfig) -> DataFrame:
    """sums(cluster, ...) without the cluster, with rep and weight of each replicate that drew it; played tells which clusters there are."""
    clusters, drawn, parts = _draws(played, config)
    return sums.join(clusters, "cluster").drop("cluster").repartition(parts, "n").join(drawn, "n").drop("n")


def replicate_matrices(played: DataFrame, config: BootstrapConfig = BootstrapConfig()) -> DataFrame:
    """rep, item, opponent, wins, games: pairs are summed within clusters first, so replicates multiply sums, not games. Where games are drawn,
    the number of a game is that of its draws."""
    if config.unit == "games":
        alone = _numbered_games(played.select("cluster", "first", "second", "score")).select("n", "first", "second", F.col("score").alias("won"), F.lit(1).cast("long").alias("n_games"))
        draws, parts = _drawn(played.sparkSession, alone.count(), config)
        drawn = alone.repartition(parts, "n").join(draws, "n").drop("n")
    else:
        played = units(played, config.unit)
        drawn = _weighted(played.groupBy("cluster", "first", "second").agg(F.sum("score").alias("won"), F.count("*").alias("n_games")), played, config)
    half = drawn.groupBy("rep", "first", "second").agg(F.sum(F.col("weight") * F.col("won")).alias("won"), F.sum(F.col("weight") * F.col("n_games")).cast("double").alias("games"))
    sides = F.array(F.struct(F.col("first").alias("item"), F.col("second").alias("opponent"), F.col("won").alias("wins")), F.struct(F.col("second").alias("item"), F.col("first").alias("opponent"), (F.col("games") - F.col("won")).alias("wins")))
    return half.select("rep", "games", F.explode(sides).alias("s")).select("rep", "s.item", "s.opponent", "s.wins", "games")


def intervals(estimates: DataFrame, level: float = 0.95) -> DataFrame:
    """item, ci_lower, ci_upper, rank_lower, rank_upper from estimates(rep, item, estimate): percentiles with linear
    interpolation; ranks are 1 and the number of strictly better items."""
    tail = (1 - level) / 2
    ranked = estimates.withColumn("place", F.rank().over(Window.partitionBy("rep").orderBy(F.desc("estimate"))).cast("double"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return ranked.groupBy("item").agg(
        q("estimate", tail).alias("ci_lower"), q("estimate", 1 - tail).alias("ci_upper"), F.floor(q("place", tail)).cast("long").alias("rank_lower"), F.ceil(q("place", 1 - tail)).cast("long").alias("rank_upper")
    )


def bootstrap_bradley_terry(played: DataFrame, config: BootstrapConfig = BootstrapConfig(), fit: BradleyTerryConfig = BradleyTerryConfig()) -> DataFrame:
    """item, strength, ci_lower, ci_upper, rank_lower, rank_upper, unconverged."""
    refits = bradley_terry(replicate_matrices(played, config), fit, ["rep"])
    point = bradley_terry(win_matrix(played), fit).select("item", "strength")
    late = refits.groupBy("item").agg(F.count_if(~F.col("converged")).alias("unconverged"))
    return point.join(intervals(refits.withColumnRenamed("strength", "estimate"), config.level), "item", "left").join(late, "item", "left")


def bootstrap_elo(played: DataFrame, config: BootstrapConfig = BootstrapConfig(), rating: EloConfig = EloConfig(), permutations: int = 10) -> DataFrame:
    """item, rating, ci_lower, ci_upper, rank_lower, rank_upper: each replicate averages seeded random orders of its games, of which
    its task gets the number of each kind. All orders of a task are stepped side by side."""
    spark = played.sparkSession
    with scratch(spark):
        played = staged(played.select("cluster", "first", "second", "score"))
        names, kinds, games = _coded(units(played, config.unit))
        games = staged(games)
        drawn = _weighted(games.groupBy("cluster", "code").agg(F.count("*").alias("copies")), games, config)
        counts = drawn.groupBy("rep", "code").agg(F.sum(F.col("copies") * F.col("weight")).alias("copies")).join(kinds, "code")
        tasks = min(config.n_replicates, max(spark.sparkContext.defaultParallelism, -(-config.n_replicates * permutations // _SIDE_BY_SIDE)))
        refits = staged(_random_passes(names, counts, max(1, tasks), [config.seed, 2], permutations, rating).withColumnRenamed("rating", "estimate"))
        return lasting(elo(played, rating).select("item", "rating").join(intervals(refits, config.level), "item", "left"))


def kendall_tau(scores: DataFrame, x: str, y: str, block_rows: int = 1 << 16) -> DataFrame:
    """tau: tau-a over all pairs of rows of scores(item, x, y); ties count 0; rows that lack a number are left out; null with fewer than two.

    In the order of x (then y) a pair is discordant where y falls, so discordant pairs are the inversions of the places by y; what
    ties leave of the others is concordant. Rows alike in both are told apart by item, so that none is a hot key."""
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)  # noqa: E731  (no negative zeros)
    rows = scores.select("item", number(x).alias("x"), number(y).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    with scratch(scores.sparkSession):
        by_x = numbered(rows, [F.asc("x"), F.asc("y"), F.asc("item")], "place")
        both = staged(numbered(by_x, [F.asc("y"), F.asc("place")], "value"))
        n = both.count()
        alike = both.groupBy("x", "y").agg(F.count("*").alias("n"))
        tied = lambda by: alike.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("t" + "".join(by)))
        facts = tied(["x"]).crossJoin(tied(["y"])).crossJoin(tied(["x", "y"])).crossJoin(inversions(both, n, block_rows))  # one row each
        pairs = F.lit(n * (n - 1) / 2)
        tau = (pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("n").cast("double")) / pairs
        return lasting(facts.select((tau if n > 1 else F.lit(None).cast("double")).alias("tau")))


def rank_rows(played: DataFrame, truth: DataFrame | None = None, config: BootstrapConfig = BootstrapConfig(), fit: BradleyTerryConfig = BradleyTerryConfig(), method: str = "bradley_terry") -> DataFrame:
    """place, item, estimate, interval, rank range, score, games, and true_rank where truth(item, strength) is given.
    A ranking without games is an error."""
    if played.isEmpty():
        raise ValueError("no games are left to rank")
    fitted = bootstrap_bradley_terry(played, config, fit).withColumnRenamed("strength", "estimate") if method == "bradley_terry" else bootstrap_elo(played, config).withColumnRenamed("rating", "estimate")
    rows = fitted.drop("unconverged").join(item_scores(win_matrix(played)), "item")
    rows = numbered(rows, [F.desc("estimate"), F.asc("item")], "place").withColumn("place", F.col("place") + 1)
    if truth is not None:
        true = numbered(truth.select("item", "strength"), [F.desc("strength"), F.asc("item")], "true_rank").select("item", (F.col("true_rank") + 1).alias("true_rank"))
        rows = rows.join(true, "item", "left")
    return rows


def report_facts(played: DataFrame, rows: DataFrame, truth: DataFrame | None = None, method: str = "bradley_terry") -> DataFrame:
    """One row: n_games, n_ties, n_items, n_clusters, the fit gap of a Bradley-Terry ranking's rows(item, estimate), and Kendall's tau against truth(item, strength); null where there is none."""
    out = played.agg(F.count("*").alias("n_games"), F.count_if(F.col("score") == 0.5).alias("n_ties"), F.count_distinct("cluster").alias("n_clusters"))
    out = out.crossJoin(rows.agg(F.count("*").alias("n_items")))  # one row each
    gap = fit_gap(win_matrix(played), rows.select("item", F.col("estimate").alias("strength"))) if method == "bradley_terry" else out.select(F.lit(None).cast("double").alias("fit_gap"))
    tau = kendall_tau(rows.select("item", "estimate").join(truth, "item"), "estimate", "strength") if truth is not None else out.select(F.lit(None).cast("double").alias("tau"))
    return out.crossJoin(gap).crossJoin(tau)


def sample_games(strengths: dict[str, float], spark, n_clusters: int, games_per_pair: int = 1, cluster_sd: float = 0.0, tie_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """Games drawn from known strengths: each pair meets in each cluster, in which strengths may be shifted."""
    items = spark.createDataFrame(sorted(strengths.items()), "item string, strength double")
    clusters = spark.range(n_clusters).select(F.concat(F.lit("c"), "id").alias("cluster"))
    normal = F.sqrt(-2 * F.log(F.greatest(hash_unit(seed, "r", F.col("cluster"), F.col("item")), F.lit(1e-12)))) * F.cos(2 * F.pi() * hash_unit(seed, "a", F.col("cluster"), F.col("item")))
    placed = clusters.crossJoin(F.broadcast(items)).withColumn("strength", F.col("strength") + cluster_sd * normal)
    x = placed.select("cluster", F.col("item").alias("first"), F.col("strength").alias("x"))
    y = placed.select("cluster", F.col("item").alias("second"), F.col("strength").alias("y"))
    pairs = x.join(y, "cluster").where("first < second").withColumn("game", F.explode(F.sequence(F.lit(1), F.lit(games_per_pair))))
    key = [F.col(c) for c in ("cluster", "first", "second", "game")]
    win = hash_unit(seed, "w", *key) < 1 / (1 + F.exp(F.col("y") - F.col("x")))
    score = F.when(hash_unit(seed, "t", *key) < tie_rate, 0.5).when(win, 1.0).otherwise(0.0)
    return pairs.select("cluster", "first", "second", score.alias("score"))
