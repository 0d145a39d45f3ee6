"""Graphs as frames of edges: weak and strong components by labels that travel along edges, written out in each round."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import lasting, scratch, staged


def _spread(nodes: DataFrame, arcs: DataFrame, keys: list[str], best) -> DataFrame:
    """nodes(*keys, node, label) after labels have gone along arcs(*keys, source, target) until none changes: `best` of all that reach a
    node, which are that node's own and its predecessors'."""
    while True:
        with_source = nodes.select(*keys, F.col("node").alias("source"), F.col("label").alias("seen"))
        arrived = arcs.join(with_source, [*keys, "source"]).groupBy(*keys, F.col("target").alias("node")).agg(best("seen").alias("seen"))
        better = F.coalesce(best_of(best, F.col("label"), F.col("seen")), F.col("label"))
        nodes = staged(nodes.join(arrived, [*keys, "node"], "left").select(*keys, "node", better.alias("label"), (better != F.col("label")).alias("moved")))
        if nodes.where("moved").isEmpty():
            return nodes.drop("moved")
        nodes = nodes.drop("moved")


def best_of(best, x: Column, y: Column) -> Column:
    """The better of two columns, of which the second may be null."""
    return F.greatest(x, y) if best is F.max else F.least(x, y)


def weak_components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges(x, y) lead to in either direction. Labels go along edges, and then
    jump to the label of the node they name, so that long chains take few rounds."""
    with scratch(edges.sparkSession):
        ends = F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))).alias("e")
        arcs = staged(edges.select(ends).select("e.node", "e.other").distinct())
        nodes = staged(arcs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
        while True:
            seen = nodes.select(F.col("node").alias("other"), F.col("label").alias("seen"))
            least = arcs.join(seen, "other").groupBy("node").agg(F.min("seen").alias("seen"))
            near = nodes.join(least, "node").select("node", "label", F.least("label", "seen").alias("low"))
            far = nodes.select(F.col("node").alias("low"), F.col("label").alias("lower"))
            moved = staged(near.join(far, "low", "left").select("node", "label", F.least("low", F.coalesce("lower", "low")).alias("low")))
            nodes = moved.select("node", F.col("low").alias("label"))
            if moved.where("low <> label").isEmpty():
                return lasting(nodes)


def strong_labels(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A number for each of n nodes, the same for those that reach each other (Gabow's walk along paths, in time of nodes and arcs)."""
    order = np.argsort(source, kind="stable")
    heads, starts = target[order].tolist(), np.searchsorted(source[order], np.arange(n + 1)).tolist()
    following, seen, label, clock = starts[:n], [0] * n, [-1] * n, 0
    open_, path = [], []
    for root in range(n):
        calls = [] if seen[root] else [root]
        while calls:
            v = calls[-1]
            if not seen[v]:
                clock += 1
                seen[v] = clock
                open_.append(v)
                path.append(v)
            while following[v] < starts[v + 1]:
                w = heads[following[v]]
                following[v] += 1
                if not seen[w]:
                    calls.append(w)
                    break
                if label[w] < 0:
                    while seen[path[-1]] > seen[w]:
                        path.pop()
            else:
                calls.pop()
                if path[-1] == v:
                    path.pop()
                    while label[v] < 0:
                        label[open_.pop()] = v
    return np.array(label, int)


def _strong_in_tasks(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """As `strong_components`, of arcs(_task, *keys, source, target): no arc leads from a task to another."""
    kinds = {f.name: f.dataType.simpleString() for f in arcs.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([group[[*keys, end]].set_axis([*keys, "node"], axis=1) for end in ("source", "target")], ignore_index=True)
        codes = ends.groupby([*keys, "node"], sort=False, dropna=False).ngroup().to_numpy()
        _, shown = np.unique(codes, return_index=True)
        label = strong_labels(len(shown), codes[: len(group)], codes[len(group) :])
        nodes = ends.iloc[shown].reset_index(drop=True)
        names, rank = np.unique(nodes["node"].to_numpy(), return_inverse=True)
        greatest = np.zeros(len(label), int)
        np.maximum.at(greatest, label, rank)
        return nodes.assign(component=names[greatest[label]])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"node {kinds['source']}", f"component {kinds['source']}"])
    return arcs.groupBy("_task").applyInPandas(run, schema)


def strong_components(arcs: DataFrame, by: tuple[str, ...] = (), task_rows: int = 20_000) -> DataFrame:
    """*by, node, component of arcs(*by, source, target): component is the greatest node of those that reach each other.

    Arcs fall into weak components. Many of up to `task_rows` arcs make a task; what is larger is looked at by frames."""
    keys = list(by)
    with scratch(arcs.sparkSession):
        arcs = staged(arcs.select(*keys, "source", "target").where("source <> target").distinct())
        labels = weak_components(arcs.select(F.col("source").alias("x"), F.col("target").alias("y")).distinct())
        placed = staged(arcs.join(labels.withColumnRenamed("node", "source"), "source"))
        large = staged(placed.groupBy(*keys, "label").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).drop("n"))
        if large.isEmpty():
            small, by_frames = placed, None
        else:
            same = [placed[c].eqNullSafe(large[c]) for c in (*keys, "label")]
            small, by_frames = placed.join(large, same, "left_anti"), _strong_by_frames(placed.join(large, same, "left_semi").drop("label"), keys)
        tasks = max(1, -(-arcs.count() // max(1, task_rows)))
        out = _strong_in_tasks(small.withColumn("_task", F.pmod(F.xxhash64(*keys, "label"), F.lit(tasks)).cast("int")), keys)
        return lasting(out if by_frames is None else out.unionByName(by_frames))


def _strong_by_frames(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """As `strong_components`, whatever the size of a component.

    Nodes that no arc enters, or none leaves, are components of their own and go, again and again. Of the rest each takes the greatest
    name that reaches it; a node whose own name it is heads the colour, and what of the colour reaches it by arcs inside of the colour is its
    component. These go too, until nothing is left."""
    with scratch(arcs.sparkSession):
        arcs = staged(arcs.select(*keys, "source", "target").where("source <> target").distinct())
        ends = arcs.select(*keys, F.explode(F.array("source", "target")).alias("node")).distinct()
        left, done = staged(ends), []
        while not left.isEmpty():
            # trim
            while True:
                inside = arcs.join(left.withColumnRenamed("node", "source"), [*keys, "source"], "left_semi").join(left.withColumnRenamed("node", "target"), [*keys, "target"], "left_semi")
                both = inside.select(*keys, F.col("source").alias("node")).intersect(inside.select(*keys, F.col("target").alias("node")))
                kept = staged(both)
                single = left.join(kept, [*keys, "node"], "left_anti")
                done.append(single.select(*keys, "node", F.col("node").alias("component")))
                gone = not single.isEmpty()
                left = kept
                if not gone or left.isEmpty():
                    break
            if left.isEmpty():
                break
            arcs = staged(inside)
            colours = _spread(left.withColumn("label", F.col("node")), arcs, keys, F.max)
            colour_of = lambda end: colours.select(*keys, F.col("node").alias(end), F.col("label").alias(f"c_{end}"))
            same = staged(arcs.join(colour_of("source"), [*keys, "source"]).join(colour_of("target"), [*keys, "target"]).where("c_source = c_target").select(*keys, F.col("target").alias("source"), F.col("source").alias("target")))
            heads = colours.select(*keys, "node", "label", F.when(F.col("node") == F.col("label"), F.lit(1)).otherwise(F.lit(0)).alias("reached"))
            reached = _spread(heads.select(*keys, "node", F.col("reached").alias("label")), same, keys, F.max).withColumnRenamed("label", "reached")
            found = staged(colours.join(reached, [*keys, "node"]).where("reached = 1").select(*keys, "node", F.col("label").alias("component")))
            done.append(found)
            left = staged(left.join(found, [*keys, "node"], "left_anti"))
        out = ends.select(*keys, "node", F.col("node").alias("component")).limit(0) if not done else done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return lasting(out)
