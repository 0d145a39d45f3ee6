"""Integrity rules of preference tables, as one frame of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names that choices and kinds can have, and the form of an id.
CHOICES = ("left", "right", "tie", "skip")
KINDS = ("regular", "control", "gold")
ID_FORM = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"


def violations(prompts: DataFrame, responses: DataFrame, annotators: DataFrame, sessions: DataFrame, gold_pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """table, id, rule: empty for valid tables. Keys, references, names and controls."""

    def breach(rows: DataFrame, table: str, rule: str) -> DataFrame:
        return rows.select(F.lit(table).alias("table"), F.col("id").cast("string").alias("id"), F.lit(rule).alias("rule"))

    frames = {"prompts": prompts, "responses": responses, "annotators": annotators, "sessions": sessions, "gold_pairs": gold_pairs, "judgments": judgments}
    out = []
    for name, frame in frames.items():
        out.append(breach(frame.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), name, "primary_key"))
        out.append(breach(frame.where(F.col("id").isNull() | ~F.col("id").rlike(ID_FORM)), name, "id_form"))
    known = responses.select("prompt_id", F.col("id").alias("r"))
    refs = lambda df, c: df.join(known.withColumnRenamed("r", c), ["prompt_id", c], "left_anti")
    out.append(breach(responses.join(prompts.select(F.col("id").alias("prompt_id")), "prompt_id", "left_anti"), "responses", "prompt_exists"))
    for side in ("left_response_id", "right_response_id"):
        out.append(breach(refs(judgments, side), "judgments", f"{side}_of_prompt"))
    for side in ("better_response_id", "worse_response_id"):
        out.append(breach(refs(gold_pairs, side), "gold_pairs", f"{side}_of_prompt"))
    out.append(breach(sessions.join(annotators.select(F.col("id").alias("annotator_id")), "annotator_id", "left_anti"), "sessions", "annotator_exists"))
    owners = sessions.select(F.col("id").alias("session_id"), "annotator_id")
    out.append(breach(judgments.join(owners, ["session_id", "annotator_id"], "left_anti"), "judgments", "session_of_annotator"))
    out.append(breach(judgments.where(~F.col("choice").isin(*CHOICES) | ~F.col("pair_kind").isin(*KINDS)), "judgments", "names"))
    out.append(breach(judgments.where("left_response_id = right_response_id"), "judgments", "two_responses"))
    out.append(breach(judgments.where("(pair_kind = 'control') <> (repeat_of is not null) or repeat_of = id"), "judgments", "control_repeats"))
    pair = [F.least("left_response_id", "right_response_id").alias("a"), F.greatest("left_response_id", "right_response_id").alias("b")]
    original = judgments.select(F.col("id").alias("repeat_of"), "annotator_id", "prompt_id", *pair)
    controls = judgments.where("repeat_of is not null").select("id", "repeat_of", "annotator_id", "prompt_id", *pair)
    out.append(breach(controls.join(original, ["repeat_of", "annotator_id", "prompt_id", "a", "b"], "left_anti"), "judgments", "control_of_same_pair"))
    twice = gold_pairs.groupBy("prompt_id", F.least("better_response_id", "worse_response_id").alias("a"), F.greatest("better_response_id", "worse_response_id").alias("b")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    out.append(breach(twice, "gold_pairs", "one_for_a_pair"))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


_PAIR = ("prompt_id", "id")
#: What records refer to: a kind and its columns, the kind referred to and its columns. `pair` is made of both sides.
REFERENCES = (
    ("response", ("prompt_id",), "prompt", ("id",)),
    ("session", ("annotator_id",), "annotator", ("id",)),
    ("gold", ("prompt_id", "better_response_id"), "response", _PAIR),
    ("gold", ("prompt_id", "worse_response_id"), "response", _PAIR),
    ("pairwise", ("prompt_id", "left_response_id"), "response", _PAIR),
    ("pairwise", ("prompt_id", "right_response_id"), "response", _PAIR),
    ("pairwise", ("session_id", "annotator_id"), "session", ("id", "annotator_id")),
    ("pairwise", ("repeat_of", "annotator_id", "prompt_id", "pair"), "pairwise", ("id", "annotator_id", "prompt_id", "pair")),
    ("ranked", ("session_id", "annotator_id"), "session", ("id", "annotator_id")),
    ("ranked", ("prompt_id", "shown"), "response", _PAIR),
)


def _sides(kind: str, rows: DataFrame) -> DataFrame:
    if kind == "pairwise":
        return rows.withColumn("pair", F.array_sort(F.array("left_response_id", "right_response_id")))
    if kind == "gold":
        return rows.withColumn("pair", F.array_sort(F.array("better_response_id", "worse_response_id")))
    return rows.withColumn("shown", F.explode("shown")) if kind == "ranked" else rows


def dangling(new: dict[str, DataFrame], known: dict[str, DataFrame]) -> DataFrame:
    """kind, id, rule of new records whose references are not in known (which holds the new ones, too), and of gold pairs that
    are there twice. A missing `repeat_of` refers to nothing."""
    out = None
    for kind, columns, target, keys in REFERENCES:
        if kind in new:
            own = _sides(kind, new[kind]).where(F.col(columns[0]).isNotNull()).select("id", *(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)))
            there = _sides(target, known[target]).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
            lost = own.join(there, [f"k{i}" for i in range(len(keys))], "left_anti")
            lost = lost.select(F.lit(kind).alias("kind"), "id", F.lit(f"{', '.join(columns)}: no such {target}").alias("rule"))
            out = lost if out is None else out.unionByName(lost)
    if "gold" in new:
        twice = _sides("gold", known["gold"]).groupBy("prompt_id", "pair").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
        out = out.unionByName(twice.select(F.lit("gold").alias("kind"), "id", F.lit("pair: has a gold answer").alias("rule")))
    return out


def cyclic(controls: DataFrame, keep) -> DataFrame:
    """Of controls(id, repeat_of) those that repeat each other in a circle or lead into one. Each turn goes twice as far
    back; keep(rows, turn) writes rows down and reads them again."""
    own = controls.select("id", "repeat_of")
    left, turn = keep(own.join(own.select(F.col("id").alias("repeat_of")), "repeat_of", "left_semi"), 0), 0
    n, before = left.count(), -1
    while n and n != before:
        turn += 1
        further = left.select(F.col("id").alias("repeat_of"), F.col("repeat_of").alias("far"))
        left = keep(left.join(further, "repeat_of").select("id", F.col("far").alias("repeat_of")), turn)
        n, before = left.count(), n
    return left.select("id")
