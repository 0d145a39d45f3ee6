"""The card of an export: what was counted, dropped, split and left out, as JSON and Markdown. It carries no time, so the
same input gives the same files. Everything in it is bounded: reasons, splits, models and left-out annotators."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..operators.export import FilterConfig, SplitConfig, card_provenance, card_splits, card_summary, drop_counts


def card(decided: DataFrame, judgments: DataFrame, responses: DataFrame, filters: FilterConfig, splits: SplitConfig = SplitConfig(), left_out: dict[str, str] | None = None) -> dict:
    """left_out: why annotators have no vote, by annotator."""
    rows = lambda frame, *order: [r.asDict() for r in frame.orderBy(*order).collect()]
    return {
        "filters": {**asdict(filters), "exclude_annotators": sorted(filters.exclude_annotators), "pair_kinds": sorted(filters.pair_kinds)},
        "split_config": asdict(splits),
        "summary": card_summary(decided, judgments).first().asDict(),
        "dropped": {r["reason"]: r["n"] for r in drop_counts(decided).collect()},
        "splits": rows(card_splits(decided, splits), "split"),
        "provenance": rows(card_provenance(decided, responses), "model", "source"),
        "left_out": dict(sorted((left_out or {}).items())),
    }


def markdown(found: dict) -> str:
    number = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    def block(title: str, head: list[str], rows: list[list]) -> str:
        cells = [head, ["---"] * len(head), *([number(v) for v in r] for r in rows)]
        return f"## {title}\n\n" + "\n".join("| " + " | ".join(c) + " |" for c in cells) + "\n"

    listed = lambda v: ", ".join(map(str, v)) or "none" if isinstance(v, list) else v
    parts = [
        "# Preference dataset\n",
        block("Counts", ["what", "value"], [[k, v] for k, v in found["summary"].items()]),
        block("Filters", ["filter", "value"], [[k, listed(v)] for k, v in found["filters"].items()]),
        block("Dropped pairs", ["reason", "pairs"], [[k, v] for k, v in sorted(found["dropped"].items())]),
        block("Splits", ["split", "prompts", "pairs"], [[r["split"], r["n_prompts"], r["n_pairs"]] for r in found["splits"]]),
        block("Responses", ["model", "source", "responses"], [[r["model"], r["source"], r["n"]] for r in found["provenance"]]),
        block("Left out annotators", ["annotator", "reason"], [[k, v] for k, v in found["left_out"].items()]),
    ]
    return "\n".join(parts)


def write_card(spark: SparkSession, found: dict, folder: str) -> None:
    """card.json and card.md in a folder of any file system that Spark writes to."""
    for name, text in (("card.json", json.dumps(found, indent=2, sort_keys=True) + "\n"), ("card.md", markdown(found))):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
