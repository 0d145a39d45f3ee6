"""Record kinds and JSON lines: a typed scan with checks, and the canonical dump.

One object a line, with a `type`. Lines are parsed by Spark against the schema of their kind; what is wrong with
lines is a frame of (line_no, message), and reading fails on its first row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .validation import CHOICES, ID_FORM, KINDS

PROVENANCE = "struct<source: string, generator: string, temperature: double, top_p: double, max_tokens: bigint, seed: bigint, generated_at: timestamp, origin: string>"

#: Fields of each kind in the order in which kinds refer to each other; `!` marks those that a record must have.
FIELDS: dict[str, dict[str, str]] = {
    "prompt": {"id!": "string", "text!": "string", "category": "string", "tags": "array<string>"},
    "response": {"id!": "string", "prompt_id!": "string", "model!": "string", "text!": "string", "provenance!": PROVENANCE},
    "annotator": {"id!": "string", "kind": "string", "display_name": "string"},
    "session": {"id!": "string", "annotator_id!": "string", "client!": "string", "started_at!": "timestamp", "ended_at": "timestamp"},
    "gold": {"id!": "string", "prompt_id!": "string", "better_response_id!": "string", "worse_response_id!": "string", "reason": "string"},
    "pairwise": {
        "id!": "string", "session_id!": "string", "annotator_id!": "string", "prompt_id!": "string", "left_response_id!": "string", "right_response_id!": "string", "choice!": "string",
        "pair_kind": "string", "repeat_of": "string", "rationale": "string", "latency_ms": "bigint", "created_at!": "timestamp",
    },
    "ranked": {"id!": "string", "session_id!": "string", "annotator_id!": "string", "prompt_id!": "string", "shown!": "array<string>", "ranking!": "array<string>", "rationale": "string", "latency_ms": "bigint", "created_at!": "timestamp"},
}
#: What a record has where it says nothing.
DEFAULTS = {"annotator": {"kind": "human"}, "pairwise": {"pair_kind": "regular"}}
_TRIM = r"(?U)^\s+|\s+$"


class RecordError(ValueError):
    """A line that is no record."""


def names(kind: str) -> list[str]:
    return [f.rstrip("!") for f in FIELDS[kind]]


def schema_of(kind: str) -> str:
    return ", ".join(f"{f.rstrip('!')} {t}" for f, t in FIELDS[kind].items())


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of the lines that aren't blank. A line's number is its place in its split of the file, and the lines of the splits
    before, of which Spark counts each; where there are several files, they follow each other by path."""
    block = ["file", "start"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("spot"))
    # one row for each split, which is what the driver plans tasks by, too
    sizes = rows.groupBy(*block).agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select(*block, "first", before.alias("before"))), block)
    rows = rows.select((F.col("before") + F.col("spot") - F.col("first") + 1).alias("line_no"), F.regexp_replace("value", _TRIM, "").alias("value"))
    return rows.where("value <> ''")


#: What a value in JSON is called for each type of a field, as a pattern of Spark's names for variants.
_FORMS = {
    "string": (r"STRING", "a string"),
    "timestamp": (r"STRING", "a time as a string"),
    "bigint": (r"BIGINT", "a whole number"),
    "double": (r"BIGINT|DOUBLE|DECIMAL.*", "a number"),
    "array<string>": (r"ARRAY<(STRING|VOID)>", "a list of strings"),
    "struct": (r"OBJECT<.*>", "an object"),
}


def _type_faults(kind: str) -> list[Column]:
    """A message for each field of `json` whose value is of another type than its kind says; nulls are left to other rules."""

    def fault(path: str, own: str) -> Column:
        pattern, name = _FORMS[own]
        form = F.schema_of_variant(F.try_variant_get("json", f"$.{path}", "variant"))
        return F.when(~form.rlike(f"^({pattern}|VOID)$"), F.lit(f"{path}: not {name}"))

    found = []
    for field, own in FIELDS[kind].items():
        n = field.rstrip("!")
        found.append(fault(n, "struct" if own == PROVENANCE else own))
        if own == PROVENANCE:
            found += [fault(f"{n}.{part.split(': ')[0]}", part.split(": ")[1]) for part in PROVENANCE[len("struct<") : -1].split(", ")]
    if kind == "prompt":
        form = F.schema_of_variant(F.try_variant_get("json", "$.responses", "variant"))
        found.append(F.when(~form.rlike(r"^ARRAY<(OBJECT<.*>|VOID)>$"), F.lit("responses: not a list of objects")))
    return found


def _unnested(lines: DataFrame) -> DataFrame:
    """line_no, place (of an inline response), type, object: prompts' inline responses become lines of their own."""
    keys = F.from_json("value", "map<string,string>")
    rows = lines.select("line_no", F.lit(0).alias("place"), F.get_json_object("value", "$.type").alias("type"), F.col("value").alias("object"), keys.alias("keys"))
    inline = rows.where("type = 'prompt'").select("line_no", F.posexplode(F.from_json(F.get_json_object("object", "$.responses"), "array<string>")).alias("place", "object"), F.get_json_object("object", "$.id").alias("parent"))
    declared = F.get_json_object("object", "$.prompt_id")
    inline = inline.select("line_no", (F.col("place") + 1).alias("place"), F.lit("response").alias("type"), "object", F.from_json("object", "map<string,string>").alias("keys"), "parent", (declared.isNotNull() & (declared != F.col("parent"))).alias("other_parent"))
    return rows.withColumns({"parent": F.lit(None).cast("string"), "other_parent": F.lit(False)}).unionByName(inline)


def _typed(rows: DataFrame, kind: str) -> DataFrame:
    record = F.from_json("object", schema_of(kind))
    own = rows.where(F.col("type") == kind).select("line_no", "place", "keys", "parent", "other_parent", "object", record.alias("r"))
    columns = {n: F.col(f"r.{n}") for n in names(kind)}
    if kind == "response":
        columns["prompt_id"] = F.coalesce(columns["prompt_id"], F.col("parent"))
    for n, value in DEFAULTS.get(kind, {}).items():
        columns[n] = F.coalesce(columns[n], F.lit(value))
    for n in ("category", "model", "display_name", "rationale"):
        if n in columns:  # labels and rationales are trimmed, blank ones are none
            columns[n] = F.nullif(F.regexp_replace(columns[n], _TRIM, ""), F.lit(""))
    return own.select("line_no", "place", "keys", "other_parent", "object", *(c.alias(n) for n, c in columns.items()))


def _rules(kind: str) -> list[tuple[Column, str]]:
    c = F.col
    rules: list[tuple[Column, str]] = []
    for field in FIELDS[kind]:
        n = field.rstrip("!")
        if field.endswith("!"):
            rules.append((c(n).isNull(), f"{n}: field required"))
        if n == "id" or n.endswith("_id") or n == "repeat_of":
            rules.append((~c(n).rlike(ID_FORM), f"{n}: not an id"))
        if n == "text":
            rules.append(((F.regexp_replace(n, _TRIM, "") == "") | (F.char_length(n) > 200_000), "text: blank or too long"))
        if n in ("category", "model", "display_name", "client"):
            rules.append((F.char_length(n) > 200, f"{n}: too long"))
        if n == "rationale":
            rules.append((F.char_length(n) > 2000, "rationale: too long"))
        if n == "latency_ms":
            rules.append((c(n) < 0, "latency_ms: negative"))
    if kind == "response":
        p = "provenance"
        rules += [(c("other_parent"), "prompt_id does not match the enclosing prompt"), (c(f"{p}.temperature") < 0, "temperature: negative"), ((c(f"{p}.top_p") <= 0) | (c(f"{p}.top_p") > 1), "top_p: not in (0, 1]"), (c(f"{p}.max_tokens") <= 0, "max_tokens: not positive")]
    if kind == "annotator":
        rules.append((~c("kind").isin("human", "simulated"), "kind: unknown"))
    if kind == "session":
        rules += [(~c("client").isin("cli", "web", "simulator", "import"), "client: unknown"), (c("ended_at") < c("started_at"), "a session ends before it starts")]
    if kind == "gold":
        rules.append((c("better_response_id") == c("worse_response_id"), "both sides are the same response"))
    if kind == "pairwise":
        rules += [
            (~c("choice").isin(*CHOICES), "choice: unknown"),
            (~c("pair_kind").isin(*KINDS), "pair_kind: unknown"),
            (c("left_response_id") == c("right_response_id"), "both sides are the same response"),
            ((c("pair_kind") == "control") != c("repeat_of").isNotNull(), "controls, and only they, repeat a judgment"),
            (c("repeat_of") == c("id"), "a judgment repeats itself"),
        ]
    if kind == "ranked":
        rules += [((F.size("shown") < 2) | (F.size("shown") > 20), "shown: 2 to 20 responses"), (F.size(F.array_distinct("shown")) != F.size("shown"), "shown: repeated"), (F.array_sort("ranking") != F.array_sort("shown"), "ranking: not an order of shown")]
    return rules


def record_errors(lines: DataFrame) -> DataFrame:
    """line_no, message of everything that is wrong, each line's first fault first."""
    rows = _unnested(lines)
    broken = rows.where("keys is null").select("line_no", F.lit("not a JSON object").alias("message"))
    unknown = rows.where(F.col("keys").isNotNull() & (F.col("type").isNull() | ~F.col("type").isin(*FIELDS))).select("line_no", F.concat(F.lit("unknown or missing type "), F.coalesce("type", F.lit("none"))).alias("message"))
    out = broken.unionByName(unknown)
    for kind in FIELDS:
        allowed = [*names(kind), "type"] + ["responses"] * (kind == "prompt")
        extra = F.array_except(F.map_keys("keys"), F.array(*map(F.lit, allowed)))
        faults = F.filter(F.array(F.when(F.size(extra) > 0, F.concat(F.lit("unknown field "), F.array_join(extra, ", "))), *_type_faults(kind), *(F.when(bad, text) for bad, text in _rules(kind))), lambda x: x.isNotNull())
        typed = _typed(rows.where("keys is not null"), kind).withColumn("json", F.try_parse_json("object"))
        found = typed.select("line_no", faults.alias("faults")).where(F.size("faults") > 0)
        out = out.unionByName(found.select("line_no", F.concat(F.lit(f"invalid {kind}: "), F.array_join("faults", "; ")).alias("message")))
    return out


def read_records(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A frame for each kind, with seq (the order of lines). Raises RecordError for the first bad line."""
    lines = lines_of(spark, path)
    first = record_errors(lines).orderBy("line_no", "message").first()
    if first:
        raise RecordError(f"line {first['line_no']}: {first['message']}")
    rows = _unnested(lines)
    seq = F.col("line_no") * 1_000_000 + F.col("place")
    return {kind: _typed(rows, kind).select(*names(kind), seq.alias("seq")) for kind in FIELDS}


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Sorted keys, ASCII, no spaces, no nulls. Numbers are printed as Python prints them, which the JVM doesn't."""

    def clean(x):
        return {k: clean(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x

    return values.map(lambda v: json.dumps(clean(json.loads(v)), sort_keys=True, ensure_ascii=True, separators=(",", ":")))


def dump_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """value: canonical lines of all records, kinds in the order of references, records in that of seq."""
    out = None
    for place, kind in enumerate(FIELDS):
        if kind in tables:
            record = F.to_json(F.struct(F.lit(kind).alias("type"), *names(kind)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
            rows = tables[kind].select(F.lit(place).alias("place"), "seq", canonical_json(record).alias("value"))
            out = rows if out is None else out.unionByName(rows)
    return out.orderBy("place", "seq").select("value")
