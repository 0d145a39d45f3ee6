"""Scans, stores, sinks, streams, planted annotators and the command line."""

import itertools
import json
import os
import random

import pytest

import __spark_entry__ as entry
from verdictlake.operators import audit, comparisons, ranking
from verdictlake.plans import catalog
from verdictlake.sources import validation
from verdictlake.sources.records import RecordError, read_records
from verdictlake.sources.store import Store, StoreError
from verdictlake.streaming import incremental

PROMPT = {"type": "prompt", "id": "p1", "text": "Ask", "responses": [{"id": "r1", "model": "m", "text": "A", "provenance": {"source": "model"}}, {"id": "r2", "model": "n", "text": "Ünï", "provenance": {"source": "model", "temperature": 0.0005}}]}
REST = [
    {"type": "annotator", "id": "a1"},
    {"type": "session", "id": "s1", "annotator_id": "a1", "client": "import", "started_at": "2025-11-20T16:45:10Z"},
    {"type": "pairwise", "id": "j1", "session_id": "s1", "annotator_id": "a1", "prompt_id": "p1", "left_response_id": "r1", "right_response_id": "r2", "choice": "left", "created_at": "2025-11-20T16:46:02Z", "rationale": "  "},
]


def write(folder, records, name="x.jsonl"):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        for r in records:
            out.write((r if isinstance(r, str) else json.dumps(r)) + "\n\n")
    return path


def test_jsonl_store_round_trip(spark, folder):
    found = read_records(spark, write(folder, [PROMPT, *REST]))
    assert found["response"].count() == 2 and found["pairwise"].first()["pair_kind"] == "regular" and found["pairwise"].first()["rationale"] is None
    store = Store(spark, folder + "/store")
    assert store.add(found).total_added == 6
    again = store.add(found)
    assert (again.total_added, again.unchanged) == (0, 6)
    lines = [r["value"] for r in store.dump().collect()]
    assert len(lines) == 6 and '"temperature":0.0005' in lines[2] and "\\u00dc" in lines[2]
    other = Store(spark, folder + "/other")
    assert other.add(read_records(spark, write(folder, lines, "y.jsonl"))).total_added == 6
    assert [r["value"] for r in other.dump().collect()] == lines
    assert store.get("annotator", "a1")["kind"] == "human"
    with pytest.raises(StoreError, match="other content"):
        store.add(read_records(spark, write(folder, [{"type": "annotator", "id": "a1", "display_name": "z"}], "z.jsonl")))
    with pytest.raises(StoreError, match="no store"):
        Store(spark, folder)


@pytest.mark.parametrize(
    "line, message",
    [
        ({**PROMPT, "text": "\u2003\t"}, "blank"),
        ({"type": "session", "id": "s 2", "annotator_id": "a1", "client": "cli", "started_at": "2025-01-31T23:05:41Z"}, "not an id"),
        ({**REST[0], "colour": "red"}, "unknown field colour"),
        ('["list"]', "JSON"),
        ({"id": "x9"}, "unknown or missing type"),
        ({**REST[2], "choice": "both"}, "choice"),
        ({**PROMPT, "id": 5}, "id: not a string"),
        ({**PROMPT, "tags": "one"}, "tags: not a list of strings"),
        ({**PROMPT, "responses": {}}, "responses: not a list of objects"),
        ({**PROMPT, "responses": [3]}, "responses: not a list of objects"),
        ({**REST[2], "latency_ms": "12"}, "latency_ms: not a whole number"),
        ({"type": "response", "id": "r7", "prompt_id": "p", "model": "m", "text": "t", "provenance": {"source": "model", "temperature": "hot"}}, "provenance.temperature: not a number"),
    ],
)
def test_bad_lines_are_named(spark, folder, line, message):
    with pytest.raises(RecordError, match=f"line 3: .*{message}"):
        read_records(spark, write(folder, [REST[0], line]))


def test_lines_are_numbered_over_splits(spark, folder):
    from verdictlake.sources.records import lines_of

    path = write(folder, [{"type": "annotator", "id": f"a{n}"} for n in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = lines_of(spark, path)
        assert lines.rdd.getNumPartitions() > 3
        assert sorted((r["line_no"], json.loads(r["value"])["id"]) for r in lines.collect()) == [(2 * n + 1, f"a{n}") for n in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_planted_annotators_are_found(spark):
    rng = random.Random(5)
    skill = {f"model-{c}": -k for k, c in enumerate("abcd")}
    responses = spark.createDataFrame([(f"q{p:02d}-{m[-1]}", f"q{p:02d}", m, "word " * rng.randint(5, 40)) for p in range(30) for m in skill], "id string, prompt_id string, model string, text string")
    responses = responses.selectExpr("*", "size(split(trim(text), ' ')) as n_words", "cast(length(text) as long) as n_chars")
    rows = []
    for who in ("good-1", "good-2", "good-3", "good-4", "coin", "contrary"):
        for p in range(30):
            for x, y in itertools.combinations("abcd", 2):
                left, right = (x, y) if rng.random() < 0.5 else (y, x)
                better = skill[f"model-{left}"] > skill[f"model-{right}"]
                left_wins = {"coin": rng.random() < 0.5, "contrary": not better}.get(who, better if rng.random() < 0.9 else not better)
                rows.append((who, f"q{p:02d}", f"q{p:02d}-{left}", f"q{p:02d}-{right}", "left" if left_wins else "right"))
    judged = spark.createDataFrame([(f"j{n:05d}", n, f"s-{r[0]}", *r, "regular", None) for n, r in enumerate(rows)], "id string, seq long, session_id string, annotator_id string, prompt_id string, left_response_id string, right_response_id string, choice string, pair_kind string, repeat_of string").cache()
    fit = ranking.bradley_terry(comparisons.win_matrix(comparisons.games(judged, responses.select("id", "model"))))
    truth = spark.createDataFrame(list(skill.items()), "item string, truth double".replace("double", "long"))
    assert ranking.kendall_tau(fit.join(truth, "item"), "strength", "truth").first()["tau"] == 1.0
    gold = spark.createDataFrame([], "id string, prompt_id string, better_response_id string, worse_response_id string")
    found = {r["annotator_id"]: r["flags"] for r in audit.verdicts(judged, responses, gold).collect()}
    assert found["coin"] and found["contrary"] and not any(found[f"good-{k}"] for k in (1, 2, 3, 4))


def test_streamed_votes_equal_batch(spark, folder):
    from verdictlake.sources.driver_tables import PreferenceTables

    rows = PreferenceTables(spark, entry.SMOKE_DIR).judgments
    rows.repartition(3).write.parquet(folder + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    incremental.start(incremental.running_positions(stream), "positions", folder + "/ck").awaitTermination()
    assert sorted(map(tuple, spark.table("positions").collect())) == sorted(map(tuple, incremental.running_positions(rows).collect()))


def test_every_query_with_sql_matches(spark):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(entry.SMOKE_DIR + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    # all but those that take more than seconds: fits in many turns, and what is compared at the next size
    slow = {"dawid_skene_reliability", "dawid_skene_full", "rank_responses", "scc_summary_responses", "bootstrap_score_ci", "bt_predicted", "bt_fit_gap", "bt_log_likelihood", "kendall_tau_vs_truth", "bt_strengths"}
    for name in sorted(set(catalog.oracle_sql()) - slow):
        got = catalog.queries()[name](spark, entry.SMOKE_DIR).toPandas()
        want = c.execute(catalog.oracle_sql()[name]).df()
        key = sorted(got.columns)
        assert key == sorted(want.columns), name
        norm = lambda d: sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in d[key].itertuples(index=False))  # noqa: E731, B023
        assert norm(got) == norm(want), name


def test_command_line(spark, capsys):
    from verdictlake import cli

    assert cli.run(["stats", entry.SMOKE_DIR]) == 0
    assert "judgments" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no judgments"):
        cli.run(["rank", entry.SMOKE_DIR, "-x", "nobody"])


def _judged(n, left, right, choice, **more):
    return {**REST[2], "id": f"j{n}", "left_response_id": left, "right_response_id": right, "choice": choice, **more}


def test_references_are_checked(spark, folder):
    store = Store(spark, folder + "/s")
    store.add(read_records(spark, write(folder, [PROMPT, *REST], "a.jsonl")))
    lost = [
        _judged(2, "r1", "r9", "left"),
        _judged(3, "r1", "r2", "left", session_id="s9"),
        _judged(4, "r2", "r1", "left", pair_kind="control", repeat_of="j8"),
        {"type": "gold", "id": "g1", "prompt_id": "p2", "better_response_id": "r1", "worse_response_id": "r2"},
    ]
    found = read_records(spark, write(folder, lost, "lost.jsonl"))
    new = {kind: found[kind] for kind in ("gold", "pairwise")}
    known = {kind: store.table(kind).unionByName(rows) for kind, rows in found.items()}
    rules = {(r["id"], r["rule"].split(":")[0]) for r in validation.dangling(new, known).collect()}
    assert rules == {("j2", "prompt_id, right_response_id"), ("j3", "session_id, annotator_id"), ("j4", "repeat_of, annotator_id, prompt_id, pair"), ("g1", "prompt_id, better_response_id"), ("g1", "prompt_id, worse_response_id")}
    with pytest.raises(StoreError, match="g1: prompt_id"):
        store.add(found)
    ring = [_judged(5, "r1", "r2", "left", pair_kind="control", repeat_of="j6"), _judged(6, "r2", "r1", "left", pair_kind="control", repeat_of="j5")]
    with pytest.raises(StoreError, match="j5: repeats itself"):
        store.add(read_records(spark, write(folder, ring, "ring.jsonl")))
    chain = [_judged(7, "r1", "r2", "left", pair_kind="control", repeat_of="j8"), _judged(8, "r2", "r1", "left", pair_kind="control", repeat_of="j1")]
    assert store.add(read_records(spark, write(folder, chain, "chain.jsonl"))).total_added == 2
    assert store.table("pairwise").count() == 3 and not [f for f in os.listdir(folder + "/s") if f.startswith("_checks")]
    assert [r["id"] for r in store.ordered("pairwise").collect()] == ["j1", "j7", "j8"]


def test_split_files_are_the_same_bytes_again(spark, folder):
    import hashlib

    from verdictlake.sources.split_files import write_splits

    rows = spark.range(500).selectExpr("if(id % 5 = 0, 'test', 'train') as split", "concat('p', id % 37) as prompt_id", "concat('r', id) as a_id", "if(id % 3 = 0, null, 'é\n') as text")
    first = write_splits(rows.repartition(7), folder + "/a", rows_per_file=90)
    second = write_splits(rows.repartition(2).orderBy("text"), folder + "/b", rows_per_file=90)
    assert first == second and sorted(first) == ["all", *(f"test-0000{k}.jsonl" for k in range(2)), *(f"train-0000{k}.jsonl" for k in range(5)), "validation-00000.jsonl"]
    lines = []
    for name in sorted(first)[1:]:
        with open(f"{folder}/a/{name}", "rb") as f:
            data = f.read()
        assert hashlib.sha256(data).hexdigest() == first[name]
        own = [json.loads(x) for x in data.decode().splitlines()]
        assert own == sorted(own, key=lambda r: (r["prompt_id"], r["a_id"])) and all("text" in r for r in own)
        lines += own
    assert len(lines) == 500 and os.path.getsize(folder + "/a/validation-00000.jsonl") == 0 and set(os.listdir(folder + "/a")) >= {"digests.json"} and "_files" not in os.listdir(folder + "/a")
    with pytest.raises(ValueError, match="already there"):
        write_splits(rows, folder + "/a")


def test_reports_over_a_store(spark, folder, capsys):
    from verdictlake import cli

    root = folder + "/s"
    records = [PROMPT, *REST[:2], *(_judged(n, "r1", "r2", "left" if n % 4 else "right") for n in range(8))]
    assert cli.run(["import", root, write(folder, records)]) == 0
    store = Store(spark, root)
    truth = {"strengths": {"m": 0.0, "n": 1.0}}
    store.save_truth(truth)
    store.save_truth(truth)
    with pytest.raises(StoreError, match="another truth"):
        store.save_truth({})
    capsys.readouterr()
    assert cli.run(["stats", root, "--json"]) == 0
    assert {r["name"]: r["value"] for r in json.loads(capsys.readouterr().out)}["judgments"] == 8
    assert cli.run(["rank", root, "--json", "--replicates", "5"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert [(r["item"], r["true_rank"]) for r in report["items"]] == [("m", 2), ("n", 1)]
    assert (report["n_games"], report["n_ties"], report["n_items"], report["n_clusters"], report["tau"], report["dropped"]) == (8, 0, 2, 1, -1.0, {}) and report["fit_gap"] < 0.05
    assert cli.run(["export", root, "--out", folder + "/out", "--no-audit"]) == 0
    with open(folder + "/out/card.json") as f:
        card = json.load(f)
    assert card["summary"]["n_kept"] == 1 and card["dropped"] == {"no_votes": 0, "too_few_votes": 0, "tie": 0, "low_agreement": 0}
    assert sum(r["n_pairs"] for r in card["splits"]) == 1 and card["provenance"] == [{"model": "m", "source": "model", "n": 1}, {"model": "n", "source": "model", "n": 1}]
    assert "| Left out" not in open(folder + "/out/card.md").read() and sorted(card["digests"]) == ["dpo", "kto", "rm"]
    assert cli.run(["export", root, "--out", folder + "/again", "--no-audit", "--format", "dpo", "--format", "rm", "--train", "0", "--validation", "0", "--test", "1"]) == 0
    assert sorted(x for x in os.listdir(folder + "/again") if "." not in x) == ["dpo", "rm"] and os.path.getsize(folder + "/again/dpo/test-00000.jsonl") > 0 == os.path.getsize(folder + "/again/dpo/train-00000.jsonl")
    assert cli.run(["export", root, "--out", folder + "/none", "--no-audit", "-x", "a1"]) == 0
    with open(folder + "/none/card.json") as f:
        assert (json.load(f)["left_out"]) == {"a1": "left out by name"}
