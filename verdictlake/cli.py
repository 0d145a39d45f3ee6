"""Command line: reports over a folder of tables or a store.

    python -m verdictlake.cli rank|checks|audit|stats|export FOLDER [options]
    python -m verdictlake.cli init|import|dump|info STORE [FILE]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audit, comparisons, export, quality, ranking
from .session import get_session
from .sources.card import card, markdown, write_card
from .sources.driver_tables import PreferenceTables
from .sources.records import RecordError, read_records
from .sources.split_files import write_splits
from .sources.store import Store, StoreError
from .sources.stored import StoreTables
from .staging import scratch, staged


def table(rows: DataFrame, order: list[str], as_json: bool) -> str:
    """A small result as aligned text or JSON; for reports of one row for each annotator, item or reason."""
    found = [r.asDict(recursive=True) for r in rows.orderBy(*order).collect()]
    if as_json:
        return json.dumps(found, indent=2, sort_keys=True, default=str)
    if not found:
        return "(none)"
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "-" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
    cells = [list(found[0]), *([show(v) for v in r.values()] for r in found)]
    widths = [max(len(c[i]) for c in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="verdictlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("rank", "checks", "audit", "stats", "export", "init", "import", "dump", "info"):
        p = commands.add_parser(name)
        p.add_argument("folder")
        p.add_argument("--json", action="store_true")
        p.add_argument("-x", "--exclude", action="append", default=[])
        if name == "rank":
            p.add_argument("--method", choices=("bradley_terry", "elo"), default="bradley_terry")
            p.add_argument("--level", choices=("model", "response"), default="model")
            p.add_argument("--replicates", type=int, default=500)
            p.add_argument("--unit", choices=("clusters", "games"), default="clusters")
            p.add_argument("--top", type=int, default=1000, help="items to print, 0 for all; --out has all of them")
            p.add_argument("--out")
            p.add_argument("--seed", type=int, default=0)
        if name == "audit":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--alpha", type=float, default=0.05)
        if name == "export":
            p.add_argument("--format", choices=(*export.ROWS, "all"), action="append", help="may be given several times; all without one")
            for split in export.SPLITS:
                p.add_argument(f"--{split}", type=float, default=getattr(export.SplitConfig, split), help="share of prompts")
            p.add_argument("--salt", default=export.SplitConfig.salt)
            p.add_argument("--out", required=True)
            p.add_argument("--no-audit", action="store_true")
            p.add_argument("--min-votes", type=int, default=1)
            p.add_argument("--min-agreement", type=float, default=0.5)
            p.add_argument("--keep-ties", action="store_true")
        if name == "import":
            p.add_argument("file")
    return parser


def _check_known(judgments: DataFrame, ids: list[str]) -> None:
    known = {r[0] for r in judgments.where(judgments.annotator_id.isin(ids)).select("annotator_id").distinct().collect()} if ids else set()
    if unknown := sorted(set(ids) - known):
        raise ValueError(f"no judgments by {', '.join(unknown)}")


def run(argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    spark = get_session()
    say = print
    if args.command in ("init", "import", "dump", "info"):
        store = Store(spark, args.folder)
        if args.command == "import":
            result = store.add(read_records(spark, args.file))
            say(f"added {result.total_added}, unchanged {result.unchanged}")
        elif args.command == "dump":
            for row in store.dump().toLocalIterator():
                say(row["value"])
        else:
            say(table(store.counts(), ["kind"], args.json))
        return 0
    store = Store(spark, args.folder) if Store.is_store(spark, args.folder) else None
    t = StoreTables(store) if store else PreferenceTables(spark, args.folder)
    truth = (store.truth() if store else None) or {}
    _check_known(t.judgments, args.exclude)
    if args.command == "stats":
        say(table(audit.summary(t), ["name"], args.json))
    elif args.command == "rank":
        models = t.responses.select("id", "model") if args.level == "model" else None
        played = comparisons.games(t.judgments, models, excluded=args.exclude)
        known = [(k, float(v)) for k, v in truth.get("strengths", {}).items()]
        true = spark.createDataFrame(known, "item string, strength double") if known else None
        with scratch(spark):
            played = staged(played)
            rows = staged(ranking.rank_rows(played, true, ranking.BootstrapConfig(args.replicates, seed=args.seed, unit=args.unit), method=args.method))
            more = ranking.report_facts(played, rows, true, args.method).first().asDict()
            more["dropped"] = {r["reason"]: r["n"] for r in comparisons.game_drops(t.judgments, models, excluded=args.exclude).collect() if r["reason"] != "game"}
            if args.out:
                rows.orderBy("place").write.json(args.out)
            shown = rows.where(F.col("place") <= args.top) if args.top else rows
            if args.json:
                say(json.dumps({"items": json.loads(table(shown, ["place"], True)), **more}, indent=2, sort_keys=True))
            else:
                say(table(shown, ["place"], False))
                say("\n".join(f"{k}: {v}" for k, v in more.items()))
    elif args.command == "checks":
        with scratch(spark):
            inputs = audit.once(t.judgments, t.responses, t.gold_pairs)
            found = audit.checks(*inputs)
            for name in ("position", "length", "consistency", "agreement", "transitivity", "gold", "reliability"):
                say(f"# {name}\n{table(found[name], ['annotator_id'], args.json)}")
            say(f"# fleiss\n{table(quality.fleiss(quality.item_labels(inputs[0])), ['n_raters'], args.json)}")
    elif args.command == "audit":
        planted = [(k, str(v)) for k, v in truth.get("archetypes", {}).items()]
        planted = spark.createDataFrame(planted, "annotator_id string, archetype string") if planted else None
        found = audit.verdicts(t.judgments, t.responses, t.gold_pairs, audit.AuditConfig(alpha=args.alpha), planted)
        say(table(found, ["annotator_id"], args.json))
        return int(args.strict and not found.where("flagged").isEmpty())
    elif args.command == "export":
        why = {a: ["left out by name"] for a in args.exclude}
        if not args.no_audit:
            for r in audit.verdicts(t.judgments, t.responses, t.gold_pairs).where("flagged").collect():
                why.setdefault(r["annotator_id"], []).extend(r["reasons"])
        config = export.FilterConfig(args.min_votes, args.min_agreement, not args.keep_ties, sorted(why))
        splits = export.SplitConfig(args.train, args.validation, args.test, args.salt)
        formats = sorted(export.ROWS) if not args.format or "all" in args.format else sorted(set(args.format))
        with scratch(spark):
            decided = staged(export.decisions(export.votes_per_pair(t.judgments, config), config))
            digests = {f: write_splits(export.ROWS[f](decided, t.prompts, t.responses, splits), f"{args.out}/{f}")["all"] for f in formats}
            found = card(decided, t.judgments, t.responses, config, splits, left_out={a: "; ".join(r) for a, r in why.items()})
        found["digests"] = digests
        write_card(spark, found, args.out)
        say(json.dumps(found, indent=2, sort_keys=True) if args.json else markdown(found))
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except (ValueError, RecordError, StoreError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
