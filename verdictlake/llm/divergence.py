"""How the sources of each language differ: exact chi-square divergences of pairs, and the terms that mark each source.

Terms are counted for each (language, source) inside tasks, which give up what they hold once it is large, and summed by
Spark. The terms that a language keeps are dealt by hash into blocks; a block and the list of all sources make a dense
tile of counts, sources by terms, in numpy. The tile holds the smoothed shares of all its sources, compares all pairs of
sources by broadcasting, and gives one partial sum for each pair and the best terms of each source. Partial pair
matrices are summed by pair; the best terms of tiles are merged into the best of their group, whose bounded rank Spark keeps on both
sides of the shuffle.

Where a language has more sources than a tile takes, these are dealt into sides, and a tile compares two sides. A term that a
tile of two sides lacks has a count of zero in both; it adds the same to a pair as any other such term, so that a tile
says how many terms it saw and the rest are added at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, scratch, staged, whole_text

#: What stands between terms: all of ASCII but letters.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class DivergenceConfig:
    """least_documents: of a language with a term that it keeps. scale: shares are integers of 1 / scale. ranks: terms of a group. tile_terms,
    tile_sources: of a block, about. held_terms: counted in a task before they are given up. cells: of one broadcast comparison, about."""

    least_documents: int = 3
    scale: int = 1_000_000_000
    ranks: int = 200
    tile_terms: int = 1024
    tile_sources: int = 256
    held_terms: int = 200_000
    cells: int = 1 << 20


def _counted(config: DivergenceConfig):
    """Occurrences and documents of each term, by language and source, of the rows of a task; in parts of bounded size."""

    def given_up(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (seen, docs) in held.items():
            terms = list(seen)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [pa.array([lang] * len(part), pa.binary()), pa.array([source] * len(part), pa.binary()), pa.array(part, pa.binary())]
                columns += [pa.array([c[t] for t in part], pa.int64()) for c in (seen, docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                terms = _TERM.findall(text.as_py().translate(_LOWER))
                if not terms:
                    continue
                key = lang.as_py(), source.as_py()
                if key not in held:
                    held[key] = Counter(), Counter()
                seen, docs = held[key]
                before = len(seen)
                seen.update(terms)
                docs.update(set(terms))
                size += len(seen) - before
                if size >= config.held_terms:
                    yield from given_up(held)
                    held, size = {}, 0
        yield from given_up(held)

    return run


def term_counts(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """lang, source, term (binary), n, lang_n, first for the terms that the language of docs(text, lang, source) keeps; first is 1 in one row of each of its terms."""
    given = docs.select(*(whole_text(c).cast("binary").alias(c) for c in ("lang", "source", "text")))
    counted = given.mapInArrow(_counted(config), "lang binary, source binary, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    rows = counted.withColumn("lang_docs", F.sum("docs").over(same)).withColumn("lang_n", F.sum("n").over(same))
    rows = rows.withColumn("first", (F.row_number().over(same.orderBy("source")) == 1).cast("int"))
    return rows.where(F.col("lang_docs") >= config.least_documents).select("lang", "source", "term", "n", "lang_n", "first")


def shares(counts: np.ndarray, totals: np.ndarray, scale: int) -> np.ndarray:
    """1 + floor(scale * counts / totals) in int64, digit by digit to the base 1000: exact for totals of up to 9 * 10^15 although
    scale * counts may not fit; scale is a power of 1000, counts are at most totals."""
    quotient, rest, digits = np.zeros(np.broadcast(counts, totals).shape, np.int64), counts + np.zeros_like(totals), 1
    while digits < scale:
        rest = rest * 1000
        quotient = quotient * 1000 + rest // totals
        rest, digits = rest % totals, digits * 1000
    return quotient + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), exact in int64: shares are at most 10^9 + 1."""
    d = p - q
    return d * d // q


def _best(values: np.ndarray, terms: np.ndarray, ranks: int) -> np.ndarray:
    """Places of the `ranks` largest values, of equal ones those with the smallest terms."""
    if len(values) > ranks:
        places = np.flatnonzero(values >= np.partition(values, len(values) - ranks)[len(values) - ranks])
    else:
        places = np.arange(len(values))
    return np.array(sorted(places, key=lambda i: (-values[i], terms[i]))[:ranks], np.int64)


_TILE = "lang binary, source binary, part string, item binary, value long, seen long, rest long, terms long"


def _compared(config: DivergenceConfig):
    """One tile: partial sums of pairs, and the best terms of each source."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        head = rows.filter(pc.is_null(rows["term"]))
        body = rows.filter(pc.is_valid(rows["term"]))
        sources = head["source"].combine_chunks()
        totals, sides = head["n"].to_numpy(), head["side"].to_numpy()
        lang, all_terms, lang_total = rows["lang"][0].as_py(), head["terms"][0].as_py(), head["lang_n"][0].as_py()
        a, b = rows["a"][0].as_py(), rows["b"][0].as_py()
        codes = body["term"].combine_chunks().dictionary_encode()
        terms = codes.dictionary.to_pylist()
        at, own = codes.indices.to_numpy(), pc.index_in(body["source"], sources).to_numpy()
        counts, lang_counts = np.zeros((len(totals), len(terms)), np.int64), np.zeros(len(terms), np.int64)
        counts[own, at] = body["n"].to_numpy()
        lang_counts[at] = body["lang_n"].to_numpy()
        smoothed = totals + all_terms
        p = shares(counts + 1, smoothed[:, None], config.scale)
        lists = {c: [] for c in ("source", "part", "item", "value", "seen", "rest")}

        def add(source: list, part: str, item: list, value: np.ndarray, rest: np.ndarray) -> None:
            lists["source"] += source
            lists["part"] += [part] * len(source)
            lists["item"] += item
            lists["value"].append(value)
            lists["seen"].append(np.full(len(source), len(terms) if part == "pair" else 0))
            lists["rest"].append(rest)

        names = sources.to_pylist()
        # what a term without occurrences in either source adds
        none = shares(np.ones_like(smoothed), smoothed, config.scale) if all_terms else np.ones_like(smoothed)
        for one, two in ((a, b), (b, a)) if a != b else ((a, a),):
            xs, ys = np.flatnonzero(sides == one), np.flatnonzero(sides == two)
            step = max(1, config.cells // max(1, len(ys) * len(terms)))
            for k in range(0, len(xs), step):
                x = xs[k : k + step]
                partial = divergences(p[x][:, None, :], p[ys][None, :, :]).sum(axis=2)
                rest = divergences(none[x][:, None], none[ys][None, :])
                i, j = np.nonzero(x[:, None] != ys[None, :])
                add([names[n] for n in x[i]], "pair", [names[n] for n in ys[j]], partial[i, j], rest[i, j])
        if a == b and terms:
            q = shares(lang_counts + 1, np.array([lang_total + all_terms]), config.scale)
            for s in range(len(names)):
                marks = np.flatnonzero((counts[s] > 0) & (p[s] > q))
                values, marking = divergences(p[s, marks], q[marks]), [terms[n] for n in marks]
                best = _best(values, marking, config.ranks)
                add([names[s]] * len(best), "term", [marking[n] for n in best], values[best], np.zeros(len(best), np.int64))
        n = len(lists["source"])
        numbers = {c: np.concatenate([np.zeros(0, np.int64), *lists[c]]) for c in ("value", "seen", "rest")}
        columns = [pa.array([lang] * n, pa.binary()), pa.array(lists["source"], pa.binary()), pa.array(lists["part"], pa.string()), pa.array(lists["item"], pa.binary())]
        columns += [pa.array(numbers[c], pa.int64()) for c in ("value", "seen", "rest")] + [pa.array(np.full(n, all_terms), pa.int64())]
        return pa.Table.from_arrays(columns, names=["lang", "source", "part", "item", "value", "seen", "rest", "terms"])

    return run


def source_divergence(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """lang, source, part, item, value, rank of the sources of each language of docs(text, lang, source).

    Part `pair` compares a source with each other one of its language over all kept terms (0 where there are none), part
    `term` has its most marking terms against the language. Null text, lang and source count as empty. Every row is a document, those that repeat
    another too. Equal values are ranked by item, as UTF-8. Sums fit into 64 bits for up to 10^9 kept terms of a language.
    Further columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        counts = staged(term_counts(docs, config))
        groups = docs.select(*(whole_text(c).cast("binary").alias(c) for c in ("lang", "source"))).distinct()
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = staged(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["n"]))
        kept = counts.groupBy("lang").agg(F.sum("first").cast("long").alias("terms"), F.sum("n").alias("lang_n"))
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept, "lang", "left").na.fill(0, ["terms", "lang_n"])
        langs = staged(langs.select("lang", "terms", "lang_n", F.greatest(F.ceil(F.col("terms") / config.tile_terms), F.lit(1)).alias("blocks"), F.greatest(F.ceil(F.col("sources") / config.tile_sources), F.lit(1)).alias("n_sides")))
        side = F.pmod(F.xxhash64("source"), F.col("n_sides")).alias("side")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        heads = groups.join(langs, "lang").select("lang", each, "source", F.lit(None).cast("binary").alias("term"), "n", "lang_n", "terms", side, "n_sides")
        block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
        cells = counts.join(langs.select("lang", "blocks", "n_sides"), "lang").select("lang", block, "source", "term", "n", "lang_n", F.lit(None).cast("long").alias("terms"), side, "n_sides")
        tiles = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sides") - 1)))
        tiles = tiles.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")).drop("other", "n_sides")
        found = staged(tiles.groupBy("lang", "block", "a", "b").applyInArrow(_compared(config), _TILE))

        pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item")
        pairs = pairs.agg((F.sum("value") + (F.max("terms") - F.sum("seen")) * F.max("rest")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= config.ranks)
        rows = pairs.withColumn("rank", rank).unionByName(terms)
        return lasting(rows.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")), "value", "rank"))
