"""Document fingerprints by Order MinHash.

The k-mers of a text start at every code point, so that an edit changes only those around it, in any script. Each is numbered
by its occurrence in the text. They fall into classes by their hash, and each hash function has a class to look at, which
makes it a share of the work and leaves an edit local; a text without a k-mer of a class is looked at whole. Of each function the l k-mers
of the smallest hashes are taken, put back into text order and hashed as a tuple. The share of equal tuples is an
estimate that falls with the edit distance, as moved text changes the order.

The next document by id is found with ids alone; texts are dealt once, by ranges of ids, and the first of each range
goes to the range before it as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, whole_text


@dataclass(frozen=True)
class FingerprintConfig:
    """k: code points of a k-mer. sketches: hash functions. classes: of k-mers, dealt to the functions in turn. tuple_size: k-mers that a
    function selects. rows_for_range: documents of one range of ids, about."""

    k: int = 10
    sketches: int = 64
    classes: int = 4
    tuple_size: int = 2
    rows_for_range: int = 5000


_POWER = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A cheaper scramble than mix64, for steps in between."""
    x *= _POWER
    x ^= x >> np.uint64(29)
    return x


def run_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k code points, by doubling runs: a run of a + b is one of a and the one of b behind it."""
    doubled, out, size, length = _scrambled(points.astype(np.uint64) + np.uint64(1)), None, 0, 1
    while True:
        if k & length:
            # what is left of k from its lower bits on
            out = doubled if out is None else _scrambled(out[: len(points) - size - length + 1] + (doubled[size : size + len(points) - size - length + 1] ^ (_LAST >> np.uint64(length))))
            size += length
        if size == k:
            return mix64(out)
        n = len(points) - 2 * length + 1
        doubled = _scrambled(doubled[:n] + (doubled[length : length + n] ^ (_POWER >> np.uint64(length))))
        length *= 2


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """Hashes of occurrence-numbered k-mers, in text order; fewer than k code points are one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64)
    h = run_hashes(points, min(k, len(points)))
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(twice):
        # only those that occur again are put in order
        twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
        spot = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        at = np.flatnonzero(twice[spot] == h)
        order = np.argsort(spot[at], kind="stable")
        group = spot[at][order]
        place = np.arange(len(at))
        begins = np.r_[True, group[1:] != group[:-1]]
        number = place - np.maximum.accumulate(np.where(begins, place, 0))
        h[at[order]] = mix64(h[at[order]] ^ (number.astype(np.uint64) * _POWER))
    return h


def sketch(kmers: np.ndarray, config: FingerprintConfig = FingerprintConfig()) -> np.ndarray:
    """One 32-bit hash for each function: of the `tuple_size` k-mers of its class with the smallest hashes, in text order."""
    seeds = mix64(np.arange(1, config.sketches + 1, dtype=np.uint64) * _POWER)
    out = np.zeros(len(seeds), np.uint32)
    if not len(kmers):
        return out
    dealt = (kmers >> np.uint64(32)) % np.uint64(config.classes)
    for c in range(config.classes):
        own = kmers[dealt == np.uint64(c)]
        own = own if len(own) else kmers
        size = min(config.tuple_size, len(own))
        functions = np.arange(c, len(seeds), config.classes)
        step = max(1, (1 << 16) // len(own))
        for at in range(0, len(functions), step):
            rows = functions[at : at + step]
            salt = seeds[rows][:, None]
            hashed = own ^ salt
            hashed *= salt | np.uint64(1)
            hashed ^= hashed >> np.uint64(32)
            hashed *= _POWER
            chosen, each = np.empty((len(rows), size), np.int64), np.arange(len(rows))
            for j in range(size):
                chosen[:, j] = hashed.argmin(axis=1)
                hashed[each, chosen[:, j]] = _LAST
            chosen.sort(axis=1)
            value = np.full(len(rows), size, np.uint64)
            for j in range(size):
                value = mix64(value * _POWER + own[chosen[:, j]])
            out[rows] = value >> np.uint64(32)
    return out


def fingerprint(text: str, config: FingerprintConfig = FingerprintConfig()) -> np.ndarray:
    """The sketches of one text."""
    return sketch(kmer_hashes(text, config.k), config)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of sketches that are equal."""
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(cuts: list[int]) -> Column:
    """How many cuts are not above doc_id: first among every hundredth cut, then within that hundred."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i : i + 100] for i in range(0, len(cuts), 100)]
    coarse = F.from_json(F.lit(str([b[0] for b in blocks])), "array<bigint>")
    fine = F.from_json(F.lit(str(blocks)), "array<array<bigint>>")
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= F.col("doc_id"))), F.lit(1))
    return F.coalesce((block - 1) * 100 + F.size(F.filter(F.element_at(fine, block), lambda c: c <= F.col("doc_id"))), F.lit(0))


def _with_next(docs: DataFrame, config: FingerprintConfig) -> DataFrame:
    """range, doc_id, text, ghost: rows dealt by ranges of ids; the ghost at the end of a range is the next document."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = given.select("doc_id")
    n = ids.count()
    ranges = max(1, min(n // config.rows_for_range, 10_000))
    # at most 10,000 numbers come to the driver
    cuts = sorted({int(x) for x in (ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else [])})
    place = _range_of(cuts)
    rows = given.withColumn("range", place)
    heads = {r["range"]: r["m"] for r in ids.groupBy(place.alias("range")).agg(F.min("doc_id").alias("m")).collect()}
    firsts = sorted(heads)
    # the head of each range that has rows goes to the range before it too, the first one to the last
    before = {r: firsts[k - 1] for k, r in enumerate(firsts)}
    own = rows.withColumn("ghost", F.lit(False))
    if not before:
        return own
    table = docs.sparkSession.createDataFrame([(r, heads[r], before[r]) for r in firsts], "h_range int, h_id long, h_before int")
    ghosts = rows.join(F.broadcast(table), (F.col("range") == F.col("h_range")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    ghosts = ghosts.select("doc_id", "text", F.col("h_before").alias("range"), F.lit(True).alias("ghost"))
    parts = max(len(firsts), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return own.unionByName(ghosts).repartition(parts, "range").sortWithinPartitions("range", "ghost", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_edits(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for docs(doc_id, text).

    Null text counts as empty; empty texts have one fingerprint of their own. Rows with the same id follow each other
    by text; null ids come first. A single row is followed by itself. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, doc_id, text, fingerprint of the row that waits for its next one
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("range", "doc_id", "text", "ghost")]
            for place, doc_id, text, ghost in zip(*columns):
                place, doc_id, text, ghost = place.as_py(), doc_id.as_py(), text.as_py(), ghost.as_py()
                own = fingerprint(text, config)
                if held is not None and held[0] == place:
                    changed = edited(held[2], text)
                    after = held[3] if changed == held[2] else fingerprint(changed, config)
                    rows.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3].tobytes().hex(), after.tobytes().hex(), likeness(held[3], after), likeness(held[3], own)))
                held = None if ghost else (place, doc_id, text, own)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs, config).select("range", "doc_id", "text", "ghost").mapInArrow(run, schema)
