"""SimHash near-duplicates: 64-bit fingerprints of word shingles, and the components of those that differ in few bits.

Equal fingerprints become one. Two that differ in at most r bits agree in e of e + r blocks of bits, so each goes into a
bucket for every choice of e blocks; e is the least for which buckets of evenly spread fingerprints are small, and as no link is
lost for any e, results do not depend on it. In a bucket all are compared, bit-sliced: 64 fingerprints stand as bit planes, one word
for each bit; a fingerprint meets a word of 64 others at once, whose distances are counted by carry-save adders in a
few words, and the word is given up once all 64 are over the radius. The bits that a bucket shares need no look.

Links inside a bucket are joined as they are found, and only one link for each fingerprint but the first of a component leaves the
task. Buckets with more than `bucket_rows` are dealt into parts, and each pair of parts is a task of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, scratch, staged, whole_text
from .ngram_join import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHashConfig:
    """words: of a shingle. seed: of its XXH64. radius: most differing bits of a link. bucket_mean: rows that a bucket of evenly spread
    fingerprints has at most. bucket_rows: of a bucket or of a part of one. items: comparisons of a fingerprint and a word under way at a time."""

    words: int = 3
    seed: int = 42
    radius: int = 3
    bucket_mean: int = 64
    bucket_rows: int = 4096
    items: int = 1 << 16


def _shingle_hashes(words: list[bytes], config: SimHashConfig) -> list[int]:
    """XXH64 of all runs of words, joined by one space, repeats included; fewer words are one run."""
    text, ends = b" ".join(words), []
    n = min(config.words, len(words))
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, seed = xxhash.xxh64_intdigest, config.seed
    return [digest(text[a:b], seed) for a, b in zip(starts, ends[n - 1 :])]


def fingerprint(text: bytes, config: SimHashConfig = SimHashConfig()) -> int:
    """The bits that are set in over half of the hashes of the text's shingles, unsigned; 0 without words."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), 0
    # long texts in slices that overlap by a shingle less a word, so that memory stays bounded
    step = 1 << 16
    for at in range(0, max(1, len(words) - config.words + 1), step):
        h = np.array(_shingle_hashes(words[at : at + step + config.words - 1], config), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), config) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text")).mapInArrow(run, "doc_id long, bits long")


def block_choices(n: int, config: SimHashConfig) -> list[np.uint64]:
    """Masks of bits, one for each choice of blocks, for n fingerprints: whichever `radius` bits differ, one mask has none of them."""
    for equal in range(1, 64 - config.radius + 1):
        blocks = equal + config.radius
        # the shortest key has equal * (64 div blocks) bits
        if n <= config.bucket_mean << (equal * (64 // blocks)) or blocks >= 12:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [np.uint64(sum(choice)) for choice in combinations(masks, equal)]


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """64 rows of words; bit k of word w of row b is bit b of fingerprint 64 w + k. The last word is filled up with zeros."""
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint64)
    padded[: len(bits)] = bits
    each = np.unpackbits(padded.view(np.uint8).reshape(len(padded), 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little").view(np.uint64)


def _lanes_from(k: np.ndarray) -> np.ndarray:
    """Words whose bits from k on are set, for k from 0 to 64."""
    return np.where(k >= 64, np.uint64(0), _ALL << np.minimum(k, 63).astype(np.uint64))


def near_lanes(bits: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, order: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints `query`, each against the `lanes` of a word of others: pairs of numbers that differ in at most `radius` of the bits in order."""
    item, own = np.arange(len(query)), bits[query]
    counters = np.zeros((max(1, radius.bit_length()), len(query)), np.uint64)
    over = ~lanes
    # counters start so that the one that passes the radius carries out of the last bit
    start = (1 << len(counters)) - 1 - radius
    for k in range(len(counters)):
        if start >> k & 1:
            counters[k] = _ALL
    for n, b in enumerate(order):
        carry = planes[b][word] ^ (np.uint64(0) - ((own >> np.uint64(b)) & _ONE))
        for k in range(len(counters)):
            # a half adder: the sum stays, the carry goes on
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if n % 4 == 3:
            alive = over != _ALL
            if np.count_nonzero(alive) < 0.8 * len(alive):
                item, own, word, over, counters = item[alive], own[alive], word[alive], over[alive], counters[:, alive]
                if not len(item):
                    break
    found = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8).reshape(len(over), 8), axis=1, bitorder="little")
    at, lane = np.nonzero(found)
    return query[item[at]], word[at] * 64 + lane


def _join(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """labels, each the smallest number known of a component, after links x to y: smaller labels are taken over, then followed to their ends."""
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return labels
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def bucket_links(bits: np.ndarray, ends: np.ndarray, mask: np.uint64, parts: np.ndarray | None, config: SimHashConfig) -> np.ndarray:
    """For each of the fingerprints, which stand bucket by bucket, the number of the first of its component inside its bucket. ends: of each one's bucket.
    parts: where only pairs of different parts are wanted, the first number of the second part for those of the first, else the number itself."""
    n = len(bits)
    planes, labels = bit_planes(bits), np.arange(n)
    first = np.arange(n) + 1 if parts is None else np.maximum(parts, np.arange(n) + 1)
    first = np.minimum(first, ends)
    # a fingerprint meets the words that hold first to end of its bucket
    low, high = first // 64, -(-ends // 64)
    sizes = np.where(first < ends, high - low, 0)
    order = [b for b in range(64) if not int(mask) >> b & 1]
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if n else 0
    for at in range(0, total, config.items):
        k = np.arange(at, min(at + config.items, total))
        query = np.searchsorted(stops, k, side="right")
        word = low[query] + k - (stops[query] - sizes[query])
        lanes = _lanes_from(np.clip(first[query] - 64 * word, 0, 64)) & ~_lanes_from(np.clip(ends[query] - 64 * word, 0, 64))
        labels = _join(labels, *near_lanes(bits, planes, query, word, lanes, order, config.radius))
    return labels


def _links(masks: list[np.uint64], config: SimHashConfig):
    """x, y of rows (choice, key, one, two, part, bits), which come sorted: links that join the components of each bucket."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        choice, key, one, two, part, signed = (rows[c].to_numpy() for c in ("choice", "key", "one", "two", "part", "bits"))
        bits, n = np.ascontiguousarray(signed).view(np.uint64), len(signed)
        new = np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        begins = np.flatnonzero(new)
        ends = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n]))
        # of a pair of parts, those of the first meet those of the second; of a part by itself all meet
        later = np.flatnonzero(new | np.r_[True, part[1:] != part[:-1]])
        next_part = np.r_[later[1:], n][np.searchsorted(later, np.arange(n), side="right") - 1]
        wanted = np.where(one == two, 0, next_part)
        for c in np.unique(choice):
            rows_of = np.flatnonzero(choice == c)
            a, b = rows_of[0], rows_of[-1] + 1
            labels = bucket_links(bits[a:b], ends[a:b] - a, masks[c], wanted[a:b] - a, config)
            moved = np.flatnonzero(labels != np.arange(b - a))
            yield pa.RecordBatch.from_arrays([pa.array(signed[a:b][labels[moved]], pa.int64()), pa.array(signed[a:b][moved], pa.int64())], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 16 * config.bucket_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # the last bucket may go on
            same = np.ones(size, bool)
            for c in ("choice", "key", "one", "two"):
                column = table[c].to_numpy()
                same &= column == column[-1]
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield from of(table.slice(0, whole))
            held, size = table.slice(whole).to_batches(), size - whole
        if size:
            yield from of(pa.Table.from_batches(held).combine_chunks())

    return run


def near_links(distinct: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """x, y of distinct(bits): links that join all within the radius, and no others; at most about one for each row and choice of blocks."""
    masks = block_choices(distinct.count(), config)
    signed = [int(m.astype(np.int64)) for m in masks]
    keyed = F.posexplode(F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda m: F.col("bits").bitwiseAND(m))).alias("choice", "key")
    rows = staged(distinct.select("bits", keyed))
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = rows.join(sizes, ["choice", "key"])
    # parts of a bucket; a pair of parts has the rows of both
    parts = F.ceil(F.col("rows") / config.bucket_rows)
    shared = shared.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("bits"), F.col("parts")))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    shared = shared.select("choice", "key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "bits")
    place = ["choice", "key", "one", "two"]
    return shared.repartition(*place).sortWithinPartitions(*place, "part", "bits").mapInArrow(_links(masks, config), "x long, y long")


def simhash_components(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs(doc_id, text): the smallest doc_id that links reach.

    Null and empty texts, and those of white space, have the fingerprint zero and are linked like others. Rows with the same doc_id are
    nodes of their own, joined if their fingerprints are. A row without a doc_id is left out of the links and gets a null component. Further
    columns are ignored; an empty table gives none.
    """
    with scratch(docs.sparkSession):
        found = staged(fingerprints(docs, config))
        first = staged(found.where(F.col("doc_id").isNotNull()).groupBy("bits").agg(F.min("doc_id").alias("first")))
        labels = components(staged(near_links(first.select("bits"), config))).withColumnRenamed("node", "bits")
        linked = staged(labels.join(first, "bits"))
        lowest = linked.groupBy("label").agg(F.min("first").alias("lowest"))
        of_linked = linked.join(lowest, "label").select("bits", "lowest")
        rows = found.join(first.join(of_linked, "bits", "left").select("bits", F.coalesce("lowest", "first").alias("low")), "bits", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("component_id")
        return lasting(rows.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), component))
