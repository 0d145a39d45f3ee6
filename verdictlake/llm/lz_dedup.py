"""Repeated word windows by relative Lempel-Ziv parsing.

The reference of a document is all text before it, cut into blocks of an index. Each window of `length` words has an
anchor n-gram chosen by its content; the passages around equal anchors, of all documents that have them, make up one block, so that
a document is parsed against every block that can have an earlier occurrence of one of its windows, and against no other.

In a block all positions are sorted by the words that follow, the first `length` of them and then one by one, and each
gets its longest match with an earlier position and where that is. The parse of a passage is greedy: at a
position it takes the longest match as a factor if that has `length` words, or else goes on by one word. The windows
across the end of a factor may come from elsewhere, so the parse goes on at the first window that the factor doesn't
hold. Factors of one document that continue each other's source become one. All words of factors are duplicate spans, all
others are literal.

Words are compared by 64-bit hashes, each for itself. Passages travel once for each block of documents that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, BlockConfig, anchors, binary_batch, each_block, gram_hashes, hit_codes, is_hit, pack_blocks, repeated_keys
from .common import WORD_BREAKS, lasting, mix64, scratch

#: Stands for a doc_id that is null: after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class FactorConfig:
    """length: words of a window, and of the shortest factor. gram: words of the n-gram at an anchor.
    index_windows: windows of one block of the index, about."""

    length: int = 20
    gram: int = 10
    index_windows: int = 400_000
    blocks: BlockConfig = field(default_factory=BlockConfig)


_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAKS)] = True
_POWER = np.uint64(0x9E3779B97F4A7C15)
#: What a byte, and its place in a word, bring to the word's hash.
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(257))
_WEIGHT = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _POWER) | np.uint64(1)


@dataclass
class Words:
    """Where the words of a block begin and end, their hashes, and where each document's words end."""

    begins: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray


def words_of(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = _BREAK) -> Words:
    """Words are runs of bytes that are no breaks (by default white space) and in one document."""
    if not len(data):
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    solid = ~breaks[data]
    opens = np.zeros(len(data), bool)
    opens[np.r_[np.int64(0), ends[:-1]][np.r_[np.int64(0), ends[:-1]] < len(data)]] = True
    begins = np.flatnonzero(solid & (opens | np.r_[True, ~solid[:-1]]))
    closes = np.r_[opens[1:] | ~solid[1:], True]
    stops = np.flatnonzero(solid & closes) + 1
    # the hash of a word: the sum of its bytes times powers of their place in it
    lengths = stops - begins
    place = np.arange(len(data)) - np.repeat(np.r_[np.int64(0), begins], np.diff(np.r_[np.int64(0), begins, len(data)]))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _WEIGHT[np.minimum(place, 255)], out=sums[1:])
    hashes = mix64((sums[stops] - sums[begins]) * _POWER + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > 255):  # beyond that place a sum would not see the order
        hashes[i] = np.frombuffer(hashlib.blake2b(data[begins[i] : stops[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return Words(begins, stops, hashes, np.searchsorted(begins, ends))


def _keys(config: FactorConfig, block: Block) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(block.data, block.ends)
    found = anchors(words.hashes, words.ends, config.length, config.gram)
    return found.keys, found.position


#: A passage that is parsed: row in its block of documents, id, first word, windows that start in it, and bytes.
_RUN = np.dtype([("row", "<u4"), ("doc", "<i8"), ("word", "<i8"), ("windows", "<u4"), ("n_bytes", "<u4")])


#: A factor of the row: its first word, its words, and where they occur before.
_FACTOR = np.dtype([("row", "<u4"), ("word", "<i8"), ("words", "<u4"), ("from_doc", "<i8"), ("from_word", "<i8")])


def _send(config: FactorConfig, buckets: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                words = words_of(block.data, block.ends)
                found = anchors(words.hashes, words.ends, config.length, config.gram)
                hit, _ = is_hit(found.keys, buckets, hit_codes(batch.column("found")[n])[0])
                first, last, keys = found.first[hit], found.last[hit], found.keys[hit]
                if not len(keys):
                    continue
                place = ((mix64(keys ^ _POWER) >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
                row = np.searchsorted(words.ends, first, side="right")
                runs = np.zeros(len(first), _RUN)
                runs["row"], runs["doc"], runs["word"] = row, block.doc_ids[row], first - np.r_[np.int64(0), words.ends][row]
                runs["windows"] = last - first + 1
                begins, stops = words.begins[first], words.stops[last + config.length - 1]
                runs["n_bytes"] = stops - begins
                # passages of the same bytes are parsed once for each block; the later ones have the first as their source
                seen: dict[tuple[bytes, int], int] = {}
                source = np.arange(len(runs))
                for i in np.lexsort((runs["word"], runs["doc"])).tolist():
                    source[i] = seen.setdefault((block.data[begins[i] : stops[i]].tobytes(), int(runs["windows"][i])), i)
                later = (runs["doc"] != runs["doc"][source]) | (runs["word"] != runs["word"][source])
                again = np.flatnonzero(later)
                told = np.zeros(len(again), _FACTOR)
                told["row"], told["word"], told["words"] = runs["row"][again], runs["word"][again], runs["windows"][again] + config.length - 1
                told["from_doc"], told["from_word"] = runs["doc"][source[again]], runs["word"][source[again]]
                rows = [(-1 - block.block, block.block, told.tobytes(), b"")] if len(again) else []
                own = np.flatnonzero(~later)
                own = own[np.argsort(place[own], kind="stable")]
                cut = np.flatnonzero(np.r_[True, place[own][1:] != place[own][:-1]]).tolist() + [len(own)]
                rows += [(int(place[own[i]]), block.block, runs[own[i:j]].tobytes(), b"".join([block.data[begins[x] : stops[x]].tobytes() for x in own[i:j].tolist()])) for i, j in zip(cut, cut[1:])]
                for at in range(0, len(rows), 256):
                    r, k, x, y = zip(*rows[at : at + 256])
                    yield binary_batch({"range": (r, pa.int64()), "block": (k, pa.int64()), "runs": (x, pa.binary()), "data": (y, pa.binary())})

    return run


def _hashes_of(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts side by side, and where each one's words end; about 1 MB is worked on at a time."""
    view, parts, counts, start = np.frombuffer(data, np.uint8), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while start < len(ends):
        low = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, low + (1 << 20))))
        found = words_of(view[low : int(ends[stop - 1])], ends[start:stop] - low)
        parts.append(found.hashes)
        counts.append(np.diff(np.r_[np.int64(0), found.ends]))
        start = stop
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def longest_matches(key: np.ndarray, at: np.ndarray, stop: np.ndarray, hashes: np.ndarray, doc: np.ndarray, word: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position its longest match (0 if under `length` words) with one that is before it by (doc, word), and the
    first position that has this match. key: hash of the first words; at..stop: its words in hashes."""
    size, source = np.zeros(len(at), np.int64), np.arange(len(at))
    order = np.lexsort((word, doc, key))
    ranked = key[order]
    head = order[np.maximum.accumulate(np.where(np.r_[True, ranked[1:] != ranked[:-1]], np.arange(len(order)), 0))]
    # a key that two sequences of words share is told apart
    unlike = np.zeros(len(order), bool)
    for j in range(length):
        unlike |= hashes[at[order] + j] != hashes[at[head] + j]
    for k in np.unique(ranked[unlike]):
        least: dict[bytes, int] = {}
        for i in np.flatnonzero(ranked == k):
            m = order[i]
            head[i] = least.setdefault(hashes[at[m] : at[m] + length].tobytes(), m)
    n = length
    while True:
        later = (doc[order] != doc[head]) | (word[order] != word[head])
        size[order[later]], source[order[later]] = n, head[later]
        # classes in which something is later go on by one word, as far as their passages do
        stays = np.zeros(len(at), bool)
        stays[head[later]] = True
        keep = stays[head] & (at[order] + n < stop[order])
        order, head = order[keep], head[keep]
        if not len(order):
            return size, source
        following = hashes[at[order] + n]
        inner = np.lexsort((word[order], doc[order], following, head))
        order, head, following = order[inner], head[inner], following[inner]
        new = np.r_[True, (head[1:] != head[:-1]) | (following[1:] != following[:-1])]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        n += 1


def greedy_parse(size: np.ndarray, begins: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages and positions at which factors start, if each passage is parsed from its first position on. size: of the
    longest match at each position; begins: position of a passage's first; count: positions of a passage."""
    passages, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, step = np.arange(len(begins)), np.zeros(len(begins), np.int64)
    while len(live):
        here = begins[live] + step[live]
        is_factor = size[here] >= length
        passages.append(live[is_factor])
        starts.append(here[is_factor])
        step[live] += np.where(is_factor, size[here] - length + 1, 1)
        live = live[step[live] < count[live]]
    return np.concatenate(passages), np.concatenate(starts)


def _parse_block(config: FactorConfig):
    """One block of the index: its passages parsed against what comes before them in it."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return pa.table({"block": table.column("block"), "factors": table.column("runs")})
        runs = [np.frombuffer(x.as_buffer(), _RUN) for x in table.column("runs")]
        block = np.repeat(table.column("block").to_numpy(), [len(x) for x in runs])
        runs = np.concatenate(runs)
        hashes, word_ends = _hashes_of(b"".join(x.as_py() for x in table.column("data")), np.cumsum(runs["n_bytes"], dtype=np.int64))
        count = runs["windows"].astype(np.int64)
        begins = np.cumsum(count) - count
        of = np.repeat(np.arange(len(runs)), count)
        inner = np.arange(len(of)) - begins[of]
        at = np.r_[np.int64(0), word_ends[:-1]][of] + inner
        doc, word = runs["doc"][of], runs["word"][of] + inner
        size, source = longest_matches(gram_hashes(hashes, config.length)[at], at, word_ends[of], hashes, doc, word, config.length)
        passage, here = greedy_parse(size, begins, count, config.length)
        out = np.zeros(len(here), _FACTOR)
        out["row"], out["word"], out["words"] = runs["row"][passage], word[here], size[here]
        out["from_doc"], out["from_word"] = doc[source[here]], word[source[here]]
        order = np.argsort(block[passage], kind="stable")
        b, out = block[passage][order], out[order]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]).tolist() + [len(b)] if len(b) else []
        return pa.table({"block": pa.array([int(b[i]) for i in cut[:-1]], pa.int64()), "factors": pa.array([out[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())})

    return run


def joined_factors(found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first word, words, source document, source word) of one document's factors; one that continues the source of the
    factor before, without a gap, is part of it."""
    out: list[list[int]] = []
    for factor in np.sort(found, order=["word", "words"]):
        word, n, doc, source = int(factor["word"]), int(factor["words"]), int(factor["from_doc"]), int(factor["from_word"])
        if out and out[-1][2] == doc and word <= out[-1][0] + out[-1][1] and source - out[-1][3] == word - out[-1][0]:
            out[-1][1] = max(out[-1][1], word + n - out[-1][0])
        else:
            out.append([word, n, doc, source])
    return [tuple(x) for x in out]


def _spans(config: FactorConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                words = words_of(block.data, block.ends)
                told = batch.column("found")[n]
                found = np.concatenate([np.zeros(0, _FACTOR), *(np.frombuffer(x["factors"].as_buffer(), _FACTOR) for x in (told if told.is_valid else ()))])
                found = found[np.argsort(found["row"], kind="stable")]
                rows, word_start = [], 0
                for i, doc_id in enumerate(block.doc_ids.tolist()):
                    word_end = int(words.ends[i])
                    parse = joined_factors(found[np.searchsorted(found["row"], i) : np.searchsorted(found["row"], i, side="right")])
                    gone = np.zeros(word_end - word_start, bool)
                    for first, size, _, _ in parse:
                        gone[first : first + size] = True
                    stay = np.flatnonzero(~gone) + word_start
                    text = b" ".join([block.data[a:b].tobytes() for a, b in zip(words.begins[stay].tolist(), words.stops[stay].tolist())])
                    spans = [{"first_word": f, "n_words": m, "source_doc": None if d == NO_ID else d, "source_word": w} for f, m, d, w in parse]
                    rows.append((None if doc_id == NO_ID else doc_id, len(gone), int(gone.sum()), text, spans))
                    word_start = word_end
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("source_doc", pa.int64()), ("source_word", pa.int64())])))
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024]), kinds)], names=["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    return run


_PARSED = "doc_id long, n_words long, n_removed long, kept_text binary, factors array<struct<first_word long, n_words long, source_doc long, source_word long>>"


def parse_documents(docs: DataFrame, config: FactorConfig = FactorConfig()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary), factors for each row of docs(doc_id, text).

    A word goes if a window of `length` words over it also starts earlier: in a smaller doc_id, or before it in the
    document. Null text has no words; a null doc_id comes after all others; rows that repeat a doc_id are each
    parsed for itself and at the same place, so that none takes from another what stands at the same word. Further columns are
    ignored; an empty table gives none.
    """
    blocks = pack_blocks(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text"), config.blocks)
    buckets = blocks.screen_buckets(1 / 32)
    with scratch(docs.sparkSession):
        hits = repeated_keys(blocks, lambda block: _keys(config, block), buckets)
        # at most a window for each five bytes, of which the screen lets pass what is repeated
        ranges = max(1, round(blocks.n_bytes / 10 / config.index_windows))
        sent = blocks.with_found(hits).mapInArrow(_send(config, buckets, ranges), "range long, block long, runs binary, data binary")
        found = lasting(sent.groupBy("range").applyInArrow(_parse_block(config), "block long, factors binary"))
    return blocks.with_found(found, all_blocks=True).mapInArrow(_spans(config), _PARSED)
