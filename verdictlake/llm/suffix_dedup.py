"""Repeated passages by a distributed suffix array.

Each window of `length` bytes has an anchor chosen by its content, so only suffixes that start at anchors are sorted.
Anchors whose leading n-gram occurs in no other document are screened out. The suffixes that are left, with as many bytes to
their left as a window can reach, are range-partitioned by their leading bytes with sampled splitters. A bucket sorts
its suffixes by multikey quicksort over words of eight bytes and compares neighbours. Windows that begin left of their
anchor are equal where the suffixes agree far enough and the bytes to the left are the same; of each class of equal
windows the smallest doc_id keeps it.

Boundaries between buckets are settled by their choice: a splitter is cut between different leading bytes (`leading`, fewer than
the n-gram that equal windows share at the anchor), so suffixes on its two sides differ in these, and the last
suffix of a bucket and the first of the next agree in less than any window needs. No match crosses a boundary.

Before suffixes leave their block, those with the same bytes around become one, so a passage in a third of all
documents is one suffix for each block. The texts move once, into the blocks, which all steps read where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .blocks import Block, BlockConfig, anchors, binary_batch, documents_of, each_block, hit_codes, is_hit, pack_blocks, repeated_keys, rest_of
from .common import lasting, scratch, staged

#: Stands for a doc_id that is null: after all others.
NO_ID = (1 << 63) - 1
#: A field beside the further columns: whether the text was null.
_NO_TEXT = "verdictlake text was null"


@dataclass(frozen=True)
class SuffixConfig:
    """length: bytes of a window. gram: bytes of the n-gram at an anchor. leading: bytes that splitters compare, at most
    gram. bucket_suffixes: suffixes of a bucket, about. sample_suffixes: from which splitters are taken, at most about."""

    length: int = 50
    gram: int = 25
    leading: int = 16
    bucket_suffixes: int = 150_000
    sample_suffixes: int = 50_000
    blocks: BlockConfig = field(default_factory=BlockConfig)


#: A suffix: block, doc_id, position in the block, least and largest distance of a window's start to the anchor.
_HEAD = np.dtype([("block", "<i8"), ("doc", "<i8"), ("position", "<u4"), ("near", "u1"), ("far", "u1")])


def _layout(config: SuffixConfig) -> np.dtype:
    return np.dtype(_HEAD.descr + [("context", "u1", (config.length - config.gram + config.length,))])


def _keys(config: SuffixConfig, block: Block) -> tuple[np.ndarray, np.ndarray]:
    found = anchors(block.data, block.ends, config.length, config.gram)
    return found.keys, documents_of(block, found.position, block.ends)


def suffixes_of(block: Block, codes: np.ndarray, buckets: int, config: SuffixConfig) -> np.ndarray:
    """The suffixes at anchors that occur elsewhere."""
    found = anchors(block.data, block.ends, config.length, config.gram)
    hit, _ = is_hit(found.keys, buckets, codes)
    at, first, last = found.position[hit], found.first[hit], found.last[hit]
    out = np.zeros(len(at), _layout(config))
    left = config.length - config.gram
    out["block"], out["position"], out["near"], out["far"] = block.block, at, at - last, at - first
    out["doc"] = block.doc_ids[documents_of(block, at, block.ends)]
    offsets = np.arange(-left, config.length)
    for a in range(0, len(at), 1 << 15):
        b = slice(a, a + (1 << 15))
        where = at[b, None] + offsets
        inside = (where >= first[b, None]) & (where < last[b, None] + config.length)
        out["context"][b] = np.where(inside, block.data[np.where(inside, where, 0)], 0)
    return out


def _same_around(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of which no other with the same bytes and windows has a smaller doc_id, and the rest."""
    if not len(suffixes):
        return suffixes, suffixes
    whole = np.ascontiguousarray(suffixes["context"]).view(np.uint8).reshape(len(suffixes), -1)
    padded = np.zeros((len(suffixes), -(-whole.shape[1] // 8) * 8 + 8), np.uint8)
    padded[:, : whole.shape[1]], padded[:, -2], padded[:, -1] = whole, suffixes["near"], suffixes["far"]
    words = padded.view("<u8")
    h = np.zeros(len(suffixes), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.lexsort((suffixes["position"], suffixes["doc"], h))
    ranked = h[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    equal = (words[order] == words[order[head]]).all(axis=1)  # a hash that two contexts share drops nothing
    later = equal & (suffixes["doc"][order] > suffixes["doc"][order[head]])
    return suffixes[order[~later]], suffixes[order[later]]


def _send(config: SuffixConfig, buckets: int, splitters: np.ndarray):
    """Suffixes by range, and marks (all windows) of those that their own block explains, under a range of its own below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                kept, later = _same_around(suffixes_of(block, hit_codes(batch.column("found")[n])[0], buckets, config))
                rows = [(-1 - block.block, block.block, _marks(later, _all_windows(later)))] if len(later) else []
                place = _range_of(kept, splitters, config)
                order = np.argsort(place, kind="stable")
                kept, place = kept[order], place[order]
                cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]).tolist() + [len(place)] if len(place) else []
                rows += [(int(place[a]), block.block, kept[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                for at in range(0, len(rows), 256):
                    r, k, x = zip(*rows[at : at + 256])
                    yield binary_batch({"range": (r, pa.int64()), "block": (k, pa.int64()), "data": (x, pa.binary())})

    return run


def _range_of(suffixes: np.ndarray, splitters: np.ndarray, config: SuffixConfig) -> np.ndarray:
    left = config.length - config.gram
    leading = np.ascontiguousarray(suffixes["context"][:, left : left + config.leading]).view(f"S{config.leading}").reshape(-1)
    return np.searchsorted(splitters, leading, side="right")


def _all_windows(suffixes: np.ndarray) -> np.ndarray:
    bits = (np.uint64(1) << (suffixes["far"].astype(np.uint64) + np.uint64(1))) - np.uint64(1)
    return bits & ~((np.uint64(1) << suffixes["near"].astype(np.uint64)) - np.uint64(1))


_MARK = np.dtype([("position", "<u4"), ("windows", "<u8")])


def _marks(suffixes: np.ndarray, windows: np.ndarray) -> bytes:
    out = np.zeros(len(suffixes), _MARK)
    out["position"], out["windows"] = suffixes["position"], windows
    return out.tobytes()


def multikey_order(rows: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of equally long byte rows by multikey quicksort, eight bytes at a time: a pivot word splits a segment
    in three; the middle one goes on with the next word. Segments of up to `small` rows are sorted word by word."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.arange(n)
    segments = [(0, n, 0)]
    while segments:
        a, b, depth = segments.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        own = order[a:b]
        if b - a <= small:
            order[a:b] = own[_by_words(words[own, depth:])]
            continue
        key = words[own, depth]
        pivot = np.sort(key[:: len(key) // 1024 + 1])[len(key[:: len(key) // 1024 + 1]) // 2]
        less, more = key < pivot, key > pivot
        low, middle, high = own[less], own[~less & ~more], own[more]
        order[a:b] = np.concatenate([low, middle, high])
        i, j = a + len(low), a + len(low) + len(middle)
        segments += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def _by_words(words: np.ndarray) -> np.ndarray:
    """Order of a few rows of words: by the first, then ties alone by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    tied, group = np.arange(len(words)), np.zeros(len(words), np.int64)  # places whose rows are equal so far, and their group
    for j in range(words.shape[1]):
        if j:
            order[tied] = order[tied][np.lexsort((words[order[tied], j], group))]
        key = words[order[tied], j]
        number = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        many = np.bincount(number)[number] > 1
        tied, group = tied[many], number[many]
        if not len(tied):
            break
    return order


def repeated_windows(suffixes: np.ndarray, config: SuffixConfig) -> np.ndarray:
    """For each suffix the windows (a bit for each distance of the start to the anchor) that a smaller doc_id has."""
    out = np.zeros(len(suffixes), np.uint64)
    if len(suffixes) < 2:
        return out
    left = config.length - config.gram
    context = suffixes["context"]
    order = multikey_order(np.ascontiguousarray(context[:, left:]))
    own, context = suffixes[order], np.ascontiguousarray(context[order])
    # bytes in which neighbours agree
    agree = np.empty(len(order) - 1, np.int64)
    for a in range(0, len(agree), 1 << 16):
        b = min(a + (1 << 16), len(agree))
        unlike = context[a + 1 : b + 1, left:] != context[a:b, left:]
        agree[a:b] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), config.length)
    before = np.zeros(len(order), np.uint64)
    windows = np.zeros(len(order), np.uint64)
    for distance in range(left + 1):
        if distance:
            before = (before + context[:, left - distance].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            before ^= before >> np.uint64(31)
        apart = np.r_[True, agree < config.length - distance]
        number = np.cumsum(apart)
        has = (own["near"] <= distance) & (own["far"] >= distance)
        has &= np.bincount(number, weights=has)[number] > 1
        at = np.flatnonzero(has)
        if not len(at):
            continue
        key = (before[at] ^ (number[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
        inner = np.lexsort((own["doc"][at], key))
        at, key = at[inner], key[inner]
        new = np.r_[True, key[1:] != key[:-1]]
        head = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        view = slice(left - distance, left - distance + config.length)
        later = own["doc"][at] > own["doc"][head]
        unlike = np.flatnonzero(later)
        unlike = unlike[(context[at[unlike], view] != context[head[unlike], view]).any(axis=1)]
        if len(unlike):  # two classes share a hash: judge all rows of that hash by their bytes
            for k in np.unique(key[unlike]):
                members = np.flatnonzero(key == k)
                least: dict[bytes, int] = {}
                for m in members:
                    bytes_ = context[at[m], view].tobytes()
                    least[bytes_] = min(least.get(bytes_, NO_ID), int(own["doc"][at[m]]))
                later[members] = [int(own["doc"][at[m]]) > least[context[at[m], view].tobytes()] for m in members]
        windows[at[later]] |= np.uint64(1) << np.uint64(distance)
    out[order] = windows
    return out


def _compare(config: SuffixConfig):
    def run(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return table.select(["block", "data"])
        layout = _layout(config)
        suffixes = np.concatenate([np.frombuffer(x.as_buffer(), layout) for x in table.column("data")])
        windows = repeated_windows(suffixes, config)
        suffixes, windows = suffixes[windows > 0], windows[windows > 0]
        order = np.argsort(suffixes["block"], kind="stable")
        suffixes, windows = suffixes[order], windows[order]
        block = suffixes["block"]
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() + [len(block)] if len(block) else []
        out = [(int(block[a]), _marks(suffixes[a:b], windows[a:b])) for a, b in zip(cut, cut[1:])]
        b, x = zip(*out) if out else ((), ())
        return pa.table({"block": pa.array(b, pa.int64()), "data": pa.array(x, pa.binary())})

    return run


def _splitters(joined: DataFrame, config: SuffixConfig, buckets: int, n_bytes: int) -> np.ndarray:
    """Leading bytes that cut the suffixes into about even ranges, from a sample of blocks."""
    n_blocks = max(1, n_bytes // config.blocks.block_bytes)
    every = max(1, n_blocks // 64)
    each = max(16, config.sample_suffixes * every // n_blocks)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = config.length - config.gram
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                kept, _ = _same_around(suffixes_of(block, hit_codes(batch.column("found")[n])[0], buckets, config))
                chosen = kept[np.random.default_rng(block.block).permutation(len(kept))[:each]]
                leading = np.ascontiguousarray(chosen["context"][:, left : left + config.leading]).tobytes()
                yield binary_batch({"data": ([leading], pa.binary()), "n": ([len(kept)], pa.int64())})

    rows = joined.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).mapInArrow(sample, "data binary, n long").collect()
    leading = np.sort(np.frombuffer(b"".join(bytes(r["data"]) for r in rows), f"S{config.leading}"))
    ranges = min(100_000, round(sum(r["n"] for r in rows) * every / config.bucket_suffixes))
    return np.unique(leading[np.linspace(0, len(leading) - 1, ranges + 1).astype(int)[1:-1]]) if ranges > 1 and len(leading) else leading[:0]


def _gone(block: Block, found: pa.ListScalar, config: SuffixConfig) -> np.ndarray:
    """Which bytes of a block go, by the marks found for it."""
    cover = np.zeros(len(block.data) + 1, np.int32)
    for mark in found if found.is_valid else ():
        marks = np.frombuffer(mark["data"].as_buffer(), _MARK)
        for distance in range(config.length - config.gram + 1):
            start = marks["position"][(marks["windows"] >> np.uint64(distance)) & np.uint64(1) > 0].astype(np.int64) - distance
            np.add.at(cover, start, 1)
            np.add.at(cover, start + config.length, -1)
    return np.cumsum(cover[:-1]) > 0


def _digests(config: SuffixConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                gone, rows = _gone(block, batch.column("found")[n], config), []
                for doc_id, a, b in zip(block.doc_ids.tolist(), block.starts.tolist(), block.ends.tolist()):
                    own, data = gone[a:b], block.data[a:b]
                    begins = np.flatnonzero(own & np.r_[True, ~own[:-1]]) if len(own) else np.zeros(0, int)
                    rows.append((None if doc_id == NO_ID else doc_id, b - a, int(own.sum()), len(begins), hashlib.sha256(data[~own].tobytes()).hexdigest()))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), kinds)], names=names)

    return run


def _texts(config: SuffixConfig):
    """What is left of each document, with its further columns; about 1 MB of text in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block in enumerate(each_block(batch)):
                gone, rest = _gone(block, batch.column("found")[n], config), rest_of(batch.column("rest")[n])
                start = 0
                while start < len(block.ends):
                    stop = max(start + 1, int(np.searchsorted(block.ends, block.starts[start] + (1 << 20))))
                    kept, cut = [], []
                    for a, b in zip(block.starts[start:stop].tolist(), block.ends[start:stop].tolist()):
                        cut.append(bool(gone[a:b].any()))
                        kept.append(_whole_characters(block.data[a:b], gone[a:b]) if cut[-1] else block.data[a:b].tobytes().decode(errors="replace"))
                    yield pa.RecordBatch.from_arrays([rest.slice(start, stop - start), pa.array(kept, pa.string()), pa.array(cut, pa.bool_())], names=["rest", "kept_text", "cut"])
                    start = stop

    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are gone."""
    lead = (data & 0xC0) != 0x80
    stays = np.zeros(len(data), bool)
    if len(data):
        character = np.cumsum(lead) - 1
        stays = np.bincount(character, weights=~gone)[character] > 0
    return data[stays].tobytes().decode(errors="replace")


def _found(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """The blocks of docs, each with its marks."""
    blocks = pack_blocks(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), config.blocks)
    with scratch(docs.sparkSession):
        buckets = blocks.screen_buckets(2 / (config.length - config.gram + 2))
        hits = repeated_keys(blocks, lambda block: _keys(config, block), buckets)
        joined = blocks.with_found(staged(hits))
        splitters = _splitters(joined, config, buckets, blocks.n_bytes)
        sent = joined.mapInArrow(_send(config, buckets, splitters), "range long, block long, data binary")
        marks = lasting(sent.groupBy("range").applyInArrow(_compare(config), "block long, data binary"))
    return blocks.with_found(marks, all_blocks=True)


def remove_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text).

    Each byte goes that is covered by a window of `length` bytes which also starts in a row with a smaller doc_id.
    Null text is empty; a null doc_id comes after all others; rows with the same doc_id take nothing from each
    other. Further columns are ignored; an empty table gives none.
    """
    with scratch(docs.sparkSession):
        found = _found(docs.select("doc_id", "text"), config)
        return lasting(found.mapInArrow(_digests(config), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def without_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """docs with the text that is left (a character stays if any of its bytes does), and n_chars (if there is one) of
    it where something went. Rows of whose text nothing is left go; null and empty texts stay as they are, repeated rows take
    nothing from each other, and an empty table gives none. The further columns stay with the text in the blocks."""
    rest = [c for c in docs.columns if c != "text"]
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.col("text").isNull().alias(_NO_TEXT)).alias("rest"), "doc_id", "text")
    schema = StructType([StructField("rest", given.schema["rest"].dataType), StructField("kept_text", StringType()), StructField("cut", BooleanType())])
    left = _found(given, config).mapInArrow(_texts(config), schema).where("not cut or kept_text <> ''")
    own = lambda c: F.col("rest")[c]
    text = F.when(~own(_NO_TEXT), F.col("kept_text"))
    chars = lambda c: F.when(F.col("cut"), F.char_length("kept_text").cast("long")).otherwise(own(c))
    return left.select(*(text.alias(c) if c == "text" else (chars(c) if c == "n_chars" else own(c)).alias(c) for c in docs.columns))
