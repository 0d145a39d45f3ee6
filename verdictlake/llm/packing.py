"""Packing of token sequences by best fit and swap-based local search.

Texts become ids in the tasks that read them; only the lengths of their pieces travel. Pieces are dealt into groups of
bounded size, each of which is packed by itself: best fit decreasing first, then a local search over the underfull
bins that raises the sum of squared fills. Fuller bins get fuller and the emptiest ones run empty. What is left in
underfull bins of all groups meets in fewer groups in a next round, until one group holds it.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import Remembered, lasting, scratch, staged, whole_text


@dataclass(frozen=True)
class PackingConfig:
    """tokenizer_path: a file of the tokenizers library. end_id: put after each document. capacity: ids of a sequence.
    group_pieces: pieces that one task packs at most, on average. closed_fill: a bin this full isn't packed again.
    sweeps: of the local search over the underfull bins. cached: chunks, and parts of them, that a Python worker remembers, up to
    twice as many."""

    tokenizer_path: str
    end_id: int = 1
    capacity: int = 4096
    group_pieces: int = 40_000
    closed_fill: float = 0.999
    sweeps: int = 3
    cached: int = 500_000


#: Fixed value: the pattern by which the tokenizer cuts its (lower-case) text.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: What is not in a plain text: letters that lower case or composition could join to others.
_WIDE = re.compile("[^\x00-\u017f]|\u0130")


class ChunkTokenizer:
    """ids of whole texts. The tokenizer drops white space and never looks across it, so that chunks between spaces
    are encoded once and remembered. Texts of plain Latin letters are lowered as a whole, and their chunks cut here; what
    is cut goes straight to the tokenizer's model, many in one text whose words are told apart by their last id. Parts of
    chunks are remembered too, as one word stands beside many signs. Chunks of other texts that aren't plain go to the
    tokenizer whole, as do chunks that hold a mark of its own (such as its end of text) in any case, which it takes for that mark wherever it stands."""

    def __init__(self, config: PackingConfig):
        self.tokenizer = Tokenizer.from_file(config.tokenizer_path)
        marks = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = re.compile("|".join(marks) or "(?!)")
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.is_last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and token.endswith(suffix)]] = True
        self.chunks = Remembered(self._encoded, config.cached)

    def _encoded(self, chunk: str) -> bytes:
        return self._ids([chunk])[0]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in found)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """ids of lower-case parts as `_cut` gives them."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(words):  # a tokenizer whose words don't end in ids of their own
            return self._ids(words)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _lowered(self, text: str) -> str | None:
        """A plain text in lower case, or none if it isn't plain or has a mark in either form (a capital one is no mark)."""
        if not text.isascii() and _WIDE.search(text):
            return None
        lower = text.lower()
        return None if self.mark.search(lower) or self.mark.search(text) else lower

    def _split(self, text: str) -> list[str]:
        """Chunks of a text, in lower case if all of it can be lowered."""
        lower = self._lowered(text)
        return (text if lower is None else lower).replace("\n", " ").split(" ")

    def _cut(self, chunk: str) -> list[str] | None:
        """Parts in lower case, or none if the chunk is the tokenizer's alone."""
        lower = self._lowered(chunk)
        return None if lower is None else [lower] if lower.isalpha() else _CUT.findall(lower)

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids as little-endian unsigned 32-bit numbers."""
        chunks = [self._split(text) for text in texts]
        known, older = self.chunks, self.chunks.older
        new = filterfalse(known.__contains__, filterfalse(older.__contains__, set().union(*chunks)))
        cut = {c: self._cut(c) for c in new}
        whole = [c for c, parts in cut.items() if parts is None]
        words = [p for p in set().union(*filter(None, cut.values())) if p not in known and p not in older]
        found = {}
        for make, missing in ((self._ids, whole), (self._word_ids, words)):
            for at in range(0, len(missing), 4096):
                found.update(zip(missing[at : at + 4096], make(missing[at : at + 4096])))
        for chunk, ids in found.items():
            known.put(chunk, ids)
        for chunk, parts in cut.items():
            if parts is not None and not (len(parts) == 1 and parts[0] == chunk):
                known.put(chunk, b"".join([found[p] if p in found else known[p] for p in parts]))
        return [b"".join(map(known.__getitem__, x)) for x in chunks]


_TOKENIZERS: dict[PackingConfig, ChunkTokenizer] = {}


def chunk_tokenizer(config: PackingConfig) -> ChunkTokenizer:
    """One tokenizer for each Python worker."""
    if config not in _TOKENIZERS:
        _TOKENIZERS[config] = ChunkTokenizer(config)
    return _TOKENIZERS[config]


def tokenized_pieces(docs: DataFrame, config: PackingConfig, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, binary) of docs(doc_id, text); null text is empty, and an
    empty one has the end id alone. Documents over the capacity are cut; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = chunk_tokenizer(config), np.array([config.end_id], "<u4").tobytes()
        width = 4 * config.capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist())):
                    ids += end
                    rows += [(doc_id, k, k * config.capacity, len(x := ids[k * width : (k + 1) * width]) // 4, zlib.crc32(x), x) for k in range(-(-len(ids) // width))]
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect.bisect_left(rooms, lengths[i])
        if at == len(rooms):
            where, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            where = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[where].append(i)
        room -= lengths[i]
        if room:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(where)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, sweeps: int) -> list[list[int]]:
    """Move pieces from emptier underfull bins to fuller ones, or exchange one or two small ones of these for a longer
    one of the emptier bin. Each step raises the sum of squared fills; a bin that runs empty is gone."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(sweeps):
        under = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: (-fill[k], k))
        changed = False
        # what the emptier bins hold, by length: for a fuller bin the best gain is looked up, not searched
        holders: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k in under:
            for i in bins[k]:
                holders[lengths[i]].add((k, i))
        sizes = sorted(holders)
        place = {k: n for n, k in enumerate(under)}

        def donor(size: int, into: int) -> tuple[int, int] | None:
            """A piece of this length in a bin that comes after `into`: the emptiest such bin."""
            return max(((place[k], i, k) for k, i in holders.get(size, ()) if place[k] > place[into]), default=(0, 0, None))[1:] if holders.get(size) else None

        def shift(i: int, a: int, b: int) -> None:
            bins[a].remove(i)
            bins[b].append(i)
            fill[a] -= lengths[i]
            fill[b] += lengths[i]
            holders[lengths[i]].discard((a, i))
            holders[lengths[i]].add((b, i))

        for k in under:
            room = capacity - fill[k]
            for _step in range(64):
                if not room:
                    break
                own = sorted(bins[k], key=lambda i: lengths[i])[:8]
                # given up: nothing (a move), one piece (one for one) or two pieces (two for one)
                best = (0, (), None)
                for given in [(), *((x,) for x in own), *((x, y) for n, x in enumerate(own) for y in own[n + 1 :])]:
                    freed = sum(lengths[i] for i in given)
                    at = bisect.bisect_right(sizes, room + freed) - 1
                    while at >= 0 and sizes[at] - freed > best[0]:
                        found = donor(sizes[at], k)
                        if found and found[1] is not None and fill[k] + sizes[at] - freed > fill[found[1]] - sizes[at] + freed:
                            best = (sizes[at] - freed, given, found)
                            break
                        at -= 1
                if best[2] is None:
                    break
                i, source = best[2]
                for x in best[1]:
                    shift(x, k, source)
                shift(i, source, k)
                room, changed = capacity - fill[k], True
        if not changed:
            break
    return [b for b in bins if b]


def _packer(config: PackingConfig, round_no: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pieces["length"].tolist()
        bins = best_fit(lengths, config.capacity)
        enough = config.closed_fill * config.capacity
        is_full = [sum(lengths[i] for i in b) >= enough for b in bins]
        bins = [b for b, x in zip(bins, is_full) if x] + local_search([b for b, x in zip(bins, is_full) if not x], lengths, config.capacity, config.sweeps)
        sequence, offset, closed = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        base = (round_no << 56) | (int(key[0]) << 24)
        for n, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = base | n, at
                at += lengths[i]
            closed[members] = at >= enough
        return pieces.drop(columns="bucket").assign(sequence_id=sequence, offset=offset, closed=closed)

    return run


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"


def pack_pieces(pieces: DataFrame, config: PackingConfig) -> DataFrame:
    """sequence_id and offset for each row of pieces(doc_id, piece, start, length, ids_crc32).

    Repeated rows are packed each by itself; an empty table gives an empty result. Rows of a group are dealt by a hash
    of document and piece, so that no source or length is hot. A round that closes less than half of its pieces is the
    last one: such pieces don't fit together, and gathering them in fewer groups would only make these large.
    """
    with scratch(pieces.sparkSession):
        left, out, round_no = staged(pieces), None, 0
        n = left.count()
        while True:
            groups = max(1, round(n / config.group_pieces))
            dealt = left.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no)), F.lit(groups)))
            placed = staged(dealt.groupBy("bucket").applyInPandas(_packer(config, round_no), _PLACED))
            open_pieces = placed.where("not closed").count() if groups > 1 else n
            last = 2 * open_pieces > n or not open_pieces
            done = (placed if last else placed.where("closed")).drop("closed")
            out = done if out is None else out.unionByName(done)
            if last:
                return lasting(out)
            left, n, round_no = placed.where("not closed").drop("sequence_id", "offset", "closed"), open_pieces, round_no + 1


def pack_documents(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of docs(doc_id, text) stands."""
    return pack_pieces(tokenized_pieces(docs, config), config)
