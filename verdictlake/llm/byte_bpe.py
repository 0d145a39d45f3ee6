"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

Every prefix of a byte string has exactly one BPE encoding, so exactly one token can stand last in it. A token that
ends the prefix is that one when the token before it (the last one of the shorter prefix) and it are what BPE makes of
the two together. `PrefixEncoder` keeps the last token of every prefix: bytes are appended without touching what is
there, and after an edit only the prefixes near it are worked out again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, whole_text

_WHITE = regex.compile(r"\s")


@dataclass(frozen=True)
class BpeConfig:
    """ranks_path: a file of base64 tokens and ranks. pattern: pieces that are encoded separately.
    cached: pieces, text chunks and token pairs that a Python worker remembers, up to twice as many of each."""

    ranks_path: str
    pattern: str
    cached: int = 400_000


class Vocabulary:
    """Ranks of tokens, and which tokens can follow each other."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 400_000):
        self.ranks, self.cached = ranks, cached
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str, cached: int = 400_000) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(i) for t, i in (x.split() for x in lines if x.strip())}, cached)

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short string: merge the pair of the lowest rank, the leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens as they are when they stand side by side."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.cached:
                self.pairs.clear()
            x, y = self.tokens[left], self.tokens[right]
            found = self.pairs[left, right] = self.merged(x + y) == [x, y]
        return found


class PrefixEncoder:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.start = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing that is there changes."""
        begin, self.data = len(self.data), self.data + more
        token_of, pairs, follows, longest = self.vocabulary.ranks.get, self.vocabulary.pairs, self.vocabulary.follows, self.vocabulary.longest
        data, last, starts = self.data, self.last, self.start
        for end in range(begin + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(data[start:end])
                if token is not None and (not start or pairs.get((last[start], token)) or follows(last[start], token)):
                    last.append(token)
                    starts.append(start)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def truncate(self, size: int) -> None:
        """Forget all bytes from there on."""
        self.data = self.data[:size]
        del self.last[size + 1 :], self.start[size + 1 :]

    def edit(self, begin: int, end: int, replacement: bytes) -> int:
        """Replace data[begin:end]. Prefixes are worked out again from `begin` until as many in a row as the longest
        token has bytes have the tokens they had before; returns how many were."""
        old_last, old_start, shift = self.last, self.start, len(replacement) - (end - begin)
        self.data = self.data[:begin] + replacement + self.data[end:]
        self.last, self.start = old_last[: begin + 1], old_start[: begin + 1]
        same = done = 0
        data, self.data = self.data, self.data[:begin]
        for at in range(begin + 1, len(data) + 1):
            self.append(data[at - 1 : at])
            done += 1
            same = same + 1 if at - len(replacement) > begin and old_last[at - shift] == self.last[at] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[at - shift + 1 :]
                self.start += [s + shift for s in old_start[at - shift + 1 :]]
                break
        self.data = data
        return done

    def ids(self) -> list[int]:
        """The encoding of the whole string."""
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at = self.start[at]
        return out[::-1]


class TextEncoder:
    """Encodes whole texts; what it remembers is bounded."""

    def __init__(self, config: BpeConfig):
        self.vocabulary = Vocabulary.read(config.ranks_path, config.cached)
        self.pattern = regex.compile(config.pattern)
        self.pieces = Remembered(self._piece, config.cached)
        self.chunks = Remembered(self._chunk, config.cached)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        ids = [token] if token is not None else PrefixEncoder(self.vocabulary, data).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def prepare(self, texts: list[str]) -> None:
        """Encode the pieces of these texts that aren't remembered, in order: what two neighbours begin with in common
        is worked out once."""
        known, older = self.chunks, self.chunks.older
        chunks = {c for c in set().union(*(text.split(" ") for text in texts)) if c not in known and c not in older and len(c) <= 256}
        pieces, ranks = self.pieces, self.vocabulary.ranks
        new = sorted({data for c in chunks for p in self.pattern.findall(" " + c) if p not in pieces and p not in pieces.older and (data := p.encode()) not in ranks})
        own, before = PrefixEncoder(self.vocabulary), b""
        for data in new:
            shared = len(os.path.commonprefix((data, before)))
            own.truncate(shared)
            own.append(data[shared:])
            ids, before = own.ids(), data
            pieces.put(data.decode(), struct.pack(f"<{len(ids)}I", *ids))

    def _chunk(self, chunk: str) -> bytes | None:
        """ids of what follows a space; None where the neighbours could change how it is cut."""
        if not chunk or _WHITE.match(chunk) or _WHITE.match(chunk[-1]):
            return None
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(" " + chunk)))

    def encode(self, text: str) -> bytes:
        """ids as little-endian 32-bit numbers. Between single spaces chunks are cut as they are alone; a text in
        which white space meets white space or an end is cut by the pattern as a whole."""
        first, *rest = text.split(" ")
        if first and not _WHITE.match(first[-1]):
            found = [*map(self.chunks.__getitem__, rest)]
            if None not in found:
                return b"".join([*map(self.pieces.__getitem__, self.pattern.findall(first)), *found])
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ENCODERS: dict[BpeConfig, TextEncoder] = {}


def encoder(config: BpeConfig) -> TextEncoder:
    """One encoder for each Python worker."""
    if config not in _ENCODERS:
        _ENCODERS[config] = TextEncoder(config)
    return _ENCODERS[config]


def encode_documents(docs: DataFrame, config: BpeConfig) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) for each row of docs(doc_id, text).

    Null text is empty and has no ids. Repeated rows give repeated results; further columns are ignored; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(config)
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column("text").to_pylist()
                own.prepare(texts)
                ids = [own.encode(text) for text in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encoding_digest(docs: DataFrame, config: BpeConfig) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode_documents` gives, hashed where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(config)
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column("text")):
                if at % 256 == 0:
                    own.prepare(batch.column("text")[at : at + 256].to_pylist())
                ids = own.encode(text.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, ids_sha, decoded_sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
