"""Blocks of documents, and which of their keys occur elsewhere as well.

Documents are packed once into blocks of a few MB, which a task writes to the shared folder in parts of some tens of MB, one
file each. The files are bucketed by part, so that what is found out about a block comes back to it without moving
texts again. Keys (hashes of n-grams) of all blocks are screened: each block sends every key once, as a few bytes in a packed
array for each screen bucket; a bucket tells each block which of its keys others have too. A key in a third of all
documents is one entry for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, new_path, whole_text


@dataclass(frozen=True)
class BlockConfig:
    """block_bytes: text of a block, at least one document. part_bytes: text of a part, at most about. bucket_bytes: text of one
    bucket of parts, about. max_buckets: what Spark allows. screen_keys: keys of one screen bucket, about."""

    block_bytes: int = 2 << 20
    part_bytes: int = 32 << 20
    bucket_bytes: int = 32 << 20
    max_buckets: int = 100_000
    screen_keys: int = 1 << 20


@dataclass
class Block:
    """One block: ids of its documents, where each ends in data, and their bytes."""

    block: int
    doc_ids: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.r_[np.int64(0), self.ends[:-1]]


_BLOCKS = "part long, block long, doc_ids binary, ends binary, data binary, rest binary"
#: A block's number is that of its part, shifted by so many bits, and its place there.
_PLACE_BITS = 16


def _packer(block_bytes: int, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, part_size = TaskContext.get().partitionId() << 20, 0, 0
        ids, texts, rests, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            row = [part, (part << _PLACE_BITS) | place, np.array(ids, np.int64).tobytes(), ends.tobytes(), b"".join(texts), _packed(rests)]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["part", "block", "doc_ids", "ends", "data", "rest"])

        for batch in batches:
            rest = batch.column("rest") if "rest" in batch.schema.names else None
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                data = text.as_py()
                if texts and size + len(data) > block_bytes:
                    yield emit()
                    part_size, place = part_size + size, place + 1
                    ids, texts, rests, size = [], [], [], 0
                    if part_size >= part_bytes or place >> _PLACE_BITS:
                        part, place, part_size = part + 1, 0, 0
                ids.append(doc_id)
                texts.append(data)
                if rest is not None:
                    rests.append(rest.slice(i, 1))
                size += len(data)
        if texts:
            yield emit()

    return run


def _packed(rests: list[pa.Array]) -> bytes | None:
    if not rests:
        return None
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.concat_arrays(rests)], names=["rest"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rest_of(value: pa.BinaryScalar) -> pa.Array:
    """The further columns of a block's documents, as structs."""
    return pa.ipc.open_stream(value.as_buffer()).read_all().column("rest").combine_chunks()


@dataclass(frozen=True)
class Blocks:
    """frame: part, block, doc_ids, ends, data, rest, bucketed by part. n_bytes: of all texts."""

    frame: DataFrame
    n_bytes: int
    buckets: int
    config: BlockConfig

    def screen_buckets(self, keys_per_byte: float) -> int:
        return max(1, round(self.n_bytes * keys_per_byte / self.config.screen_keys))

    def with_found(self, found: DataFrame, all_blocks: bool = False) -> DataFrame:
        """frame with a column found: an array of the rows of found(block, ...) that are about the block. Blocks
        about which there are none stay if all_blocks. What is found moves to the buckets, the blocks don't move."""
        rows = found.withColumn("part", F.shiftright("block", _PLACE_BITS)).repartition(self.buckets, "part")
        of_part = rows.groupBy("part").agg(F.collect_list(F.struct(*found.columns)).alias("found"))
        own = F.filter("found", lambda x: x["block"] == F.col("block"))
        joined = self.frame.join(of_part, "part", "left" if all_blocks else "inner").withColumn("found", own)
        return joined if all_blocks else joined.where(F.size("found") > 0)


def pack_blocks(docs: DataFrame, config: BlockConfig = BlockConfig()) -> Blocks:
    """Write docs(doc_id, text) as blocks; null text is empty. Rows without a doc_id must be out already. A column
    rest (a struct), if there is one, stays with the blocks."""
    spark = docs.sparkSession
    further = ["rest"] if "rest" in docs.columns else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"), *further)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(config.max_buckets, -(-n_bytes // config.bucket_bytes)))
    # several parts for each bucket, so that hashing fills them evenly
    part_bytes = min(config.part_bytes, n_bytes // (8 * buckets))
    path = new_path(spark)
    name = f"verdictlake_blocks_{uuid.uuid4().hex}"
    writer = texts.mapInArrow(_packer(config.block_bytes, part_bytes), _BLOCKS).write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, "part").saveAsTable(name)
    frame = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry alone: the files at the path stay, and frame reads them
    return Blocks(frame, n_bytes, buckets, config)


def each_block(batch: pa.RecordBatch) -> Iterator[Block]:
    """The blocks of a batch, as views."""
    for i in range(batch.num_rows):
        views = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("doc_ids", np.int64), ("ends", np.int64), ("data", np.uint8))]
        yield Block(batch.column("block")[i].as_py(), *views)


def split_key(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The screen bucket of 64-bit keys, and the 32 bits that stand for them there."""
    mixed = mix64(keys)
    return ((mixed >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24), mixed.astype(np.uint32)


def binary_batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _sender(keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in each_block(batch):
                keys, owners = keys_of(block)
                bucket, rest = split_key(keys, buckets)
                code = (bucket << np.uint64(32)) | rest
                order = np.argsort(code, kind="stable")
                code, owners = code[order], owners[order]
                if not len(code):
                    continue
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                several = np.maximum.reduceat(owners, first) != np.minimum.reduceat(owners, first)
                code = code[first]
                cut = np.flatnonzero(np.r_[True, (code[1:] >> np.uint64(32)) != (code[:-1] >> np.uint64(32))]).tolist() + [len(code)]
                rest = code.astype(np.uint32)
                rows = [((int(code[a] >> np.uint64(32))), block.block, rest[a:b].tobytes(), rest[a:b][several[a:b]].tobytes()) for a, b in zip(cut, cut[1:])]
                b, k, x, y = zip(*rows)
                yield binary_batch({"bucket": (b, pa.int64()), "block": (k, pa.int64()), "keys": (x, pa.binary()), "several": (y, pa.binary())})

    return run


def _screen(table: pa.Table) -> pa.Table:
    """For each block the keys that have several owners in it or are in another block too, and in how many places."""
    bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
    several = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("several")]
    ranked = np.sort(np.concatenate(keys + several))
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    counts = np.diff(np.r_[first, len(ranked)])
    repeated, counts = ranked[first][counts > 1], counts[counts > 1].astype(np.uint32)
    out = []
    for block, own in zip(blocks, keys):
        at = np.searchsorted(repeated, own)
        at = np.where(at < len(repeated), at, 0)
        hit = repeated[at] == own if len(repeated) else np.zeros(len(own), bool)
        if hit.any():
            out.append((block, bucket, own[hit].tobytes(), counts[at[hit]].tobytes()))
    b, k, x, y = zip(*out) if out else ((), (), (), ())
    return pa.table({"block": pa.array(b, pa.int64()), "bucket": pa.array(k, pa.int64()), "keys": pa.array(x, pa.binary()), "counts": pa.array(y, pa.binary())})


def repeated_keys(blocks: Blocks, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """block, bucket, keys, counts: the keys of a block that have several owners anywhere. keys_of gives the 64-bit keys
    of a block and an owner number (within the block) for each. 32 bits of a key are compared in its bucket, so a few
    keys are taken for repeated that aren't; who uses them must compare what they stand for."""
    sent = blocks.frame.mapInArrow(_sender(keys_of, buckets), "bucket long, block long, keys binary, several binary")
    return sent.groupBy("bucket").applyInArrow(_screen, "block long, bucket long, keys binary, counts binary")


def hit_codes(hits: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes (bucket and 32 bits) of a block's repeated keys, and their counts."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for hit in hits:
        codes.append((np.uint64(hit["bucket"].as_py()) << np.uint64(32)) | np.frombuffer(hit["keys"].as_buffer(), np.uint32).astype(np.uint64))
        counts.append(np.frombuffer(hit["counts"].as_buffer(), np.uint32))
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes)
    return codes[order], counts[order]


def is_hit(keys: np.ndarray, buckets: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the codes, and where."""
    if not len(codes) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    bucket, rest = split_key(keys, buckets)
    code = (bucket << np.uint64(32)) | rest
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return codes[at] == code, at


_PRIME = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        tables = []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            table, step = np.ones(1, np.uint64), base
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(step)])
                step = step * step % (1 << 64)
            tables.append(table)
        _POWERS[size] = tables[0], tables[1]
    return _POWERS[size]


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams that start at each token."""
    size = len(tokens) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(tokens))
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens.astype(np.uint64) * up[: len(tokens)] + up[: len(tokens)], out=sums[1:])
    return mix64((sums[n:] - sums[:size]) * down[:size])


@dataclass
class Anchors:
    """Chosen positions: windows of `length` tokens that start in first..last (both included) have their anchor at
    position, and every window has one. Equal windows have equal anchors. keys: hashes of the n-gram at the anchor."""

    position: np.ndarray
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray


_SLICE = 1 << 18


def anchors(tokens: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Anchors:
    """The anchor of a window is the leftmost n-gram of the smallest hash in it (minimizers). ends: of documents."""
    choose = length - gram + 1
    doc_end = np.repeat(ends, np.diff(np.r_[0, ends]))
    parts = []
    for begin in range(0, max(0, len(tokens) - length + 1), _SLICE):
        own = tokens[begin : begin + _SLICE + length - 1]
        h = gram_hashes(own, gram)
        low = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= choose:
            low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
        low = np.minimum(low[: len(low) - (choose - width)], low[choose - width :])
        starts = np.arange(len(low))
        ok = starts + (begin + length) <= doc_end[begin : begin + len(low)]
        at, starts = (low[ok] & np.uint64(0xFFFFF)).astype(np.int64), starts[ok]
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        parts.append((at[new] + begin, starts[new] + begin, starts[np.r_[new[1:] - 1, len(at) - 1]] + begin, h[at[new]]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, np.zeros(0, np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*parts)))


def documents_of(block: Block, positions: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number, within the block, of the document that holds each position."""
    return np.searchsorted(ends, positions, side="right")
