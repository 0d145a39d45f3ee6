"""Exact duplicates by composable polynomial fingerprints.

A text is a byte string b0 b1 ...; its fingerprint is (length, sum b_i * B1^i mod M1, sum b_i * B2^i mod M2). The
fingerprint of x+y is that of x plus that of y shifted by B^len(x), so a huge text is cut into pieces which are
hashed in different tasks, and the pieces' values, shifted by their offsets, are simply summed. Rows with equal
fingerprints are then compared byte by byte, piece by piece: for each (fingerprint, piece) the smallest and the
largest piece must be the same. Those two are pre-aggregated before the shuffle, so a group with a third of all rows
costs one row for each task and piece. Groups that fail (a collision) are split by their texts.

Shuffles: fingerprints (about 100 bytes a row) and, where the ids of groups are too many to broadcast, once the texts by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, scratch, staged, text_buffers, whole_text


@dataclass(frozen=True)
class FingerprintConfig:
    """moduli: two primes under 2^31. bases: below them. piece_bytes: pieces for hashing huge texts, at most 2^16.
    huge_bytes: texts above it are hashed in pieces by several tasks. compare_bytes: pieces when texts are compared."""

    moduli: tuple[int, int] = (2147483647, 2147483629)
    bases: tuple[int, int] = (1380247591, 1907432713)
    piece_bytes: int = 1 << 16
    huge_bytes: int = 4 << 20
    compare_bytes: int = 1 << 16


_PIECES = "doc_id long, text_sha256 string, offset long, n_bytes long, h1 long, h2 long"


def polynomial(view: np.ndarray, powers: np.ndarray, modulus: int) -> int:
    """sum view[i] * powers[i] mod modulus; exact as 2^8 * 2^31 * 2^16 < 2^64."""
    return int(np.dot(view, powers[: len(view)]) % np.uint64(modulus))


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base % modulus
    return out


def fingerprint(data: bytes, config: FingerprintConfig = FingerprintConfig()) -> tuple[int, int, int]:
    """(length, h1, h2) of one byte string, for tests and small uses."""
    tables = [_powers(b, m, config.piece_bytes) for b, m in zip(config.bases, config.moduli)]
    whole = np.frombuffer(data, np.uint8)
    values = _hash_range(whole, 0, tables, config)
    return len(data), values[0], values[1]


def combine(x: tuple[int, int, int], y: tuple[int, int, int], config: FingerprintConfig = FingerprintConfig()) -> tuple[int, int, int]:
    """The fingerprint of a concatenation from those of its two parts."""
    h = [(a + pow(b, x[0], m) * c) % m for a, c, b, m in zip(x[1:], y[1:], config.bases, config.moduli)]
    return x[0] + y[0], h[0], h[1]


def _hash_range(view: np.ndarray, offset: int, tables: list[np.ndarray], config: FingerprintConfig) -> list[int]:
    out = []
    for powers, base, modulus in zip(tables, config.bases, config.moduli):
        total = 0
        for at in range(0, len(view), config.piece_bytes):
            part = polynomial(view[at : at + config.piece_bytes].astype(np.uint64), powers, modulus)
            total += part if not (at or offset) else part * pow(base, offset + at, modulus)
        out.append(total % modulus)
    return out


def _hasher(config: FingerprintConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_powers(b, m, config.piece_bytes) for b, m in zip(config.bases, config.moduli)]
        for batch in batches:
            offsets, data = text_buffers(batch.column("piece"))
            starts = batch.column("offset").to_pylist()
            rows = [_hash_range(data[offsets[i] : offsets[i + 1]], starts[i], tables, config) for i in range(len(starts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_sha256"),
                    batch.column("offset"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                ],
                names=["doc_id", "text_sha256", "offset", "n_bytes", "h1", "h2"],
            )

    return run


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """One row for each piece of `size` bytes; an empty text has one empty piece."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((F.octet_length("text") - 1).cast("long"), F.lit(0).cast("long")), F.lit(size).cast("long")))
    cut = docs.withColumn("offset", at)
    return cut.withColumn("piece", F.expr(f"substring(cast(text as binary), cast(offset as int) + 1, {size})")).drop("text")


def fingerprints(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """doc_id, text_sha256, n_bytes, h1, h2: one row for each row of docs(doc_id, text); null text is empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    is_huge = F.octet_length("text") > config.huge_bytes
    small = texts.where(~is_huge).select("doc_id", "text_sha256", F.lit(0).cast("long").alias("offset"), F.col("text").cast("binary").alias("piece"))
    small = small.mapInArrow(_hasher(config), _PIECES).drop("offset")
    pieces = _cut(texts.where(is_huge), 16 * config.piece_bytes).select("doc_id", "text_sha256", "offset", "piece")
    pieces = pieces.repartition("doc_id", "offset").mapInArrow(_hasher(config), _PIECES)
    # a row that is there twice has each piece twice: count, sum once, expand again
    once = pieces.groupBy("doc_id", "text_sha256", "offset").agg(F.max("n_bytes").alias("n_bytes"), F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.count("*").alias("copies"))
    sums = once.groupBy("doc_id", "text_sha256").agg(F.sum("n_bytes").alias("n_bytes"), *(F.pmod(F.sum(h), F.lit(m)).alias(h) for h, m in zip(("h1", "h2"), config.moduli)), F.max("copies").alias("copies"))
    huge = sums.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(small.columns)
    return small.unionByName(huge)


def exact_duplicates(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Of equal texts the row with the largest doc_id stays. Null text counts as empty. Rows that repeat a doc_id and
    its text all say the same (each is `kept` if it is the largest); a null doc_id never beats another. Further
    columns of docs are ignored. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        return lasting(_exact_duplicates(docs, config))


def _exact_duplicates(docs: DataFrame, config: FingerprintConfig) -> DataFrame:
    key = ["n_bytes", "h1", "h2"]
    prints = staged(fingerprints(docs, config))
    groups = prints.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = staged(prints.join(groups, key).withColumn("clash", F.lit(0).cast("long")))

    # texts are first thinned out by ids alone, which are few bytes a row, and hashed again only then
    ids = staged(rows.where("group_size > 1").select(F.col("doc_id").alias("m_id")).distinct())
    members = rows.where("group_size > 1").select("doc_id", "text_sha256", *key).distinct().withColumnRenamed("doc_id", "m_id").withColumnRenamed("text_sha256", "m_sha")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("m_id")), "left_semi").withColumn("text_sha256", F.sha2("text", 256))
    same_row = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha"))
    candidates = texts.join(members, same_row).drop("m_id", "m_sha", "text_sha256", "doc_id")
    compared = _cut(candidates, config.compare_bytes).groupBy(*key, "offset").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    unequal = staged(compared.where("low <> high").select(*key).distinct())
    if not unequal.isEmpty():
        apart = texts.join(members, same_row).join(unequal, key).select(*key, "doc_id", "text_sha256", "text")
        classes = apart.groupBy(*key, "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = apart.join(classes, [*key, "text"]).select(*key, "doc_id", "text_sha256", "keep_id", "group_size")
        rows = rows.join(unequal, key, "left_anti").select(apart.columns).unionByName(apart)
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """docs without the rows whose text stays elsewhere; all columns are kept, and one row of those that repeat id and text.
    Rows without an id stay, each text of theirs once. Only rows that repeat an id and a text are shuffled with their texts."""
    found = exact_duplicates(docs, config)
    # where an id occurs once it says which row goes; the text's hash is only wanted for the others
    several = staged(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("gone_id")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    alone = staged(gone.join(several, "gone_id", "left_anti").select("gone_id"))
    mixed = staged(gone.join(several, "gone_id", "left_semi"))
    row = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("at_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_sha256").alias("at_sha")]
    twice = staged(found.where("kept or doc_id is null").groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    sha = F.sha2(whole_text(), 256)
    same = F.col("doc_id").cast("long") == F.col("gone_id")
    kept = docs.join(alone, same, "left_anti")
    if not mixed.isEmpty():
        # equal hashes, said so that rows are dealt by id alone as before
        kept = kept.join(mixed, same & (sha >= F.col("gone_sha")) & (sha <= F.col("gone_sha")), "left_anti")
    if twice.isEmpty():
        return kept
    repeats = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col("at_id")) & (F.col("doc_id").isNull() == F.col("no_id")) & (sha == F.col("at_sha"))
    once = kept.join(twice, repeats, "left_semi")
    first = once.dropDuplicates(["doc_id", "text"])
    return kept.join(twice, repeats, "left_anti").unionByName(first)
