"""Pieces that several corpus operators share: shared-folder tables and views on Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What POSIX and the contracts call white space between words.
WORD_BREAKS = b" \t\n\r\x0b\x0c"


#: Tables of the computations that are under way, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose tasks run in the
    driver's process, may have none and gets a temporary one; a cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, which goes with the innermost `scratch`."""
    path = f"{shared_folder(spark)}/verdictlake-{uuid.uuid4().hex}"
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, which nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged in this scope are deleted at its end; `lasting` ones belong to the scope around it."""
    scopes = _SCOPES.get()
    token = _SCOPES.set((*scopes, []))
    try:
        yield
    finally:
        paths = _SCOPES.get()[-1]
        _SCOPES.reset(token)
        for path in paths:
            discard(spark, path)


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back, so later steps neither recompute nor
    depend on an executor that may be lost."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lasting(df: DataFrame) -> DataFrame:
    """`staged` for what a computation returns: the table outlives the innermost scratch."""
    token = _SCOPES.set(_SCOPES.get()[:-1])
    try:
        return staged(df)
    finally:
        _SCOPES.reset(token)


def whole_text(column: str | Column = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def ascii_lower(column: Column) -> Column:
    """A-Z as a-z, nothing else changed. Spark's own lower case, which is the same on pure ASCII, is much faster than translate."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string or binary array without copying; offsets index the bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Remembered(dict):
    """What `make` gives for a key. About the `size` to twice `size` keys used last are kept."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        self.put(key, value)
        return value
