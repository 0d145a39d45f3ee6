"""Tables that a computation writes for itself into the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

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


def bucketed(df: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """`staged` with rows of equal columns in one bucket, so that groupings and windows by them read it without a shuffle."""
    spark, name = df.sparkSession, f"verdictlake_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *columns).write.format("parquet").option("compression", "zstd").option("path", new_path(spark))
    writer.bucketBy(buckets, *columns).saveAsTable(name)
    frame = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry alone: the files at the path stay, and frame reads them
    return frame
