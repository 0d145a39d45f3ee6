"""Sink of training rows: files for each split whose bytes depend on the rows alone, written and digested by the executors."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import SPLITS
from ..staging import scratch, staged

#: What rows are ordered by inside of a file, as far as they have it; equal ones by their line.
_ORDER = ("prompt_id", "a_id", "b_id", "chosen_id", "rejected_id", "response_id")


def write_splits(rows: DataFrame, path: str, rows_per_file: int = 200_000) -> dict[str, str]:
    """Write rows as {split}-{number}.jsonl under path, which must not exist yet, and their SHA-256 into digests.json; returns these, with one
    over all of them as `all`. A split without rows has an empty file.

    How many files a split has follows from its rows, which of them a row goes to from its prompt, and its place from its keys, so
    that another run, on whatever cluster, writes the same bytes. A file is a task's and no larger than rows_per_file makes it;
    the driver renames files and lists digests, and sees no row."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(top):
        raise ValueError(f"{path} is already there")
    fields = sorted(c for c in rows.columns if c != "split")
    with scratch(spark):
        lines = staged(rows.select("split", *(c for c in _ORDER if c in fields), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line")))
        counts = {r["split"]: r["n"] for r in lines.groupBy("split").agg(F.count("*").alias("n")).collect()}
        files = {s: max(1, -(-counts.get(s, 0) // rows_per_file)) for s in SPLITS}
        number = F.lit(0).cast("long")
        for s, n in files.items():
            number = F.when(F.col("split") == s, F.pmod(F.xxhash64("prompt_id"), F.lit(n))).otherwise(number)
        named = lines.withColumn("file", F.format_string("%s-%05d", F.col("split"), number))
        order = [c for c in _ORDER if c in fields]
        parts = max(sum(files.values()), int(spark.conf.get("spark.sql.shuffle.partitions")))
        named.repartition(parts, "file").sortWithinPartitions("file", *order, "line").select("file", "line").write.partitionBy("file").text(f"{path}/_files")
    digests = {}
    for s, n in files.items():
        for k in range(n):
            name = f"{s}-{k:05d}"
            digests[f"{name}.jsonl"] = hashlib.sha256(b"").hexdigest()
            inner = hadoop.Path(f"{path}/_files/file={name}")
            found = [f.getPath() for f in (fs.listStatus(inner) if fs.exists(inner) else []) if f.getPath().getName().startswith("part-")]
            if found:
                fs.rename(found[0], hadoop.Path(f"{path}/{name}.jsonl"))
            else:
                fs.create(hadoop.Path(f"{path}/{name}.jsonl")).close()
    fs.delete(hadoop.Path(f"{path}/_files"), True)
    # files without a byte are not read, and keep the digest of none
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path)
    digests |= {r["name"]: r["digest"] for r in read.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("digest")).collect()}
    digests = dict(sorted(digests.items()))
    digests["all"] = hashlib.sha256("".join(f"{d}  {n}\n" for n, d in digests.items()).encode()).hexdigest()
    out = fs.create(hadoop.Path(f"{path}/digests.json"), True)
    out.write(bytearray((json.dumps(digests, indent=2) + "\n").encode()))
    out.close()
    return digests
