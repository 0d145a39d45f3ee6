"""Immutable shards with size-tiered compaction and versioned manifests.

A store is a folder: `data/gen=G/shard=S` holds the rows of a shard and never changes, `manifests/M` lists the shards
that live together, and `versions/N` names the manifest and the schema of version N. A version is committed by renaming a finished file
to that name, which fails where it exists: one of two writers that raced wins, the other gets a CommitConflict. A
writer that dies earlier leaves a file under a name of its own, which nobody reads, so that a job can fail or lose executors at
any point. The rename is atomic on HDFS and the like; an object store without such a rename needs a lock of its own.

Arrivals are appended where they are read, without a shuffle: what a task has of an arrival is one small shard.
Compaction puts runs of similar size (a tier) together as long as a tier has `fanout` of them. Readers and compaction open
the generations that the manifest names, so nothing that is dead or uncommitted is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import scratch, staged


@dataclass(frozen=True)
class ShardConfig:
    """target_bytes: of text in a shard, about. small_bytes: runs below are of tier 0. fanout: runs of a tier that are
    put together, and how much larger the next tier is."""

    target_bytes: int = 64 << 20
    small_bytes: int = 1 << 20
    fanout: int = 4


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class SchemaConflict(ValueError):
    """An arrival has a column of another type than the store."""


_MANIFEST = "gen string, shard string, n_rows long, n_bytes long"


class ShardStore:
    """One store; it is created by the first append."""

    def __init__(self, spark: SparkSession, root: str, config: ShardConfig = ShardConfig()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def versions(self) -> list[int]:
        """Committed versions, rising."""
        fs, path = self._fs("versions")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit())

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:08d}", wholetext=True).first()[0])

    def schema(self, version: int | None = None) -> StructType:
        """The columns of a version, in the order in which they came; what an arrival lacks is null in its rows."""
        return StructType.fromJson(self._entry(self.versions()[-1] if version is None else version)["schema"])

    def manifest(self, version: int | None = None) -> DataFrame:
        """gen, shard, n_rows, n_bytes of the live shards of a version, by default the last."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{self._entry(version)['manifest']}")

    def _commit(self, manifest: DataFrame, schema: StructType, version: int) -> int:
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        fs, own = self._fs(f"versions/writing-{name}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            files.rename(own, self._fs(f"versions/{version:08d}")[1], no_options)
        except Exception as problem:
            fs.delete(own, False)
            if version in self.versions():
                raise CommitConflict(f"version {version} exists") from problem
            raise
        return version

    def _open(self, gens: list[str], schema: StructType) -> DataFrame:
        """gen, shard, row of the shards of some generations."""
        layout = StructType([StructField("row", schema)])
        reader = self.spark.read.schema(StructType.fromDDL("gen string, shard string").add(layout.fields[0])).option("basePath", f"{self.root}/data")
        return reader.parquet(*(f"{self.root}/data/gen={g}" for g in gens)) if gens else self.spark.createDataFrame([], StructType.fromDDL("gen string, shard string").add(layout.fields[0]))

    def _shards(self, gen: str, schema: StructType) -> DataFrame:
        """The manifest rows of what was just written, from the files themselves."""
        size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
        return self._open([gen], schema).groupBy("gen", "shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))

    def append(self, docs: DataFrame) -> int:
        """Add docs (with a column text, and any others) as small shards, one for each task; returns the new version.

        Repeated rows, null and empty texts are rows like any other. A column that is new is added to the store's
        schema; one of another type than before raises a SchemaConflict. An empty table adds a version without new shards."""
        gen, before = f"a{uuid.uuid4().hex[:12]}", self.versions()
        schema = self.schema(before[-1]) if before else StructType()
        for field in docs.schema.fields:
            if field.name not in schema.names:
                schema = StructType([*schema.fields, StructField(field.name, field.dataType)])
            elif schema[field.name].dataType != field.dataType:
                raise SchemaConflict(f"{field.name}: {field.dataType.simpleString()}, before {schema[field.name].dataType.simpleString()}")
        shard = F.concat(F.lit("s"), F.spark_partition_id().cast("string"))
        rows = docs.select(shard.alias("shard"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.root}/data/gen={gen}")
        live = self._shards(gen, schema)
        if before:
            live = self.manifest(before[-1]).unionByName(live)
        return self._commit(live, schema, (before[-1] if before else 0) + 1)

    def _plan(self, manifest: DataFrame) -> DataFrame:
        """gen, shard, run: which shards become one. Only sizes are looked at, as often as there are tiers."""
        config = self.config
        runs = staged(manifest.select("gen", "shard", "n_bytes", F.concat_ws("-", "gen", "shard").alias("run")))
        while True:
            sizes = runs.groupBy("run").agg(F.sum("n_bytes").alias("size")).where(F.col("size") * 4 < config.target_bytes * 3)
            tier = F.greatest(F.floor(F.log(float(config.fanout), F.greatest("size", F.lit(1)) / config.small_bytes)), F.lit(-1)) + 1
            sizes = sizes.withColumn("tier", tier)
            order = Window.partitionBy("tier").orderBy("size", "run")
            placed = sizes.withColumn("n", F.count("*").over(Window.partitionBy("tier"))).where(F.col("n") >= config.fanout)
            placed = placed.withColumn("slot", F.floor((F.sum("size").over(order) - F.col("size")) / config.target_bytes))
            merged = placed.select("run", F.min("run").over(Window.partitionBy("tier", "slot")).alias("into"))
            moved = staged(runs.join(merged, "run", "left").select("gen", "shard", "n_bytes", F.coalesce("into", "run").alias("into"), "run"))
            done = moved.where("into <> run").isEmpty()
            runs = moved.select("gen", "shard", "n_bytes", F.col("into").alias("run"))
            if done:
                return runs

    def compact(self) -> int:
        """Merge similarly sized shards and commit; returns the version, the last one where nothing is to do."""
        before = self.versions()[-1]
        manifest, schema = self.manifest(before), self.schema(before)
        with scratch(self.spark):
            runs = self._plan(manifest)
            many = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
            moves = staged(runs.join(many, "run", "left_semi").select("gen", "shard", F.concat(F.lit("m"), F.substring(F.sha2("run", 256), 1, 24)).alias("into")))
            if moves.isEmpty():
                return before
            gen = f"c{uuid.uuid4().hex[:12]}"
            rows = self._open(self._gens(moves), schema).join(moves, ["gen", "shard"]).select("row", F.col("into").alias("shard"))
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), moves.select("into").distinct().count())
            rows.repartition(parts, "shard").write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.root}/data/gen={gen}")
            live = manifest.join(moves.select("gen", "shard"), ["gen", "shard"], "left_anti").select("gen", "shard", "n_rows", "n_bytes").unionByName(self._shards(gen, schema))
            return self._commit(live, schema, before + 1)

    @staticmethod
    def _gens(shards: DataFrame) -> list[str]:
        """Generations, of which there is one for each append and compaction that still has live shards."""
        return sorted(r[0] for r in shards.select("gen").distinct().collect())

    def located(self, version: int | None = None) -> DataFrame:
        """row (a struct of the documents' columns), gen, shard, n_rows, n_bytes of every document of a version."""
        manifest = self.manifest(version)
        return self._open(self._gens(manifest), self.schema(version)).join(manifest, ["gen", "shard"])

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version."""
        return self.located(version).select(*(F.col("row")[c].alias(c) for c in self.schema(version).names))

    def expire(self, keep: int = 1) -> None:
        """Forget all but the last `keep` versions and delete the generations that none of those has. Only for times without
        writers, as it deletes what a writer has not committed yet; readers of older versions fail."""
        kept = self.versions()[-keep:]
        live = {g for v in kept for g in self._gens(self.manifest(v))}
        names = {self._entry(v)["manifest"] for v in kept}
        for folder, stays in (("versions", lambda x: x in {f"{v:08d}" for v in kept}), ("manifests", lambda x: x in names), ("data", lambda x: x.removeprefix("gen=") in live)):
            fs, path = self._fs(folder)
            for x in fs.listStatus(path) if fs.exists(path) else ():
                if not stays(x.getPath().getName()):
                    fs.delete(x.getPath(), True)
