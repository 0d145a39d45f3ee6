"""A store of records: Parquet folders, imports that are all or nothing, and idempotent upserts.

`<root>/_schema_version` says what is in it; `<root>/<kind>/import=I` holds what import I added; an import counts once
`<root>/_imports/I` exists. Rows are only ever added.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import FIELDS, names, schema_of
from .validation import cyclic, dangling

SCHEMA_VERSION = 1


class StoreError(RuntimeError):
    """The store can't be opened, or an import contradicts it."""


@dataclass(frozen=True)
class ImportResult:
    added: dict[str, int]
    unchanged: int

    @property
    def total_added(self) -> int:
        return sum(self.added.values())


class Store:
    """Opens or creates a store; one of a newer or foreign schema is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs, path = self._fs("_schema_version")
        if fs.exists(path):
            text = self._text("_schema_version")
            if not text.isdigit() or int(text) > SCHEMA_VERSION:
                raise StoreError(f"{self.root} has a schema that this version does not know")
        else:
            top = self._fs("")
            if top[0].exists(top[1]) and len(top[0].listStatus(top[1])):
                raise StoreError(f"{self.root} is no store")
            self._create("_schema_version", str(SCHEMA_VERSION))

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _create(self, name: str, text: str) -> None:
        fs, path = self._fs(name)
        out = fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, name: str) -> str:
        """A small file. Spark's readers pass over names that begin with an underscore."""
        fs, path = self._fs(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _imports(self) -> list[str]:
        fs, path = self._fs("_imports")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def table(self, kind: str, **equal) -> DataFrame:
        """Committed records of a kind with seq; equality filters are pushed to the scan."""
        fs = self._fs(kind)
        done = [i for i in self._imports() if fs[0].exists(self._fs(f"{kind}/import={i}")[1])]
        schema = f"{schema_of(kind)}, seq bigint"
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{kind}/import={i}" for i in done)) if done else self.spark.createDataFrame([], schema)
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        return rows

    def get(self, kind: str, record_id: str):
        """One record or None."""
        return self.table(kind, id=record_id).drop("seq").first()

    def counts(self) -> DataFrame:
        """kind, n of every kind."""
        out = None
        for kind in FIELDS:
            rows = self.table(kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
            out = rows if out is None else out.unionByName(rows)
        return out

    @staticmethod
    def is_store(spark: SparkSession, root: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_schema_version")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def ordered(self, kind: str) -> DataFrame:
        """All records of a kind, ordered by all of their columns."""
        return self.table(kind).select(*names(kind)).orderBy(*names(kind))

    def save_truth(self, truth: dict) -> None:
        """What a simulation knows, e.g. {"strengths": {item: x}, "archetypes": {annotator: name}}. The same again changes
        nothing; another one is refused."""
        there = self.truth()
        if there is None:
            self._create("_truth", json.dumps(truth, sort_keys=True))
        elif there != json.loads(json.dumps(truth)):
            raise StoreError("the store has another truth")

    def truth(self) -> dict | None:
        fs, path = self._fs("_truth")
        if not fs.exists(path):
            return None
        return json.loads(self._text("_truth"))

    def _check(self, key: str, fresh: dict[str, DataFrame]) -> None:
        """Refuses fresh records that refer to nothing, and controls that repeat each other in a circle."""
        known = {kind: self.table(kind).select(*names(kind)) for kind in FIELDS}
        known = {kind: rows.unionByName(fresh[kind].select(*names(kind))) if kind in fresh else rows for kind, rows in known.items()}
        lost = dangling(fresh, known)
        first = lost.orderBy("kind", "id", "rule").first() if lost is not None else None
        if first:
            raise StoreError(f"{first['kind']} {first['id']}: {first['rule']}")
        if "pairwise" in fresh:
            top = f"{self.root}/_checks-{key}"

            def keep(rows: DataFrame, turn: int) -> DataFrame:
                rows.write.parquet(f"{top}/{turn}")
                return self.spark.read.parquet(f"{top}/{turn}")

            try:
                first = cyclic(fresh["pairwise"].where("repeat_of is not null"), keep).orderBy("id").first()
            finally:
                fs, path = self._fs(f"_checks-{key}")
                fs.delete(path, True)
            if first:
                raise StoreError(f"pairwise {first['id']}: repeats itself by way of others")

    def add(self, tables: dict[str, DataFrame]) -> ImportResult:
        """Import records. The same record again changes nothing; another one under a known id, or one that refers to records
        that are neither there nor in the import, aborts all."""
        key = uuid.uuid4().hex
        added, unchanged, fresh = {}, 0, {}
        for kind, rows in tables.items():
            content = F.sha2(F.to_json(F.struct(*names(kind))), 256)
            own = rows.select(*names(kind), "seq", content.alias("content"))
            once = own.groupBy("id").agg(F.min_by(F.struct(*names(kind), "seq"), "seq").alias("r"), F.count("*").alias("n"), F.count_distinct("content").alias("kinds"), F.min("content").alias("content"))
            known = self.table(kind).select("id", content.alias("known"))
            state = once.join(known, "id", "left")
            clash = state.where("kinds > 1 or known <> content").select("id").first()
            if clash:
                raise StoreError(f"{kind} {clash['id']} exists with other content")
            totals = state.agg(F.count_if(F.col("known").isNull()).alias("new"), F.sum("n").alias("all")).first()
            added[kind] = totals["new"]
            unchanged += (totals["all"] or 0) - totals["new"]
            if totals["new"]:
                fresh[kind] = state.where("known is null").select("r.*")
        base = max((r["m"] or 0 for k in FIELDS for r in [self.table(k).agg(F.max("seq").alias("m")).first()]), default=0) if self._imports() else 0
        for kind, rows in fresh.items():
            path = f"{self.root}/{kind}/import={key}"
            rows.withColumn("seq", F.col("seq") + base).write.parquet(path)
            fresh[kind] = self.spark.read.schema(f"{schema_of(kind)}, seq bigint").parquet(path)
        try:
            self._check(key, fresh)
        except StoreError:
            for kind in fresh:
                fs, path = self._fs(f"{kind}/import={key}")
                fs.delete(path, True)
            raise
        if fresh:
            self._create(f"_imports/{key}", "done")
        return ImportResult(added, unchanged)

    def dump(self) -> DataFrame:
        """Canonical lines of everything."""
        from .records import dump_lines

        return dump_lines({kind: self.table(kind) for kind in FIELDS})
