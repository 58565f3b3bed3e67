"""Keyed tables that change by commits: parts in buckets of the key, and a manifest that names the parts that count.

A commit writes its rows as a new part, in ``buckets`` folders whatever the number of keys, and then one small file, the next
manifest. A reader takes the newest manifest, so it sees a commit whole or not at all, and a writer that fails leaves the old
one. What several parts hold of a key is settled by ``resolve``, on reading and when parts are merged: a part is merged with
those before it as soon as they are not ``GROWTH`` times as large, so there are few parts, a row is written again a number of
times that grows with the logarithm of the table, and a commit costs what its own rows cost. One writer at a time is assumed;
a micro-batch that comes again under the same number is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

BUCKETS, GROWTH = 16, 4
COMMIT = "_commit"
Resolve = Callable[[DataFrame], DataFrame]


def all_rows(rows: DataFrame) -> DataFrame:
    return rows


def newest_commit(key: str) -> Resolve:
    """The rows that the latest commit has of a key take the place of all earlier ones."""

    def resolve(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(key).agg(F.max(COMMIT).alias("_newest")).withColumnRenamed(key, "_key")
        return rows.join(newest, rows[key].eqNullSafe(F.col("_key")) & (F.col(COMMIT) == F.col("_newest"))).drop("_key", "_newest")

    resolve.settled = True  # within a commit there is nothing to settle
    return resolve


def newest_fields(key: str, stamps: dict[str, str]) -> Resolve:
    """One row a key; each column of ``stamps`` has the value with the largest stamp among those that are not null."""

    def resolve(rows: DataFrame) -> DataFrame:
        picked = [c for f, at in stamps.items() for c in (F.max_by(f, at).alias(f), F.max(at).alias(at))]
        return rows.groupBy(key).agg(*picked, F.max(COMMIT).alias(COMMIT))

    return resolve


def newest_rows(key: str, order: list[Column], most: int = 1) -> Resolve:
    """The first ``most`` rows of each key. Tasks rank their own rows first, so that a key of many rows isn't gathered."""

    def resolve(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")

    return resolve


class _Folder:
    """A folder in whatever file system its address names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or nothing; an error if there is one already."""
        draft, at = self._at(f"_draft-{uuid.uuid4().hex}"), self._at(name)
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(at.getParent())
        if self.fs.exists(at) or not self.fs.rename(draft, at):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{name}: another writer was first")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class VersionedTable:
    """``schema`` (DDL or type) of the rows, and the column ``key`` by which they are dealt into buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, resolve: Resolve = all_rows, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.resolve, self.buckets = spark, path.rstrip("/"), key, resolve, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        self.folder = _Folder(spark, self.path)

    def manifest(self, version: int | None = None) -> dict:
        names = [n for n in self.folder.names("_manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "parts": [], "batches": {}}
        return json.loads(self.folder.text(f"_manifests/{names[-1] if version is None else self._name(version)}"))

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:010d}.json"

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _rows(self, parts: list[dict]) -> DataFrame:
        """Rows of these parts, settled, with the commit they are from."""
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumns({"_bucket": F.lit(0), COMMIT: F.lit(0).cast("long")})
        each = [self.spark.read.schema(self.stored).parquet(f"{self.path}/{p['folder']}").withColumn(COMMIT, F.lit(p["commit"]).cast("long")) for p in parts]
        rows = reduce(DataFrame.unionByName, each)
        return rows if self._settled(parts) else self.resolve(rows.drop("_bucket")).withColumn("_bucket", self._bucket(F.col(self.key)))

    def read(self, keys: list | None = None, version: int | None = None) -> DataFrame:
        """The table now, or as of a version that is still kept; of ``keys`` only, from their buckets, if they are given."""
        names = self.schema.fieldNames()
        if keys is None:
            return self._rows(self.manifest(version)["parts"]).select(names)
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        within = [r[0] for r in wanted.select(self._bucket(F.col(self.key))).distinct().collect()]
        parts = self.manifest(version)["parts"]
        pruned = VersionedTable(self.spark, self.path, self.schema, self.key, all_rows, self.buckets)._rows(parts).where(F.col("_bucket").isin(within) & F.col(self.key).isin(keys))
        return (pruned if self._settled(parts) else self.resolve(pruned.drop("_bucket"))).select(names)

    def _settled(self, parts: list[dict]) -> bool:
        return self.resolve is all_rows or len(parts) == 1 and getattr(self.resolve, "settled", False)

    def _write(self, rows: DataFrame, dealt: bool = False) -> tuple[str, int]:
        folder = f"data/{uuid.uuid4().hex}"
        # Rows of a bucket go to few tasks, but a bucket of very many rows is split.
        seen, rows = Observation(), rows.withColumn("_bucket", self._bucket(F.col(self.key)))
        dealt = (rows if dealt else rows.hint("rebalance", "_bucket")).observe(seen, F.count(F.lit(1)).alias("n"))
        dealt.sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder, seen.get["n"]

    def commit(self, rows: DataFrame, batch: tuple[str, int] | None = None, dealt: bool = False) -> int:
        """Adds rows as the next version, which it returns. ``batch``: stream and number of a micro-batch, taken once.

        ``dealt``: the rows of a key lie in one task already. They are written there and not moved, for a file a task and bucket.
        """
        old = self.manifest()
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old["version"]
        version = old["version"] + 1
        self._clean(version)
        folder, n = self._write(rows.select(self.schema.fieldNames()), dealt)
        parts = [*old["parts"], *([{"folder": folder, "commit": version, "rows": n}] if n else [])]
        merged = self._merged(parts) if n else parts
        batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
        self.folder.put(f"_manifests/{self._name(version)}", json.dumps({"version": version, "parts": merged, "batches": batches}))
        if not n or merged is not parts and parts[-1] not in merged:
            self.folder.delete(folder)
        return version

    def _merged(self, parts: list[dict]) -> list[dict]:
        at, size = len(parts) - 1, parts[-1]["rows"]
        while at and parts[at - 1]["rows"] <= GROWTH * size:
            at -= 1
            size += parts[at]["rows"]
        if at == len(parts) - 1:
            return parts
        folder, n = self._write(self._rows(parts[at:]).select(self.schema.fieldNames()))
        return [*parts[:at], {"folder": folder, "commit": parts[-1]["commit"], "rows": n}]

    def _clean(self, version: int) -> None:
        """Deletes what no manifest but the last names: older manifests, their parts, and parts of writers that failed."""
        kept = {p["folder"].removeprefix("data/") for p in self.manifest()["parts"]}
        for name in self.folder.names("data"):
            if name not in kept:
                self.folder.delete(f"data/{name}")
        for name in self.folder.names("_manifests"):
            if name < self._name(version - 1):
                self.folder.delete(f"_manifests/{name}")
