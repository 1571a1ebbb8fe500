"""A table of rows by key that is merged by copying only what changes.

Rows lie in buckets by a hash of their key. A merge or a delete rewrites the buckets that hold changed keys into a new
folder and publishes a manifest that names the folder of each bucket; the others keep their files. Readers take the
newest manifest, so they see one version whole; a write that fails leaves no manifest and thus no trace for readers. Two
writers that start from one version cannot both publish the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64


class KeyedStore:
    """path/data/<folder>/bucket=N/ and path/manifest/version=N/; keys are unique, and null keys are one key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The newest version, and the folder of each bucket that has rows."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return 0, {}
        rows = self.spark.read.schema("bucket int, folder string, version long").parquet(f"{self.path}/manifest")
        newest = rows.agg(F.max("version")).first()[0]
        # at most one row a bucket; a version without rows has one with a null
        return newest, {r["bucket"]: r["folder"] for r in rows.filter(F.col("version") == newest).collect() if r["bucket"] is not None}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        stored = StructType([*self.schema, StructField("bucket", IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/folder={f}/bucket={b}" for b, f in sorted(folders.items())]).select(*stored.fieldNames())

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self._read(self.manifest()[1]).drop("bucket")

    def _publish(self, version: int, before: dict[int, str], touched: set[int], rows: DataFrame) -> None:
        folder = uuid.uuid4().hex
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/folder={folder}")
        held = {r["bucket"] for r in self._written(folder).select("bucket").distinct().collect()}  # at most one a bucket
        now = {b: f for b, f in before.items() if b not in touched} | dict.fromkeys(held, folder)
        told = self.spark.createDataFrame([(b, f) for b, f in sorted(now.items())] or [(None, None)], "bucket int, folder string")
        told.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version + 1}")

    def _written(self, folder: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("bucket", IntegerType())])).parquet(f"{self.path}/data/folder={folder}")

    def merge(self, rows: DataFrame) -> None:
        """Put rows in place of those with the same keys, and add the others. Rows that repeat a key: the last in the order of all columns."""
        fresh = self._bucketed(rows)
        names = self.schema.fieldNames()
        rest = [n for n in names if n not in self.keys]
        if rest:
            fresh = fresh.groupBy("bucket", *self.keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*[F.col(f"_row.{n}").alias(n) if n in rest else F.col(n) for n in names], "bucket")
        else:
            fresh = fresh.distinct()
        version, folders = self.manifest()
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # at most one a bucket
        if not touched:
            return
        old = self._read({b: f for b, f in folders.items() if b in touched})
        new = fresh.select("bucket", *[F.col(k).alias(f"_{k}") for k in self.keys])
        same = (old["bucket"] == new["bucket"])
        for k in self.keys:
            same = same & old[k].eqNullSafe(new[f"_{k}"])
        kept = old.join(new, same, "left_anti")
        self._publish(version, folders, touched, kept.unionByName(fresh))

    def delete(self, condition: Column) -> None:
        """Drop the rows for which a condition is true. Only buckets that have one are rewritten."""
        version, folders = self.manifest()
        rows = self._read(folders)
        hit = F.coalesce(condition, F.lit(False))
        touched = {r["bucket"] for r in rows.filter(hit).select("bucket").distinct().collect()}
        if touched:
            self._publish(version, folders, touched, self._read({b: f for b, f in folders.items() if b in touched}).filter(~hit))
