"""Collections on disk: one Parquet folder each, with upserts, appends and JSON output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import algebra


class Store:
    """Named collections below a folder.

    A write goes to a new version folder and then one marker row names it, so a
    reader sees the old or the new version, never half of one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> str:
        return f"{self.folder}/_versions/{name}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def get(self, name: str) -> DataFrame | None:
        """The collection, or None if it was never put or is cleared."""
        if not self._exists(self._versions(name)):
            return None
        last = self.spark.read.schema("n long, path string").parquet(self._versions(name)).orderBy(F.desc("n")).first()
        return self.spark.read.parquet(last.path) if last and last.path else None

    def _point(self, name: str, path: str | None) -> None:
        n = self.spark.read.schema("n long, path string").parquet(self._versions(name)).count() if self._exists(self._versions(name)) else 0
        self.spark.createDataFrame([(n + 1, path)], "n long, path string").coalesce(1).write.mode("append").parquet(self._versions(name))

    def put(self, name: str, df: DataFrame) -> None:
        """Replace the collection."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._point(name, path)

    def append(self, name: str, df: DataFrame) -> None:
        old = self.get(name)
        self.put(name, df if old is None else old.unionByName(df))

    def upsert(self, name: str, df: DataFrame, key: list[str]) -> None:
        """Rows of ``df`` take the place of those with the same key."""
        old = self.get(name)
        if old is not None:
            both = old.withColumn("__seq", F.lit(0)).unionByName(df.withColumn("__seq", F.lit(1)))
            df = algebra.keep_first(both, key, [F.desc("__seq")]).drop("__seq")
        self.put(name, df)

    def clear(self, name: str) -> None:
        self._point(name, None)

    def dump(self, name: str, to: str) -> None:
        """The collection as JSON lines."""
        df = self.get(name)
        if df is not None:
            df.write.mode("overwrite").json(to)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def typed_rows(df: DataFrame, schema: str | T.StructType, column: str = "json") -> DataFrame:
    """The rows that JSON documents hold, by an explicit schema; fields that a document lacks are null."""
    return df.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def flat_rows(df: DataFrame, properties: list[str]) -> DataFrame:
    """Rows whose property columns become one JSON text ``properties`` without null members."""
    rest = [c for c in df.columns if c not in properties]
    return df.select(*rest, F.to_json(F.struct(*properties)).alias("properties"))


def load_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A dumped collection with the types it had."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")
