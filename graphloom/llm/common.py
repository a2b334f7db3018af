"""What the operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Bytes of an Arrow batch between JVM and Python: texts differ so much in length that a number of rows bounds no memory.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that names none (tests) gets a temporary one;
    on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Stored:
    """A DataFrame written once as Parquet in the shared folder and read back.

    This cuts lineage and survives the loss of executors.  ``drop()`` removes
    the files when no later plan reads them.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        before = self.spark.conf.get(BATCH_KEY, None)
        self.spark.conf.set(BATCH_KEY, BATCH)
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.unset(BATCH_KEY) if before is None else self.spark.conf.set(BATCH_KEY, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete shuffle files of finished phases now.

    It follows the driver's garbage collection, which may not run for long on a
    large heap, so disk use would otherwise add up over the phases of a job.
    """
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Catalyst may substitute a column's expression where it is read, so one that
    a lambda reads would be evaluated anew for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components: ``(node, root)``, root = smallest node reachable.

    Alternating large-star and small-star steps; each is a map-side combined
    ``min`` and an equi-join, so a hub's neighbours never meet in one task as a
    list (adaptive execution splits the hub's side of the join).  Nodes without
    an edge to another node do not appear.  Null ends are ignored.
    """
    spark = edges.sparkSession
    current = Stored(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u > v").distinct(),
        "cc",
    )
    seen = None
    while True:
        state = current.df.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = current.df.union(current.df.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the large step is used twice below; writing it keeps that to one run
        step = Stored(large.distinct(), "cc")
        best = step.df.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            step.df.join(best, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(best.select("u", "m"))
        )
        after = Stored(small.distinct(), "cc")
        step.drop()
        current.drop()
        current = after
    sweep(spark)
    done = current.df
    return done.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        done.select("v", "v").distinct()
    )
