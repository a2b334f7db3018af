"""Java sources as DataFrames: one parse of each file, then typed views."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.javarows import COLUMNS, java_rows


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of every ``*.java`` file below a folder; Spark skips files without a byte."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.java", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_all(sources: DataFrame, compat: bool = False) -> DataFrame:
    """The rows of all graphs of all files: the one Python boundary of an analysis.

    A null text is an empty file; a file that can't be parsed gives one row of
    rel ``error``.  Graph keys that occur in several files or twice are kept
    apart by ``file``.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, text in zip(pdf["path"], pdf["text"]):
                yield pd.DataFrame(list(java_rows(path or "", text or "", compat)), columns=names).astype(object).where(lambda x: x.notna(), None)

    return sources.select("path", "text").mapInPandas(run, COLUMNS)


class CodeGraph:
    """Typed views of the parsed rows, written once and read back.

    The rows go to ``spark.checkpoint.dir`` (or to ``to``); each view is a scan
    with a pushed-down filter on ``rel`` and the columns it needs.
    """

    def __init__(self, sources: DataFrame, compat: bool = False, to: str | None = None):
        spark = sources.sparkSession
        rows = parse_all(sources, compat)
        base = to or spark.conf.get("spark.checkpoint.dir", None)
        if base:
            path = f"{base.rstrip('/')}/code-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            self.rows = spark.read.schema(rows.schema).parquet(path)
        else:
            self.rows = rows.persist()

    def _view(self, rel: str, *columns: str) -> DataFrame:
        return self.rows.where(F.col("rel") == rel).select(*columns)

    @property
    def ast(self) -> DataFrame:
        return self._view("ast", "file", "id", "parent", "last_id", "depth", "kind", "line", "code", "shared_id", "name", "args", "text")

    @property
    def ast_edges(self) -> DataFrame:
        return self.ast.where("parent IS NOT NULL").select("file", F.col("parent").alias("src"), F.col("id").alias("dst"))

    @property
    def cfg(self) -> DataFrame:
        return self._view("cfg", "file", "graph", "id", "kind", "line", "code", "shared_id")

    @property
    def cfg_edges(self) -> DataFrame:
        return self._view("cfg_edge", "file", "graph", "src", "dst", "label")

    @property
    def dfg(self) -> DataFrame:
        """Nodes with facts; cfg_id is the control-flow node."""
        nodes = self.rows.where("rel = 'cfg' AND depth IS NOT NULL")
        return nodes.select("file", "graph", F.col("depth").alias("id"), F.col("id").alias("cfg_id"), "line", F.col("text").alias("code"), "shared_id", "defs", "uses")

    @property
    def calls(self) -> DataFrame:
        return self._view("calls", "file", "graph", F.col("src").alias("id"), "name", F.col("code").alias("receiver"), "type", "owner", F.col("depth").alias("n_args"))

    @property
    def flows(self) -> DataFrame:
        """Edges between the data-flow nodes of one method: definitions that reach uses, and self flows."""
        return self._view("flow", "file", "graph", "src", "dst", "label", F.col("type").alias("kind"))

    @property
    def classes(self) -> DataFrame:
        return self._view(
            "class", "file", F.col("owner").alias("qn"), "name", F.col("type").alias("extends"), F.col("args").alias("implementations"),
            F.col("values").alias("modifiers"), F.col("uses").alias("annotations"), F.col("text").alias("type_parameters"), "line", "code",
        )

    @property
    def methods(self) -> DataFrame:
        return self._view("method", "file", F.col("owner").alias("qn"), "graph", "id", "name", F.col("type").alias("ret_type"), "args", F.col("values").alias("modifiers"), F.col("uses").alias("annotations"), "line", "shared_id")

    @property
    def fields(self) -> DataFrame:
        return self._view("field", F.col("owner").alias("qn"), "name", "type", F.col("values").alias("modifiers"), "line")

    @property
    def parameters(self) -> DataFrame:
        return self._view("parameter", F.col("owner").alias("qn"), "graph", "id", "name", "type", F.col("uses").alias("annotations"))

    @property
    def annotations(self) -> DataFrame:
        return self._view("annotation", F.col("owner").alias("qn"), "graph", "id", "name", "values")

    @property
    def errors(self) -> DataFrame:
        return self._view("error", "file", F.col("text").alias("message"))
