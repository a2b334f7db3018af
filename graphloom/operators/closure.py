"""Reachability, simple paths and reaching definitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.flow import reaching, strong_parts

#: Edges up to which one task finds the strongly connected parts, and ids that a row of the packed closure holds on either side.
FEW_EDGES, BLOCK = 500_000, 4096


def _path(df: DataFrame) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; on one machine a temporary one where that is unset."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", df.sparkSession.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return f"{base.rstrip('/')}/closure-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """Written and read again, so a loop's lineage stays short and survives lost executors."""
    path = _path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _one_task(edges: DataFrame) -> DataFrame:
    """``(id, part)``: the strongly connected parts of ``(src, dst)`` (longs), by depth-first search in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            src, dst = (np.concatenate(x) for x in zip(*held))
            ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
            parts = strong_parts(len(ids), place[: len(src)], place[len(src) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[parts])], names=["id", "part"])

    return edges.coalesce(1).mapInArrow(solve, "id long, part long")


def _by_colours(edges: DataFrame) -> DataFrame:
    """The rows of ``_one_task`` for parts of several nodes or a loop, in rounds over the whole table.

    Nodes that no cycle can pass are trimmed.  Then every node takes the largest
    id that reaches it as its colour, and what reaches the node named by its
    colour, within the colour, is one part.
    """
    done = edges.select(F.col("src").alias("id"), F.col("src").alias("part")).limit(0)
    left, rows = edges, None
    while True:
        while True:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            left = _cut(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            before, rows = rows, left.count()
            if rows in (0, before):
                break
        if not rows:
            return done
        colours, state = left.select(F.col("src").alias("id"), F.col("src").alias("part")).distinct(), None
        while True:
            told = left.join(colours, left["src"] == colours["id"]).select(F.col("dst").alias("id"), "part")
            colours = _cut(colours.union(told).groupBy("id").agg(F.max("part").alias("part")))
            before, state = state, colours.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]  # colours only grow
            if state == before:
                break
        within = left.join(colours.withColumnRenamed("id", "src"), "src").join(colours.select(F.col("id").alias("dst"), F.col("part").alias("other")), "dst").where("part = other")
        back = _cut(within.select(F.col("src").alias("to"), F.col("dst").alias("id")))
        found = frontier = _cut(colours.where("id = part"))
        while not frontier.isEmpty():
            met = frontier.join(back, "id").select(F.col("to").alias("id"), "part").distinct()
            frontier = _cut(met.join(found, "id", "left_anti"))
            found = found.union(frontier)
        done = done.union(found)
        gone = found.select("id")
        left = _cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))


def _blocks(df: DataFrame, value: str) -> DataFrame:
    """``(part, values)``: the values of each part in arrays of about BLOCK."""
    sized = df.join(df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("n")), "part")
    block = F.pmod(F.xxhash64(value), F.col("n"))
    nulls = F.array_repeat(F.lit(None).cast(df.schema[value].dataType), (F.count("*") - F.count(value)).cast("int"))  # lists leave them out
    return sized.groupBy("part", block.alias("block")).agg(F.concat(F.collect_list(value), nulls).alias(f"{value}s")).drop("block")


def _loop(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node)``: each round joins the frontier with the edges and keeps what was not seen before, so cycles end too."""
    seen = frontier = _cut(sources.select(F.col("id").alias("source")).distinct().join(edges, F.col("source") == F.col("src")).select("source", F.col("dst").alias("node")).distinct())
    while not frontier.isEmpty():
        met = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node")).distinct()
        frontier = _cut(met.join(seen, ["source", "node"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def _reached(edges: DataFrame, sources: DataFrame, sinks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(source, node)`` of ``reach``, of nodes in ``sinks`` only where these are given, and ``(id)``: the nodes on a cycle."""
    edges = edges.select("src", "dst").where(F.col("src").isNotNull()).distinct()
    ids = _cut(edges.select("src").union(edges.select("dst")).distinct().select(F.col("src").alias("node"), F.monotonically_increasing_id().alias("id")))
    end = lambda c: ids.select(F.col("node").alias(f"{c}_node"), F.col("id").alias(c))
    named = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    named = _cut(named.join(end("src"), F.col("a").eqNullSafe(F.col("src_node"))).join(end("dst"), F.col("b").eqNullSafe(F.col("dst_node"))).select("src", "dst"))
    parts = _cut(_one_task(named) if named.count() <= FEW_EDGES else _by_colours(named))
    if parts.where("id != part").isEmpty():
        pairs = _loop(edges, sources)
        wanted = pairs if sinks is None else pairs.join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("source", "node")
        return wanted, edges.where("src = dst").select(F.col("src").alias("id"))
    nodes = _cut(ids.join(parts, "id", "left").select("node", "id", F.coalesce("part", "id").alias("part")))
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
    steps = _cut(named.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct())
    starts = _cut(nodes.join(sources.select(F.col("id").alias("node")).distinct(), "node").select("part", F.col("node").alias("source")))
    ends = nodes if sinks is None else nodes.join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    seen = _loop(steps, starts.select(F.col("part").alias("id")))
    tiles = seen.withColumnRenamed("source", "part").join(_blocks(starts, "source"), "part").select("sources", F.col("node").alias("part")).join(_blocks(ends, "node"), "part")
    # few wide rows are dealt out; pairs are made where they are read and never stored
    dealt = _cut(tiles.select("sources", "nodes")).repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # generated code holds all that one row is spread into; a lambda is interpreted, so the sources come one at a time
    each = dealt.select(F.explode(F.transform("sources", lambda x: x)).alias("source"), "nodes")
    pairs = each.select("source", F.explode("nodes").alias("node"))
    return pairs, nodes.join(steps.where("src = dst").select(F.col("src").alias("part")), "part", "left_semi").select(F.col("node").alias("id"))


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node)`` for every node at least one hop from a source.

    Nodes that reach each other are one part, and all of them reach the same
    nodes: the closure is taken over the graph of the parts, by a frontier loop,
    and each pair of parts is spread into pairs of nodes only as the result is
    read.  So a graph of cycles takes disk by its nodes, not by its pairs; one
    without cycles still writes a row for each pair.
    """
    return _reached(edges, sources)[0]


def reachable_pairs(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``(source, sink)`` pairs joined by a path, or equal; like those of ``reach`` they are made as they are read."""
    hops, cyclic = _reached(edges, sources, sinks)
    # a node on a cycle reaches itself, so no pair comes twice and none needs comparing
    same = sources.select("id").distinct().join(sinks.select("id").distinct(), "id").join(cyclic, "id", "left_anti")
    return hops.select("source", F.col("node").alias("sink")).union(same.select("id", "id"))


def pruned(edges: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """``(source, node, hops)``: breadth-first visits from each start, itself at 0 hops, not going on from ``stops``.

    starts and stops: (id).  Every node is visited once for each start, at its least number of hops.
    """
    edges = edges.select("src", "dst").distinct().join(stops.select(F.col("id").alias("src")), "src", "left_anti")
    seen = frontier = _cut(starts.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct())
    while not frontier.isEmpty():
        met = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = _cut(met.join(seen, ["source", "node"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def simple_paths(edges: DataFrame, start: int | DataFrame, most: int | None = None) -> DataFrame:
    """``(path)``: all simple paths of two vertices or more from ``start`` (an id, or rows (id)), as arrays; ``most`` bounds the vertices.

    Without a bound the loop ends when no path can be extended; rounds are written
    out like those of ``reach``.
    """
    edges = edges.select("src", "dst").distinct()
    first = edges.join(start.select(F.col("id").alias("src")).distinct(), "src", "left_semi") if isinstance(start, DataFrame) else edges.where(F.col("src") == start)
    step = first.where("src != dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    step = _cut(step) if most is None else step
    found, length = step, 2
    while not step.isEmpty() if most is None else length < most:
        met = step.join(edges, step["end"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        step = met.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        step = _cut(step) if most is None else step
        found, length = found.union(step), length + 1
    return found.select("path")


def subgraph(edges: DataFrame, source: int, target: int) -> DataFrame:
    """Edges on walks from ``source`` that do not go on past ``target``."""
    spark = edges.sparkSession
    inner = edges.where(F.col("src") != target)
    nodes = reach(inner, spark.createDataFrame([(source,)], "id long")).select(F.col("node").alias("id")).union(spark.createDataFrame([(source,)], "id long")).distinct()
    return inner.join(nodes, inner["src"] == nodes["id"], "left_semi")


def reaching_definitions(cfg: DataFrame, facts: DataFrame, entered: DataFrame | None = None) -> DataFrame:
    """``(graph, src, dst, var)``: definitions that reach a use.

    cfg: (graph, src, dst); facts: (graph, id, defs array, uses array); the entry
    is id 1.  A definition stops at a redefinition, whose own use it still
    reaches; nodes without facts are passed through; a node is not its own
    target.  A frontier loop over (graph, definition, variable, node).  Only
    definitions that the entry reaches count; ``entered`` (graph, id) names them
    where they are known already.
    """
    cfg = cfg.select("graph", "src", "dst").distinct()
    facts = facts.select("graph", "id", "defs", "uses")
    if entered is None:
        entered = reach(
            cfg.select(F.struct("graph", F.col("src").alias("id")).alias("src"), F.struct("graph", F.col("dst").alias("id")).alias("dst")),
            facts.where("id = 1").select(F.struct("graph", "id").alias("id")),
        ).select("node.graph", "node.id").distinct().union(facts.where("id = 1").select("graph", "id"))
    starts = facts.join(entered.distinct(), ["graph", "id"], "left_semi").select("graph", F.col("id").alias("def"), F.explode("defs").alias("var"))
    move = lambda f: f.join(cfg, (f["graph"] == cfg["graph"]) & (f["at"] == cfg["src"])).select(f["graph"], "def", "var", F.col("dst").alias("at")).distinct()
    seen = frontier = _cut(move(starts.withColumn("at", F.col("def"))).where("at != def"))
    while not frontier.isEmpty():
        at = frontier.join(facts.select("graph", F.col("id").alias("at"), "defs"), ["graph", "at"], "left")
        goes_on = at.where(F.col("defs").isNull() | ~F.array_contains("defs", F.col("var"))).select("graph", "def", "var", "at")
        frontier = _cut(move(goes_on).where("at != def").join(seen, ["graph", "def", "var", "at"], "left_anti"))
        seen = seen.union(frontier)
    used = seen.join(facts.select("graph", F.col("id").alias("at"), "uses"), ["graph", "at"]).where(F.array_contains("uses", F.col("var")))
    return used.select("graph", F.col("def").alias("src"), F.col("at").alias("dst"), "var")


def reaching_definitions_by_graph(cfg: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of ``reaching_definitions`` where each graph, as a method or a session, fits in a task: one shuffle, no loop.

    ``graph`` is of a simple type and ids are longs.
    """
    kind = facts.schema["graph"].dataType.simpleString()

    def solve(key: tuple, edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        ids = nodes["id"].tolist()
        found = list(reaching(zip(edges["src"].tolist(), edges["dst"].tolist()), dict(zip(ids, map(set, nodes["defs"]))), dict(zip(ids, map(set, nodes["uses"])))))
        return pd.DataFrame(found, columns=["src", "dst", "var"]).assign(graph=key[0])[["graph", "src", "dst", "var"]]

    return cfg.groupBy("graph").cogroup(facts.groupBy("graph")).applyInPandas(solve, f"graph {kind}, src long, dst long, var string")
