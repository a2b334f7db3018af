"""Graph algebra on vertex and edge DataFrames.

Vertices are rows with a key column; edges are rows (src, dst).  All steps are
joins and filters that Catalyst plans; none collects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has(nodes: DataFrame, **equal) -> DataFrame:
    """Vertices whose columns equal the given values."""
    for name, value in equal.items():
        nodes = nodes.where(F.col(name) == value)
    return nodes


def where_exists(nodes: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Vertices for which ``other`` has a match (EXISTS)."""
    return nodes.join(other, on, "left_semi")


def out(nodes: DataFrame, edges: DataFrame, all_nodes: DataFrame, key: str = "id") -> DataFrame:
    """Children, one row for each edge (bag semantics)."""
    return _step(nodes, edges, all_nodes, key, "src", "dst")


def in_(nodes: DataFrame, edges: DataFrame, all_nodes: DataFrame, key: str = "id") -> DataFrame:
    """Parents, one row for each edge."""
    return _step(nodes, edges, all_nodes, key, "dst", "src")


def _step(nodes: DataFrame, edges: DataFrame, all_nodes: DataFrame, key: str, start: str, end: str) -> DataFrame:
    met = nodes.select(F.col(key).alias(start)).join(edges, start).select(F.col(end).alias(key))
    return met.join(all_nodes, key)


def descendants(nodes: DataFrame, all_nodes: DataFrame, group: str = "file") -> DataFrame:
    """(ancestor id, descendant row) by pre-order interval: a range join inside each tree."""
    a = nodes.select(F.col(group).alias("__g"), F.col("id").alias("ancestor"), F.col("last_id").alias("__last"))
    d = all_nodes.join(a, (all_nodes[group] == a["__g"]) & (all_nodes["id"] > a["ancestor"]) & (all_nodes["id"] <= a["__last"]))
    return d.drop("__g", "__last")


def nearest_ancestor(nodes: DataFrame, candidates: DataFrame, group: str = "file") -> DataFrame:
    """``(group, id, ancestor)``: the closest proper ancestor among ``candidates``; null if there is none."""
    c = candidates.select(F.col(group).alias("__g"), F.col("id").alias("__a"), F.col("last_id").alias("__last"))
    near = (nodes[group] == c["__g"]) & (nodes["id"] > c["__a"]) & (nodes["id"] <= c["__last"])
    return nodes.join(c, near, "left").groupBy(nodes[group], nodes["id"]).agg(F.max("__a").alias("ancestor"))


def first_below(nodes: DataFrame, matches: DataFrame, group: str = "file") -> DataFrame:
    """Matches below each node that have no other match between: (ancestor id, descendant row)."""
    below = descendants(nodes, matches, group)
    m = matches.select(F.col(group).alias("__g"), F.col("id").alias("__id"), F.col("last_id").alias("__last"))
    closer = (below[group] == m["__g"]) & (m["__id"] > below["ancestor"]) & (m["__id"] < below["id"]) & (below["id"] <= m["__last"])
    return below.join(m, closer, "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``(key, out_degree, in_degree)``, 0 where no edge meets the vertex."""
    o = edges.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("in_degree"))
    found = nodes.select(key).join(o, key, "left").join(i, key, "left")
    return found.na.fill(0, ["out_degree", "in_degree"])


def remove_vertices(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without those of ``gone`` and their incident edges."""
    ids = gone.select(key)
    left = edges.join(ids.withColumnRenamed(key, "src"), "src", "left_anti").join(ids.withColumnRenamed(key, "dst"), "dst", "left_anti")
    return nodes.join(ids, key, "left_anti"), left


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    return keep_first(df, by, [F.desc(c) for c in order])


def same_graph(left: DataFrame, right: DataFrame) -> bool:
    """Structural equality of two row sets, duplicates counted."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def dotted(nodes: DataFrame, by: Sequence[str], order: str = "id", text: str = "code") -> DataFrame:
    """Texts of each group in order, joined by dots."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return nodes.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), ".").alias("dotted"))


def dot_text(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """``(graph, dot)``: a Graphviz text of each graph, labels HTML-escaped.

    Edges may have a ``label`` and a ``style``, further attributes as Graphviz writes them.
    """
    from graphloom.functions.scalar import html_escape

    n = nodes.select(graph, F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).alias("b"), F.format_string('%d [label="%s"];', F.col("id"), html_escape(F.col("code"))).alias("line"))
    label = F.coalesce(F.col("label"), F.lit("")) if "label" in edges.columns else F.lit("")
    style = F.concat(F.lit(" "), F.col("style")) if "style" in edges.columns else F.lit("")
    e = edges.select(graph, F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string('%d -> %d [label="%s"%s];', F.col("src"), F.col("dst"), label, style).alias("line"))
    return _wrapped(n.union(e), graph, "digraph {\n", "\n}", "dot")


def _wrapped(lines: DataFrame, graph: str, before: str, after: str, name: str) -> DataFrame:
    """Each graph's lines (k, a, b, line) in order between two texts."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("k", "a", "b", "line"))), lambda x: x["line"])
    return lines.groupBy(graph).agg(F.concat(F.lit(before), F.array_join(body, "\n"), F.lit(after)).alias(name))


def graphml_text(nodes: DataFrame, edges: DataFrame, graph: str, properties: Sequence[str]) -> DataFrame:
    """``(graph, graphml)``: a GraphML text of each graph, with string properties of its nodes and the edges' labels."""
    from graphloom.functions.scalar import html_escape

    text = lambda c: F.regexp_replace(html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), '"', "&quot;")
    data = F.concat(*[F.concat(F.lit(f'<data key="{p}">'), text(p), F.lit("</data>")) for p in properties])
    n = nodes.select(graph, F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).alias("b"), F.concat(F.format_string('<node id="%d">', "id"), data, F.lit("</node>")).alias("line"))
    e = edges.select(graph, F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.format_string('<edge source="%d" target="%d"><data key="label">', "src", "dst"), text("label"), F.lit("</data></edge>")).alias("line"))
    keys = "\n".join([f'<key id="{p}" for="node" attr.name="{p}" attr.type="string"/>' for p in properties] + ['<key id="label" for="edge" attr.name="label" attr.type="string"/>'])
    return _wrapped(n.union(e), graph, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{keys}\n<graph edgedefault="directed">\n', "\n</graph>\n</graphml>", "graphml")
