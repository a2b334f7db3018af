"""The graph operators on property graphs that the relational tables make.

The foreign keys region, nation, customer, orders, lineitem are a tree; event
chains of a user are a control flow; suppliers with two successor functions
are a graph with cycles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import algebra, closure, code


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q03_has_filter(spark, d):
    return algebra.has(_t(spark, d, "lineitem"), l_returnflag="R", l_linestatus="O").select("l_orderkey", "l_linenumber")


def q04_where_exists(spark, d):
    lines = algebra.has(_t(spark, d, "lineitem"), l_returnflag="R").select(F.col("l_orderkey").alias("o_orderkey"))
    return algebra.where_exists(_t(spark, d, "orders"), lines, ["o_orderkey"]).select("o_orderkey")


def q05_and_exists(spark, d):
    lines = _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    returned = algebra.has(lines, l_returnflag="R").select("o_orderkey")
    large = lines.where("l_quantity > 45").select("o_orderkey")
    orders = _t(spark, d, "orders")
    return algebra.where_exists(algebra.where_exists(orders, returned, ["o_orderkey"]), large, ["o_orderkey"]).select("o_orderkey")


def _fk_edges(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, kind, code) and edges (src, dst) of region, nation, customer."""
    r, n, c = _t(spark, d, "region"), _t(spark, d, "nation"), _t(spark, d, "customer")
    key = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    nodes = (
        r.select(key("R", "r_regionkey").alias("id"), F.lit("REGION").alias("kind"), F.col("r_name").alias("code"))
        .union(n.select(key("N", "n_nationkey"), F.lit("NATION"), "n_name"))
        .union(c.select(key("C", "c_custkey"), F.lit("CUSTOMER"), "c_name"))
    )
    edges = n.select(key("R", "n_regionkey").alias("src"), key("N", "n_nationkey").alias("dst")).union(
        c.select(key("N", "c_nationkey"), key("C", "c_custkey"))
    )
    return nodes, edges


def q06_out(spark, d):
    nodes, edges = _fk_edges(spark, d)
    return algebra.out(algebra.has(nodes, kind="REGION"), edges, nodes).select("id", "code")


def q07_in(spark, d):
    nodes, edges = _fk_edges(spark, d)
    return algebra.in_(algebra.has(nodes, kind="CUSTOMER"), edges, nodes).groupBy("code").agg(F.count("*").alias("n"))


def _customer_trees(spark, d) -> DataFrame:
    """Each customer's orders and lines as a tree (g, id, last_id, kind, key, line) with pre-order ids."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("g"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("g"), "o_orderkey", "o_orderstatus")
    n = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    sized = o.join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("g").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    orders = sized.withColumn("id", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)) + 2)
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    rank = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber"))
    placed = lines.withColumn("k", rank).join(orders.select("g", "o_orderkey", F.col("id").alias("o_id")), "o_orderkey")
    tops = c.join(orders.groupBy("g").agg(F.sum(F.col("n") + 1).alias("m")), "g", "left")
    return (
        tops.select("g", F.lit(1).cast("long").alias("id"), (F.coalesce("m", F.lit(0)) + 1).alias("last_id"), F.lit("CUSTOMER").alias("kind"), F.col("g").alias("key"), F.lit(None).cast("int").alias("line"))
        .union(orders.select("g", "id", F.col("id") + F.col("n"), F.concat(F.lit("ORDER_"), "o_orderstatus"), "o_orderkey", F.lit(None).cast("int")))
        .union(placed.select("g", F.col("o_id") + F.col("k"), F.col("o_id") + F.col("k"), F.lit("LINE"), "o_orderkey", F.col("l_linenumber").cast("int")))
    )


def q09_descendants(spark, d):
    t = _customer_trees(spark, d)
    below = algebra.descendants(t.where("kind != 'LINE'"), t, "g")
    return below.groupBy("g", "ancestor").agg(F.count("*").alias("n_desc")).join(t.select("g", F.col("id").alias("ancestor"), F.col("kind").alias("k"), F.col("key").alias("top")), ["g", "ancestor"]).select("k", "top", "n_desc")


def q11_nearest_ancestor(spark, d):
    t = _customer_trees(spark, d)
    near = algebra.nearest_ancestor(t.where("kind = 'LINE'"), t.where("kind IN ('CUSTOMER', 'ORDER_F')"), "g")
    tops = t.select("g", F.col("id").alias("ancestor"), "kind")
    lines = t.where("kind = 'LINE'").select("g", "id", F.col("key").alias("l_orderkey"), F.col("line").alias("l_linenumber"))
    return near.join(tops, ["g", "ancestor"]).join(lines, ["g", "id"]).select("l_orderkey", "l_linenumber", "kind")


def q14_select_pair(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))


def q19_first_match(spark, d):
    e = _t(spark, d, "events").select("event_type", "event_id", "user_id")
    return algebra.keep_first(e, ["event_type"], ["event_id"])


def g02_remove_vertex(spark, d):
    nodes, edges = _fk_edges(spark, d)
    _, left = algebra.remove_vertices(nodes, edges, nodes.where("kind = 'NATION' AND code < 'J'"))
    return left


def g04_degree(spark, d):
    nodes, edges = _fk_edges(spark, d)
    return algebra.degrees(nodes, edges)


def g06_last_match(spark, d):
    e = _t(spark, d, "events").select("event_type", "event_id", "user_id")
    return algebra.keep_last(e, ["event_type"], ["event_id"])


def f1_reaching_defs(spark, d):
    # a user's events in order are a graph; views define what purchases use
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("id"))
    one = F.array(F.lit("v"))
    none = F.array().cast("array<string>")
    facts = e.select(
        F.col("user_id").alias("graph"), "id", F.when(F.col("event_type").isin("signup", "view"), one).otherwise(none).alias("defs"),
        F.when(F.col("event_type") == "purchase", one).otherwise(none).alias("uses"),
    )
    cfg = e.where("id > 1").select(F.col("user_id").alias("graph"), (F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    found = closure.reaching_definitions_by_graph(cfg, facts)
    name = lambda c, as_: e.select(F.col("user_id").alias("graph"), F.col("id").alias(c), F.col("event_id").alias(as_))
    return found.join(name("src", "def_id"), ["graph", "src"]).join(name("dst", "use_id"), ["graph", "dst"]).select("def_id", "use_id")


def _ring(spark, d) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    n = s.count()
    return s.select("src", ((F.col("src") * 3 + 1) % n).alias("dst")).union(s.select("src", ((F.col("src") * 7 + 2) % n).alias("dst")))


def t12_closure(spark, d):
    edges = _ring(spark, d)
    return closure.reach(edges, edges.select(F.col("src").alias("id")))


def t13_pairs(spark, d):
    edges = _ring(spark, d)
    ids = edges.select(F.col("src").alias("id")).distinct()
    return closure.reachable_pairs(edges, ids, ids)


def p5_simple_paths(spark, d):
    edges = _ring(spark, d)
    found = closure.simple_paths(edges, edges.select(F.col("src").alias("id")), 4)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def t14_first_wins(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return algebra.keep_first(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def e3_tag_attrs(spark, d):
    return code.tag_attributes(_t(spark, d, "pages"), "page_id", "html", "a", "href").select("page_id", F.col("value").alias("href"))


def s16_json(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def sharedid_md5(spark, d):
    return _t(spark, d, "documents").select("doc_id", scalar.shared_id(F.lit("StmtExprContext"), F.col("doc_id"), F.col("n_chars")).alias("shared_id"))


def h7_html_escape(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.length(scalar.html_escape(F.col("text"))).alias("n"))


def h6_find_callers(spark, d):
    calls = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("method_qn")).agg(F.collect_set("role").alias("callees"))
    return code.find_callers(calls, "any.system")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q03_has_filter, q04_where_exists, q05_and_exists, q06_out, q07_in, q09_descendants, q11_nearest_ancestor, q14_select_pair,
        q19_first_match, g02_remove_vertex, g04_degree, g06_last_match, f1_reaching_defs, t12_closure, t13_pairs, p5_simple_paths,
        t14_first_wins, e3_tag_attrs, s16_json, sharedid_md5, h7_html_escape, h6_find_callers,
    )
}

_FK = """
nodes AS (
  SELECT 'R' || r_regionkey AS id, 'REGION' AS kind, r_name AS code FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'CUSTOMER', c_name FROM customer
), edges AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
)"""
_RING = """
n AS (SELECT count(*) AS n FROM supplier),
e AS (SELECT s_suppkey AS src, (s_suppkey * 3 + 1) % n AS dst FROM supplier, n UNION SELECT s_suppkey, (s_suppkey * 7 + 2) % n FROM supplier, n)"""
_REACH = """r AS (SELECT e.src AS source, e.dst AS node FROM e UNION SELECT r.source, e.dst FROM r JOIN e ON r.node = e.src)"""

SQL: dict[str, str] = {
    "q03_has_filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'",
    "q04_where_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "q05_and_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "q06_out": f"WITH {_FK} SELECT c.id, c.code FROM nodes p JOIN edges ON p.id = src JOIN nodes c ON c.id = dst WHERE p.kind = 'REGION'",
    "q07_in": f"WITH {_FK} SELECT p.code, count(*) AS n FROM nodes c JOIN edges ON c.id = dst JOIN nodes p ON p.id = src WHERE c.kind = 'CUSTOMER' GROUP BY p.code",
    "q09_descendants": """WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT 'ORDER_' || o_orderstatus AS k, o_orderkey AS top, n AS n_desc FROM n WHERE n > 0
UNION ALL SELECT 'CUSTOMER', o_custkey, sum(n + 1)::BIGINT FROM n JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey""",
    "q11_nearest_ancestor": """SELECT l_orderkey, l_linenumber::INT AS l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'ORDER_F' ELSE 'CUSTOMER' END AS kind
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "q14_select_pair": "SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey",
    "q19_first_match": "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k = 1",
    "g02_remove_vertex": f"WITH {_FK}, gone AS (SELECT id FROM nodes WHERE kind = 'NATION' AND code < 'J') SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)",
    "g04_degree": f"""WITH {_FK} SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes
LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON id = o.src LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON id = i.dst""",
    "g06_last_match": "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "f1_reaching_defs": """SELECT def_id, event_id AS use_id FROM (
SELECT *, last_value(CASE WHEN event_type IN ('signup', 'view') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM events
) WHERE event_type = 'purchase' AND def_id IS NOT NULL""",
    "t12_closure": f"WITH RECURSIVE {_RING}, {_REACH} SELECT source, node FROM r",
    "t13_pairs": f"WITH RECURSIVE {_RING}, {_REACH} SELECT source, node AS sink FROM r WHERE node IN (SELECT src FROM e) UNION SELECT src, src FROM e",
    "p5_simple_paths": f"""WITH RECURSIVE {_RING}, p AS (
SELECT [src, dst] AS path, dst FROM e WHERE src <> dst
UNION ALL SELECT list_append(path, e.dst), e.dst FROM p JOIN e ON p.dst = e.src WHERE NOT list_contains(path, e.dst) AND len(path) < 4
) SELECT array_to_string(path, '>') AS path FROM p""",
    "t14_first_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "e3_tag_attrs": """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""",
    "s16_json": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "sharedid_md5": "SELECT doc_id, md5('StmtExprContext' || doc_id || n_chars) AS shared_id FROM documents",
    "h7_html_escape": "SELECT doc_id, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))::INT AS n FROM documents",
    "h6_find_callers": "SELECT conv_id::VARCHAR AS method_qn FROM conversations GROUP BY conv_id HAVING list_contains(list(role), 'system')",
}
