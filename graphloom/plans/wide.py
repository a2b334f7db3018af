"""Queries on Java sources that hold every construct; their SQL are the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import algebra, closure, code
from graphloom.plans.java import _listed, _numbered, _values
from graphloom.plans.java import graph as small_graph
from graphloom.sources import store
from graphloom.sources.java import CodeGraph

WIDE = {
    "S1.java": """package p.q; import java.util.List; import static a.b.*;
@Anno public final class S1 extends Base<String> implements I, J {
  private static int a, b = 2; int[] xs = {1, 'c'};
  static { a = 1; }
  public S1(int n, String... v) { this.a = n; super(v); }
  <T> T id(T t) { return t; }
  interface In { int K = 1; } enum En { X, Y }
}""",
    "S2.java": """package p; class S2 {
  void each(List<String> list) { for (final String u : list) { if (u == null) continue; break; } }
  void loops(int n) { int k; do { k = n; } while (k < 3); outer: for (int i = 0, j = 1; i < n; i++, j--) { for (;;) { break outer; } } }
  int guard(Object o) throws E { synchronized (o) { n(o); } try (A aa = open(o)) { n(aa); } catch (E e) { throw e; } finally { n(o); } return 1; }
  void pick(int k) { outer: while (k > 0) { switch (k) { case 1: continue outer; default: k--; } } ; assert k > 0; return; }
}""",
    "S3.java": """package p; class S3 { int f; int[] w;
  Object e(int i, String s, int[] a) { int z = (int) i + a[i] * -i; boolean t = s instanceof Foo ? !b(i) : i >> 2 > 1;
    int[] m = new int[i]; Object o = new Foo(s, 1) { void q() { r(); } }; this.f = i; super.go(s); x.y.go(s).z = i += 2; i++; --i; Runnable r = () -> b(i); return a[0]; } }""",
}
COMPAT = {"V.java": "package v; class V { int m(int a) { int b = a >> 2; int c = a > 0 ? a : b; c = b; ++c; return c; } }"}
STRUTS = {
    "Act.java": """package w; class Act extends ActionSupport { String title;
  String run(Dao d) { d.save(title); rt.exec(cmd); setTitle(q); products = getTitle(); d.createQuery(title); u.getLogin(); return getTitle(); } }
class Other { void no() { getTitle(); setTitle(x); } }"""
}


def graph(spark: SparkSession, files: dict[str, str], compat: bool = False) -> CodeGraph:
    return CodeGraph(spark.createDataFrame([(f"/src/{k}", v) for k, v in files.items()], "path string, text string"), compat)


def wide_ast(spark, d):
    return graph(spark, WIDE).ast.select("file", "id", "kind", "code", F.coalesce("parent", F.lit(0)).alias("parent"))


def wide_call_properties(spark, d):
    calls = graph(spark, WIDE).ast.where("kind IN ('CALL', 'ASSIGN')")
    return calls.select("file", "id", "name", F.array_join("args", ",").alias("args"), "text")


def wide_cfg_nodes(spark, d):
    return graph(spark, WIDE).cfg.select("graph", "id", "kind")


def wide_cfg_edges(spark, d):
    return graph(spark, WIDE).cfg_edges.select("graph", "src", "dst", "label")


def wide_def_use(spark, d):
    return graph(spark, WIDE).dfg.select("graph", "id", "code", F.array_join("defs", ",").alias("defs"), F.array_join("uses", ",").alias("uses"))


def wide_flows(spark, d):
    return graph(spark, WIDE).flows.select("graph", "src", "dst", "label", "kind")


def wide_self_flows(spark, d):
    return code.self_flows(graph(spark, WIDE))


def wide_classes(spark, d):
    g = graph(spark, WIDE)
    return g.classes.select("qn", "name", "extends", *[F.array_join(c, ",").alias(c) for c in ("implementations", "modifiers", "annotations")], "line")


def wide_fields(spark, d):
    return graph(spark, WIDE).fields.select("qn", "name", "type", F.array_join("modifiers", ",").alias("modifiers"))


def wide_methods(spark, d):
    return graph(spark, WIDE).methods.select("graph", "name", "ret_type", F.array_join("args", ",").alias("args"), "line")


def wide_shared_ids(spark, d):
    g = graph(spark, {"T.java": "package p; class T { void m() { a(); } }"})
    return g.ast.where("shared_id IS NOT NULL AND kind IN ('CLASS', 'METHOD', 'STATEMENT', 'CALL')").select("kind", "shared_id")


def compat_ast(spark, d):
    return graph(spark, COMPAT, True).ast.where("id > 13").select("id", "kind", "code", "parent")


def compat_def_use(spark, d):
    return graph(spark, COMPAT, True).dfg.select("graph", "id", F.array_join("defs", ",").alias("defs"), F.array_join("uses", ",").alias("uses"))


def struts_sources(spark, d):
    return code.sources(graph(spark, STRUTS), "Struts2").select("file", "line", "text")


def struts_sinks(spark, d):
    return code.sinks(graph(spark, STRUTS), "Struts2").select("file", "line", "sink_text", "vulnerability", "checkpoint")


def struts_taint(spark, d):
    g = graph(spark, STRUTS)
    return code.taint_flows(g, code.placed(g, code.sources(g, "Struts2")), code.sinks(g, "Struts2"))


def spring_sources(spark, d):
    return code.sources(small_graph(spark), "SpringMVC").select("file", "id", "line", "text")


def login_names(spark, d):
    return code.login_names(graph(spark, STRUTS)).select("file", "line")


def save_and_exec(spark, d):
    g = graph(spark, STRUTS)
    return code.save_calls(g).union(code.exec_calls(g)).select("file", "sink_text", "vulnerability", "checkpoint")


def method_names(spark, d):
    return code.method_names(graph(spark, WIDE | STRUTS))


def first_below(spark, d):
    a = small_graph(spark).ast.where("file = 'p.A'")
    return algebra.first_below(a.where("kind = 'BLOCK'"), a.where("kind IN ('IF', 'CONDITION', 'NAME')")).select("ancestor", "id")


def control_node(spark, d):
    g = small_graph(spark)
    names = g.ast.where("file = 'p.A' AND kind IN ('LITERAL', 'PACKAGE')")
    return code.control_node(g, names).select("id", "graph", "cf")


def pruned_visits(spark, d):
    edges = small_graph(spark).cfg_edges.where("graph = 'p.D.m'").select("src", "dst")
    one = lambda n: spark.createDataFrame([(n,)], "id int")
    return closure.pruned(edges, one(1), one(4)).select("node", "hops")


def flow_targets(spark, d):
    g = small_graph(spark)
    call = g.ast.where("file = 'p.C' AND kind = 'CALL'").first().shared_id
    return code.flow_targets(g, code.data_flow(g), "p.C.u", 2, call)


def flows_from(spark, d):
    return code.flows_from(code.data_flow(small_graph(spark)), "p.D.m", 4).select("dst", "label", "kind")


def _initial(spark):
    g = small_graph(spark)
    return code.initial_subgraph(g, g.cfg.where("graph = 'p.D.m' AND kind = 'IF'").first().shared_id)


def initial_nodes(spark, d):
    return _initial(spark)[0].select("id", "kind")


def initial_edges(spark, d):
    return _initial(spark)[1].select("src", "dst", "label")


def same_graph(spark, d):
    g = small_graph(spark)
    rows = [("itself", algebra.same_graph(g.cfg_edges, g.cfg_edges)), ("less one", algebra.same_graph(g.cfg_edges, g.cfg_edges.where("graph != 'p.D.m' OR src > 1")))]
    return spark.createDataFrame(rows, "k string, same boolean")


def dotted_names(spark, d):
    # the names below each dotted path of S3, in order
    g = graph(spark, WIDE).ast.where("file = 'p.S3'")
    names = g.where("kind = 'NAME'").select("file", F.col("parent").alias("id"), F.col("id").alias("n"), "code")
    tops = g.where("kind = 'DOT'").select("file", "id")
    return algebra.dotted(tops.join(names, ["file", "id"]), ["id"], "n").select("id", "dotted")


TINY = {"T.java": "package p; class T { void m(int a) { f(a); } }"}


def plot_ast(spark, d):
    return code.plot(graph(spark, TINY), "ast")


def plot_cfg(spark, d):
    return code.plot(graph(spark, TINY), "cfg")


def plot_dfg(spark, d):
    return code.plot(graph(spark, TINY), "dfg")


def graphml(spark, d):
    g = graph(spark, TINY)
    return algebra.graphml_text(g.cfg, g.cfg_edges, "graph", ["kind", "code"])


def node_ast(spark, d):
    return code.node(small_graph(spark), "ast", "p.A", 22).select("kind", "line")


def node_dfg(spark, d):
    return code.node(small_graph(spark), "dfg", "p.D.m", 4).select("code", F.array_join("defs", ",").alias("defs"))


def node_absent(spark, d):
    return code.node(small_graph(spark), "cfg", "p.D.m", 99).select("kind")


def json_round_trip(spark, d):
    nodes = graph(spark, TINY).dfg.select("graph", "id", "code", "defs", "uses")
    back = store.typed_rows(store.json_rows(nodes), nodes.schema)
    return back.select("graph", "id", "code", F.array_join("defs", ",").alias("defs"), F.array_join("uses", ",").alias("uses"))


def flat_nodes(spark, d):
    calls = graph(spark, TINY).ast.where("kind = 'CALL'").select("id", "kind", "name", "args", "text")
    return store.flat_rows(calls, ["name", "args", "text"])


def k10_state_change(spark, d):
    names = ["setX", "putAll", "Address", "insertAt", "push", "APPEND", "reset", "input", "get", "addressOf"]
    return spark.createDataFrame([(n,) for n in names], "name string").where(scalar.changes_state(F.col("name")))


QUERIES = {
    f.__name__ if f.__name__.startswith(("wide", "compat", "k10")) else f"java_{f.__name__}": f
    for f in (
        wide_ast, wide_call_properties, wide_cfg_nodes, wide_cfg_edges, wide_def_use, wide_flows, wide_self_flows, wide_classes, wide_fields, wide_methods, wide_shared_ids,
        compat_ast, compat_def_use, struts_sources, struts_sinks, struts_taint, spring_sources, login_names, save_and_exec, method_names, first_below, control_node,
        pruned_visits, flow_targets, flows_from, initial_nodes, initial_edges, same_graph, dotted_names, plot_ast, plot_cfg, plot_dfg, graphml, node_ast, node_dfg, node_absent, json_round_trip, flat_nodes, k10_state_change,
    )
}


def _outline(file: str, text: str) -> list[tuple]:
    """Rows (file, id, kind, code, parent) of an outline: depth by dots, ids in order."""
    rows, path = [], []
    for n, line in enumerate(text.strip().split("\n"), 1):
        depth = len(line) - len(line.lstrip("."))
        kind, _, code_ = line[depth:].partition(" ")
        path[depth:] = [n]
        rows.append((file, n, kind, code_, path[depth - 1] if depth else 0))
    return rows


_S1 = """
ROOT Filename
.PACKAGE p.q
.IMPORT java.util.List
.IMPORT a.b.*
.CLASS
..MODIFIER public final
..NAME S1
..EXTENDS Base<String>
..IMPLEMENTS
...INTERFACE I
...INTERFACE J
..FIELD
...MODIFIER private static
...TYPE int
...NAME a
...MODIFIER private static
...TYPE int
...NAME b
...INIT_VALUE =
....LITERAL 2
..FIELD
...MODIFIER
...TYPE int[]
...NAME xs
...INIT_VALUE =
....ARRAY_INIT
.....LITERAL 1
.....LITERAL 'c'
..STATIC_BLOCK
...STATEMENT
....ASSIGN
.....ASSIGN_LEFT
......NAME a
.....ASSIGN_RIGHT
......LITERAL 1
..CONSTRUCTOR
...MODIFIER public
...PARAMS
....VARIABLE
.....TYPE int
.....NAME n
....VARIABLE
.....TYPE String
.....NAME v
...BLOCK
....STATEMENT
.....ASSIGN
......ASSIGN_LEFT
.......DOT
........NAME this
........NAME a
......ASSIGN_RIGHT
.......NAME n
....STATEMENT
.....CALL
......NAME super
......PARAMS
.......NAME v
..METHOD
...MODIFIER
...RET_VAL_TYPE T
...NAME id
...PARAMS
....VARIABLE
.....TYPE T
.....NAME t
...BLOCK
....RETURN
.....NAME t
..FIELD
...MODIFIER
...TYPE int
...NAME K
...INIT_VALUE =
....LITERAL 1
"""
_S2 = """
ROOT Filename
.PACKAGE p
.CLASS
..MODIFIER
..NAME S2
..METHOD
...MODIFIER
...RET_VAL_TYPE void
...NAME each
...PARAMS
....VARIABLE
.....TYPE List<String>
.....NAME list
...BLOCK
....FOR_EACH
.....TYPE String
.....NAME u
.....FOR_IN
......NAME list
.....BLOCK
......IF
.......CONDITION
........BOP ==
.........NAME u
.........LITERAL null
.......THEN
........STATEMENT continue;
......STATEMENT break;
..METHOD
...MODIFIER
...RET_VAL_TYPE void
...NAME loops
...PARAMS
....VARIABLE
.....TYPE int
.....NAME n
...BLOCK
....VARIABLE
.....TYPE int
.....NAME k
....DO_WHILE
.....CONDITION (k < 3)
.....BLOCK
......STATEMENT
.......ASSIGN
........ASSIGN_LEFT
.........NAME k
........ASSIGN_RIGHT
.........NAME n
....LABELED
.....NAME outer
.....FOR
......FOR_INIT
.......VARIABLE
........TYPE int
........NAME i
........INIT_VALUE =
.........LITERAL 0
.......VARIABLE
........TYPE int
........NAME j
........INIT_VALUE =
.........LITERAL 1
......CONDITION
.......BOP <
........NAME i
........NAME n
......FOR_UPDATE
.......STATEMENT
........UNARY ++
.........NAME i
.......STATEMENT
........UNARY --
.........NAME j
......BLOCK
.......FOR
........BLOCK
.........STATEMENT break outer;
..METHOD
...MODIFIER
...RET_VAL_TYPE int
...NAME guard
...PARAMS
....VARIABLE
.....TYPE Object
.....NAME o
...BLOCK
....SYNC
.....STATEMENT (o)
......NAME o
.....BLOCK
......STATEMENT
.......CALL
........NAME n
........PARAMS
.........NAME o
....TRY
.....RESOURCES
......VARIABLE
......TYPE A
......NAME aa
......INIT_VALUE =
.......CALL
........NAME open
........PARAMS
.........NAME o
.....BLOCK
......STATEMENT
.......CALL
........NAME n
........PARAMS
.........NAME aa
.....CATCH
......TYPE E
......NAME e
......BLOCK
.......STATEMENT throw e;
........NAME e
.....FINALLY
......STATEMENT
.......CALL
........NAME n
........PARAMS
.........NAME o
....RETURN
.....LITERAL 1
..METHOD
...MODIFIER
...RET_VAL_TYPE void
...NAME pick
...PARAMS
....VARIABLE
.....TYPE int
.....NAME k
...BLOCK
....LABELED
.....NAME outer
.....WHILE
......CONDITION
.......BOP >
........NAME k
........LITERAL 0
......BLOCK
.......SWITCH
........NAME k
........CASE 1
........BLOCK
.........STATEMENT continue outer;
........DEFAULT
........BLOCK
.........STATEMENT
..........UNARY --
...........NAME k
....BOP >
.....NAME k
.....LITERAL 0
....STATEMENT return;
"""
_S3 = """
ROOT Filename
.PACKAGE p
.CLASS
..MODIFIER
..NAME S3
..FIELD
...MODIFIER
...TYPE int
...NAME f
..FIELD
...MODIFIER
...TYPE int[]
...NAME w
..METHOD
...MODIFIER
...RET_VAL_TYPE Object
...NAME e
...PARAMS
....VARIABLE
.....TYPE int
.....NAME i
....VARIABLE
.....TYPE String
.....NAME s
....VARIABLE
.....TYPE int[]
.....NAME a
...BLOCK
....VARIABLE
.....TYPE int
.....NAME z
.....INIT_VALUE =
......BOP +
.......CAST
........TYPE int
........NAME i
.......BOP *
........ARRAY
.........NAME a
.........NAME i
........UNARY -
.........NAME i
....VARIABLE
.....TYPE boolean
.....NAME t
.....INIT_VALUE =
......TERNARY
.......TERNARY_PREDICATE
........BOP instanceof
.........NAME s
.........TYPE Foo
.......TERNARY_TRUE
........UNARY !
.........CALL
..........NAME b
..........PARAMS
...........NAME i
.......TERNARY_FALSE
........BOP >
.........BOP >>
..........NAME i
..........LITERAL 2
.........LITERAL 1
....VARIABLE
.....TYPE int[]
.....NAME m
.....INIT_VALUE =
......NAME i
....VARIABLE
.....TYPE Object
.....NAME o
.....INIT_VALUE =
......ARGS
.......NAME s
.......LITERAL 1
......METHOD
.......MODIFIER
.......RET_VAL_TYPE void
.......NAME q
.......BLOCK
........STATEMENT
.........CALL
..........NAME r
....STATEMENT
.....ASSIGN
......ASSIGN_LEFT
.......DOT
........NAME this
........NAME f
......ASSIGN_RIGHT
.......NAME i
....STATEMENT
.....DOT
......NAME super
......CALL
.......NAME go
.......PARAMS
........NAME s
....STATEMENT
.....ASSIGN
......ASSIGN_LEFT
.......DOT
........DOT
.........DOT
..........NAME x
..........NAME y
.........CALL
..........NAME go
..........PARAMS
...........NAME s
........NAME z
......ASSIGN_RIGHT
.......ASSIGN
........ASSIGN_LEFT
.........NAME i
........ASSIGN_RIGHT
.........LITERAL 2
....STATEMENT
.....UNARY ++
......NAME i
....STATEMENT
.....UNARY --
......NAME i
....VARIABLE
.....TYPE Runnable
.....NAME r
.....INIT_VALUE =
......CALL
.......NAME b
.......PARAMS
........NAME i
....RETURN
.....ARRAY
......NAME a
......LITERAL 0
"""


def _text(columns: str, key: str, *lines: str) -> str:
    """One row of a key and a text of several lines."""
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in lines)
    return f"SELECT * FROM (VALUES ('{key}', concat_ws(chr(10), {quoted}))) t({columns})"


def _at(file: str, outline: str, kind: str) -> list[int]:
    return [r[1] for r in _outline(file, outline) if r[2] == kind]


def _properties() -> list[tuple]:
    """Names, arguments and texts of the calls and assignments, in the outlines' order."""
    calls = {
        "p.q.S1": [("super", "v", None)],
        "p.S2": [("n", "o", None), ("open", "o", None), ("n", "aa", None), ("n", "o", None)],
        "p.S3": [("b", "i", None), ("r", "", None), ("go", "s", "super.go"), ("go", "s", "x.y.go"), ("b", "i", None)],
    }
    assigned = {"p.q.S1": ["1", "n"], "p.S2": ["n"], "p.S3": ["i", "i += 2", "2"]}
    out = []
    for file, outline in (("p.q.S1", _S1), ("p.S2", _S2), ("p.S3", _S3)):
        out += [(file, i, *x) for i, x in zip(_at(file, outline, "CALL"), calls[file], strict=True)]
        out += [(file, i, None, None, x) for i, x in zip(_at(file, outline, "ASSIGN"), assigned[file], strict=True)]
    return out


SQL = {
    "wide_ast": _values("file, id, kind, code, parent", *_outline("p.q.S1", _S1), *_outline("p.S2", _S2), *_outline("p.S3", _S3)),
    "wide_call_properties": _values("file, id, name, args, text", *_properties()),
    "wide_cfg_nodes": _values(
        "graph, id, kind",
        *_numbered("p.q.S1.S1", "ENTRY EXPR EXPR"), *_numbered("p.q.S1.id", "ENTRY RET"),
        *_numbered("p.S2.each", "ENTRY FOR_EXPR FOR_END IF CONTINUE IF_END BREAK"),
        *_numbered("p.S2.loops", "ENTRY ASSIGN DO_WHILE WHILE DO_WHILE_END EXPR LABEL LABEL_END FOR_INIT FOR_EXPR FOR_UPDATE FOR_END FOR_INIT FOR_EXPR FOR_UPDATE FOR_END BREAK"),
        *_numbered("p.S2.guard", "ENTRY SYNC SYNC_END EXPR TRY RESOURCE TRY_END EXPR FINALLY EXPR FINALLY_END CATCH_END CATCH THROW RET"),
        *_numbered("p.S2.pick", "ENTRY LABEL LABEL_END WHILE WHILE_END SWITCH SWITCH_END CASE_STMT CONTINUE CASE_STMT EXPR RET"),
        *_numbered("p.S3.e", "ENTRY ASSIGN ASSIGN ASSIGN ASSIGN EXPR EXPR EXPR EXPR EXPR ASSIGN RET"),
    ),
    "wide_cfg_edges": _values(
        "graph, src, dst, label",
        *_listed("p.q.S1.S1", "1-EPS-2 2-EPS-3"), *_listed("p.q.S1.id", "1-EPS-2"),
        *_listed("p.S2.each", "1-EPS-2 2-FALSE-3 2-TRUE-4 4-TRUE-5 5-EPS-2 4-FALSE-6 6-EPS-7 7-EPS-3"),
        *_listed("p.S2.loops", "1-EPS-2 2-EPS-3 3-EPS-6 6-EPS-4 4-TRUE-3 4-FALSE-5 5-EPS-7 7-EPS-9 9-EPS-10 11-EPS-10 10-FALSE-12 10-TRUE-13 13-EPS-14 15-EPS-14 14-FALSE-16 14-TRUE-17 17-EPS-8 16-EPS-11 12-EPS-8"),
        *_listed("p.S2.guard", "1-EPS-2 2-EPS-4 4-EPS-3 3-EPS-5 5-EPS-6 6-EPS-8 8-EPS-7 7-EPS-9 9-EPS-10 10-EPS-11 7-THROWS-13 13-EPS-14 12-EPS-9 11-EPS-15"),
        *_listed("p.S2.pick", "1-EPS-2 2-EPS-4 4-FALSE-5 4-TRUE-6 6-EPS-8 8-TRUE-9 9-EPS-2 10-EPS-11 8-FALSE-10 11-EPS-7 7-EPS-4 5-EPS-3 3-EPS-12"),
        *_listed("p.S3.e", " ".join(f"{k}-EPS-{k + 1}" for k in range(1, 12))),
    ),
    "wide_def_use": _values(
        "graph, id, code, defs, uses",
        ("p.q.S1.S1", 1, "S1(int n, String... v)", "n,v", ""), ("p.q.S1.S1", 2, "this.a = n;", "a", "n"), ("p.q.S1.S1", 3, "super(v);", "", "v"),
        ("p.q.S1.id", 1, "T id(T t)", "t", ""), ("p.q.S1.id", 2, "return t;", "", "t"),
        ("p.S2.each", 1, "void each(List<String> list)", "list", ""), ("p.S2.each", 2, "for (final String u : list)", "u", "list"), ("p.S2.each", 3, "if (u == null)", "", "u"),
        ("p.S2.loops", 1, "void loops(int n)", "n", ""), ("p.S2.loops", 2, "k", "", ""), ("p.S2.loops", 3, "k = n;", "k", "n"), ("p.S2.loops", 4, "while (k < 3)", "", "k"),
        ("p.S2.loops", 5, "int i = 0, j = 1", "i,j", ""), ("p.S2.loops", 6, "i < n", "", "i,n"), ("p.S2.loops", 7, "i++, j--", "i,j", "i,j"),
        ("p.S2.guard", 1, "int guard(Object o)", "o", ""), ("p.S2.guard", 2, "synchronized (o)", "", "o"), ("p.S2.guard", 3, "n(o);", "", "o"), ("p.S2.guard", 4, "A aa = open(o)", "aa", "o"),
        ("p.S2.guard", 5, "n(aa);", "", "aa"), ("p.S2.guard", 6, "n(o);", "", "o"), ("p.S2.guard", 7, "catch (E e)", "e", ""), ("p.S2.guard", 8, "throw e;", "", "e"), ("p.S2.guard", 9, "return 1;", "", ""),
        ("p.S2.pick", 1, "void pick(int k)", "k", ""), ("p.S2.pick", 2, "while (k > 0)", "", "k"), ("p.S2.pick", 3, "switch (k)", "", "k"), ("p.S2.pick", 4, "k--;", "k", "k"), ("p.S2.pick", 5, "return;", "", ""),
        ("p.S3.e", 1, "Object e(int i, String s, int[] a)", "a,i,s", ""), ("p.S3.e", 2, "z = (int) i + a[i] * -i", "z", "a,i"), ("p.S3.e", 3, "t = s instanceof Foo ? !b(i) : i >> 2 > 1", "t", "i,s"),
        ("p.S3.e", 4, "m = new int[i]", "m", "i"), ("p.S3.e", 5, "o = new Foo(s, 1) { void q() { r(); } }", "o", "s"), ("p.S3.e", 6, "this.f = i;", "f", "i"), ("p.S3.e", 7, "super.go(s);", "", "s"),
        ("p.S3.e", 8, "x.y.go(s).z = i += 2;", "i", "i"), ("p.S3.e", 9, "i++;", "i", "i"), ("p.S3.e", 10, "--i;", "i", "i"), ("p.S3.e", 11, "r = () -> b(i)", "r", "i"), ("p.S3.e", 12, "return a[0];", "", "a"),
    ),
    "wide_flows": _values(
        "graph, src, dst, label, kind",
        ("p.q.S1.S1", 1, 2, "n", "INTRA"), ("p.q.S1.S1", 1, 3, "v", "INTRA"), ("p.q.S1.id", 1, 2, "t", "INTRA"),
        ("p.S2.each", 1, 2, "list", "INTRA"), ("p.S2.each", 2, 3, "u", "INTRA"),
        *[("p.S2.loops", a, b, v, "INTRA") for a, b, v in ((1, 3, "n"), (1, 6, "n"), (3, 4, "k"), (5, 6, "i"), (5, 7, "i"), (5, 7, "j"), (7, 6, "i"))],
        *[("p.S2.guard", 1, b, "o", "INTRA") for b in (2, 3, 4, 6)], ("p.S2.guard", 4, 5, "aa", "INTRA"), ("p.S2.guard", 7, 8, "e", "INTRA"),
        *[("p.S2.pick", 1, b, "k", "INTRA") for b in (2, 3, 4)], *[("p.S2.pick", 4, b, "k", "INTRA") for b in (2, 3)],
        *[("p.S3.e", 1, b, "i", "INTRA") for b in (2, 3, 4, 6, 8)], *[("p.S3.e", 1, b, "s", "INTRA") for b in (3, 5, 7)], *[("p.S3.e", 1, b, "a", "INTRA") for b in (2, 12)],
        ("p.S3.e", 8, 9, "i", "INTRA"), ("p.S3.e", 9, 10, "i", "INTRA"), ("p.S3.e", 10, 11, "i", "INTRA"), ("p.S3.e", 10, 10, "i", "SELF"),
    ),
    "wide_self_flows": _values("graph, src, label", ("p.S3.e", 10, "i")),
    "wide_classes": _values(
        "qn, name, extends, implementations, modifiers, annotations, line",
        ("p.q.S1", "S1", "Base<String>", "I,J", "public,final", "Anno()", 2), ("p.S2", "S2", None, "", "", "", 1), ("p.S3", "S3", None, "", "", "", 1),
    ),
    "wide_fields": _values(
        "qn, name, type, modifiers", ("p.q.S1", "a", "int", "private,static"), ("p.q.S1", "b", "int", "private,static"), ("p.q.S1", "xs", "int[]", ""), ("p.S3", "f", "int", ""), ("p.S3", "w", "int[]", ""),
    ),
    "wide_methods": _values(
        "graph, name, ret_type, args, line",
        ("p.q.S1.S1", "S1", None, "n,v", 5), ("p.q.S1.id", "id", "T", "t", 6), ("p.S2.each", "each", "void", "list", 2), ("p.S2.loops", "loops", "void", "n", 3), ("p.S2.guard", "guard", "int", "o", 4),
        ("p.S2.pick", "pick", "void", "k", 5), ("p.S3.e", "e", "Object", "i,s,a", 2),
    ),
    # md5 of the context's name, its first and its last character
    "wide_shared_ids": "SELECT kind, md5(context || first || last) AS shared_id FROM (VALUES ('CLASS', 'ClassDeclarationContext', 11, 39), ('METHOD', 'MethodDeclarationContext', 21, 37), "
    "('STATEMENT', 'StmtExprContext', 32, 35), ('CALL', 'MethodCallContext', 32, 34)) t(kind, context, first, last)",
    "compat_ast": _values(
        "id, kind, code, parent",
        (14, "BLOCK", "", 6), (15, "VARIABLE", "", 14), (16, "TYPE", "int", 15), (17, "NAME", "b", 15), (18, "INIT_VALUE", "=", 15), (19, "BOP", ">", 18), (20, "NAME", "a", 19), (21, "LITERAL", "2", 19),
        (22, "VARIABLE", "", 14), (23, "TYPE", "int", 22), (24, "NAME", "c", 22), (25, "INIT_VALUE", "=", 22), (26, "TERNARY", "", 25), (27, "TERNARY_PREDICATE", "", 25), (28, "BOP", ">", 27),
        (29, "NAME", "a", 28), (30, "LITERAL", "0", 28), (31, "TERNARY_TRUE", "", 25), (32, "NAME", "a", 31), (33, "TERNARY_FALSE", "", 25), (34, "NAME", "b", 33),
        (35, "STATEMENT", "", 14), (36, "ASSIGN", "", 35), (37, "ASSIGN_LEFT", "", 36), (38, "NAME", "c", 37), (39, "ASSIGN_RIGHT", "", 36), (40, "NAME", "b", 39),
        (41, "STATEMENT", "", 14), (42, "UNARY", "++", 41), (43, "NAME", "c", 42), (44, "RETURN", "", 14), (45, "NAME", "c", 44),
    ),
    "compat_def_use": _values("graph, id, defs, uses", ("v.V.m", 1, "a", ""), ("v.V.m", 2, "b", "a"), ("v.V.m", 3, "c", "a,b"), ("v.V.m", 4, "c", "b,c"), ("v.V.m", 5, "", "c"), ("v.V.m", 6, "", "c")),
    "java_struts_sources": _values(
        "file, line, text", *[("w.Act", 2, 'Call of method "getTitle"')] * 2, *[("w.Act", 2, 'Parameter "title"')] * 2,
    ),
    "java_struts_sinks": _values(
        "file, line, sink_text, vulnerability, checkpoint",
        ("w.Act", 2, "createQuery", "SQL", "title"), ("w.Act", 2, 'Call of method "setTitle"', "XSS", "q"), ("w.Act", 2, 'Variable "products" assignment', "XSS", "getTitle()"),
        ("w.Act", 2, "save", "XSS", "title"), ("w.Act", 2, "exec", "CI", "cmd"),
    ),
    "java_struts_taint": _values(
        "source_graph, source_id, sink_graph, sink_id, vulnerability, checkpoint",
        ("w.Act.run", 2, "w.Act.run", 2, "XSS", "title"), ("w.Act.run", 5, "w.Act.run", 5, "XSS", "getTitle()"), ("w.Act.run", 6, "w.Act.run", 6, "SQL", "title"),
    ),
    "java_spring_sources": _values("file, id, line, text", ("p.C", 11, 5, 'Parameter "id" of method "u"')),
    "java_login_names": _values("file, line", ("w.Act", 2)),
    "java_save_and_exec": _values("file, sink_text, vulnerability, checkpoint", ("w.Act", "save", "XSS", "title"), ("w.Act", "exec", "CI", "cmd")),
    "java_method_names": _values("file, name", ("p.q.S1", "id"), *[("p.S2", n) for n in ("each", "loops", "guard", "pick")], ("p.S3", "e"), ("p.S3", "q"), ("w.Act", "run"), ("w.Act", "no")),
    "java_first_below": _values("ancestor, id", (14, 17), (14, 20), (14, 22), (14, 35)),
    "java_control_node": _values("id, graph, cf", (2, None, None), (21, "p.A.f", 2), (26, "p.A.f", 3), (33, "p.A.f", 4)),
    "java_pruned_visits": _values("node, hops", (1, 0), (2, 1), (3, 2), (4, 2)),
    "java_flow_targets": _values("graph, id", ("p.C.u", 3)),
    "java_flows_from": _values("dst, label, kind", (2, "n", "INTRA"), (3, "n", "INTRA")),
    "java_initial_nodes": _values("id, kind", (1, "WHILE"), (2, "WHILE_END"), (3, "IF"), (4, "BREAK"), (5, "IF_END"), (6, "EXPR")),
    "java_initial_edges": _values("src, dst, label", (1, 2, "FALSE"), (1, 3, "TRUE"), (3, 4, "TRUE"), (4, 2, "EPS"), (3, 5, "FALSE"), (5, 6, "EPS"), (6, 1, "EPS")),
    "java_same_graph": "SELECT 'itself' AS k, true AS same UNION ALL SELECT 'less one', false",
    "java_dotted_names": _values("id, dotted", *[(i, t) for i, t in zip(_at("p.S3", _S3, "DOT"), ("this.f", "super", "z", None, "x.y"), strict=True) if t]),
    "java_plot_ast": _text("file, dot", "p.T", "digraph {", *[f'{i} [label="{t}"];' for i, t in enumerate(
        ("ROOT: Filename", "PACKAGE: p", "CLASS", "MODIFIER", "NAME: T", "METHOD", "MODIFIER", "RET_VAL_TYPE: void", "NAME: m", "PARAMS", "VARIABLE", "TYPE: int", "NAME: a", "BLOCK", "STATEMENT", "CALL", "NAME: f", "PARAMS", "NAME: a"), 1)],
        *[f'{a} -> {b} [label="" color="green"];' for a, b in ((1, 2), (1, 3), (3, 4), (3, 5), (3, 6), (6, 7), (6, 8), (6, 9), (6, 10), (6, 14), (10, 11), (11, 12), (11, 13), (14, 15), (15, 16), (16, 17), (16, 18), (18, 19))], "}"),
    "java_plot_cfg": _text("graph, dot", "p.T.m", "digraph {", '1 [label="void m(int a)"];', '2 [label="f(a);"];', '1 -> 2 [label="EPS"];', "}"),
    "java_plot_dfg": _text("graph, dot", "p.T.m", "digraph {", '1 [label="void m(int a)"];', '2 [label="f(a);"];', '1 -> 2 [label="EPS" color="grey" style="dashed"];', '1 -> 2 [label="a" color="teal"];', "}"),
    "java_graphml": _text(
        "graph, graphml", "p.T.m", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="kind" for="node" attr.name="kind" attr.type="string"/>', '<key id="code" for="node" attr.name="code" attr.type="string"/>',
        '<key id="label" for="edge" attr.name="label" attr.type="string"/>', '<graph edgedefault="directed">', '<node id="1"><data key="kind">ENTRY</data><data key="code">void m(int a)</data></node>',
        '<node id="2"><data key="kind">EXPR</data><data key="code">f(a);</data></node>', '<edge source="1" target="2"><data key="label">EPS</data></edge>', "</graph>", "</graphml>",
    ),
    "java_node_ast": _values("kind, line", ("IF", 2)),
    "java_node_dfg": _values("code, defs", ("n--;", "n")),
    "java_node_absent": "SELECT '' AS kind WHERE false",
    "java_json_round_trip": _values("graph, id, code, defs, uses", ("p.T.m", 1, "void m(int a)", "a", ""), ("p.T.m", 2, "f(a);", "", "a")),
    "java_flat_nodes": _values("id, kind, properties", (16, "CALL", '{"name":"f","args":["a"]}')),
    "k10_state_change": _values("name", ("setX",), ("putAll",), ("Address",), ("insertAt",), ("push",), ("APPEND",), ("addressOf",)),
}
