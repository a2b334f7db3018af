"""Program-graph queries on Java sources in this module; their SQL are the expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import code
from graphloom.sources.java import CodeGraph

SOURCES = {
    "A.java": "package p;\nclass A { int f(int x) { int y = x + 1; if (y > 0) { y = 2; } return y; } }",
    "B.java": "package p;\nclass B { void g(Session s, String q) { s.createQuery(q); h(q); } void h(String z) { } }",
    "C.java": 'package p;\n@Controller\nclass C {\n  @GetMapping("/u")\n  String u(@RequestParam String id) { String q = "a" + id; st.executeQuery(q); return q; }\n}',
    "D.java": "package p; class D { void m(int n) { while (n > 0) { if (n == 5) break; n--; } } }",
    "E.java": "package p; class E { int m(int n) { int s = 0; for (int i = 0; i < n; i++) { s = s + i; } return s; } }",
    "F.java": "package p; class F { void m() { try { a(); } catch (E e) { b(); } finally { c(); } } void a(){} void b(){} void c(){} }",
    "G.java": "package p; class G { void m(int k) { switch (k) { case 1: a(); break; case 2: b(); default: c(); } } void a(){} void b(){} void c(){} }",
    "H.java": "package p; class H { Helper h; void m(String a) { h.run(a); } } class Helper { void run(String b) { } }",
    "K.java": "package p; class K { void m(U u) { u.a.b(1); c(); } }",
    "L.java": "package p; class L { Run r; void m(List<String> l, String a) { l.add(a); r.go(); new Run(a); } }",
    "Run.java": "package p; class Run { Run(String s) { } void go() { } } class List { void add(String x) { } }",
    "X.java": "package p; class X extends Base { String title; void f(int a) { } void f(String b) { products = getTitle(); } } class Base extends ActionSupport { }",
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"/src/{k}", v) for k, v in SOURCES.items()], "path string, text string")


def graph(spark: SparkSession) -> CodeGraph:
    return CodeGraph(sources(spark))


def java_ast(spark, d):
    g = graph(spark).ast.where("file = 'p.A'")
    return g.select("id", "kind", "code", F.coalesce("parent", F.lit(0)).alias("parent"))


def java_cfg_nodes(spark, d):
    return graph(spark).cfg.select("graph", "id", "kind")


def java_cfg_edges(spark, d):
    return graph(spark).cfg_edges.select("graph", "src", "dst", "label")


def java_def_use(spark, d):
    g = graph(spark).dfg
    return g.select("graph", "id", "code", F.array_join("defs", ",").alias("defs"), F.array_join("uses", ",").alias("uses"))


def java_data_flow(spark, d):
    found = code.data_flow(graph(spark))
    return found.select("graph", "src", "dst", "dst_graph", "label", "kind")


def java_call_graph(spark, d):
    return code.call_graph(graph(spark)).select("method_qn", F.array_join("callees", ",").alias("callees"))


def java_sinks(spark, d):
    g = graph(spark)
    found = code.create_query(g).union(code.execute_query(g)).union(code.save_calls(g)).union(code.exec_calls(g))
    return found.select("file", "line", "sink_text", "vulnerability", "checkpoint")


def java_routes(spark, d):
    return code.spring_routes(graph(spark)).select("class", "method", "route", F.array_join("params", ",").alias("params"))


def java_taint(spark, d):
    g = graph(spark)
    return code.taint_flows(g, code.placed(g, code.sources(g, "SpringMVC")), code.sinks(g, "SpringMVC"))


def java_classes(spark, d):
    return graph(spark).classes.select("qn", "name", "extends")


def java_methods(spark, d):
    return graph(spark).methods.select("graph", "name", "ret_type", F.array_join("args", ",").alias("args"))


def java_super_classes(spark, d):
    return code.super_classes(graph(spark))


def java_assigned(spark, d):
    return code.assigned(graph(spark), "products").select("file", "checkpoint", "vulnerability")


def java_dotted_calls(spark, d):
    return code.calls(graph(spark)).select("file", "dotted", F.array_join("args", ",").alias("args"))


def java_flow_node(spark, d):
    g = graph(spark)
    names = g.ast.where("file = 'p.A' AND kind IN ('LITERAL', 'PACKAGE')")
    return code.flow_node(g, names).select("id", "graph", "df")


def java_first_call(spark, d):
    g = graph(spark)
    return code.first_call(g, g.ast.where("kind = 'METHOD' AND file IN ('p.A', 'p.B', 'p.K')")).select("file", "id", "call")


def java_paths(spark, d):
    return code.control_paths(graph(spark), "p.D.m", 1, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def java_subgraph(spark, d):
    return code.control_subgraph(graph(spark), "p.D.m", 4, 7)


def java_callers(spark, d):
    return code.find_callers(code.call_graph(graph(spark)), "p.F.c")


def java_fields(spark, d):
    return graph(spark).fields.select("qn", "name", "type")


def java_node(spark, d):
    return graph(spark).cfg.where("graph = 'p.A.f' AND id = 3").select("kind", "line", "code")


def java_dot(spark, d):
    g = graph(spark)
    from graphloom.operators.algebra import dot_text

    only = F.col("graph") == "p.A.f"
    return dot_text(g.cfg.where(only), g.cfg_edges.where(only), "graph")


def java_method_calls(spark, d):
    return code.method_calls(graph(spark), "p", "F", "c").select("file", "line")


def java_arguments(spark, d):
    return code.arguments_named(graph(spark), "q").select("file", "line")


def java_get_method(spark, d):
    return code.get_method(graph(spark), "p.X", "f").select("graph", F.array_join("args", ",").alias("args"))


def java_class_by_name(spark, d):
    return code.class_by_name(graph(spark), "Helper").select("qn", "file")


def java_graphs_of_file(spark, d):
    return code.graphs_of_file(graph(spark), "p.F")


def java_returns(spark, d):
    return code.returns(graph(spark)).select("file", "line")


def java_parameters(spark, d):
    return graph(spark).parameters.select("graph", "id", "name", "type")


def d04_usable(spark, d):
    rows = [("x",), ("$INT",), ("f()",), ("a[0]",), ("i++",), ("-x",), ("a.b",), ("{1}",), ("<T>f",), ("!b",), ("x--",)]
    return spark.createDataFrame(rows, "e string").where(scalar.is_usable(F.col("e")))


def d20_builtin(spark, d):
    rows = [("List<String>",), ("Helper",), ("Map.Entry",), ("int",), ("Integer[]",)]
    return spark.createDataFrame(rows, "t string").where(scalar.is_builtin(F.col("t")))


def h08_infix(spark, d):
    rows = [(1, ["+", "a", "b"]), (2, ["*", "+", "a", "b", "c"]), (3, ["x"])]
    return spark.createDataFrame(rows, "k int, e array<string>").select("k", scalar.infix(F.col("e")).alias("infix"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        java_ast, java_cfg_nodes, java_cfg_edges, java_def_use, java_data_flow, java_call_graph, java_sinks, java_routes, java_taint,
        java_classes, java_methods, java_super_classes, java_assigned,
        java_dotted_calls, java_flow_node, java_first_call, java_paths, java_subgraph, java_callers, java_fields, java_node, java_dot,
        java_method_calls, java_arguments, java_get_method, java_class_by_name, java_graphs_of_file, java_returns, java_parameters, d04_usable, d20_builtin, h08_infix,
    )
}


def _values(columns: str, *rows: tuple) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({columns})"


def _listed(key: str, text: str) -> list[tuple]:
    """``1-EPS-2`` items as rows of a graph."""
    return [(key, int(a), int(b), label) for a, label, b in (x.split("-") for x in text.split())]


def _numbered(key: str, text: str) -> list[tuple]:
    return [(key, k, kind) for k, kind in enumerate(text.split(), 1)]


SQL: dict[str, str] = {
    "java_ast": _values(
        "id, kind, code, parent",
        (1, "ROOT", "Filename", 0), (2, "PACKAGE", "p", 1), (3, "CLASS", "", 1), (4, "MODIFIER", "", 3), (5, "NAME", "A", 3), (6, "METHOD", "", 3),
        (7, "MODIFIER", "", 6), (8, "RET_VAL_TYPE", "int", 6), (9, "NAME", "f", 6), (10, "PARAMS", "", 6), (11, "VARIABLE", "", 10), (12, "TYPE", "int", 11),
        (13, "NAME", "x", 11), (14, "BLOCK", "", 6), (15, "VARIABLE", "", 14), (16, "TYPE", "int", 15), (17, "NAME", "y", 15), (18, "INIT_VALUE", "=", 15),
        (19, "BOP", "+", 18), (20, "NAME", "x", 19), (21, "LITERAL", "1", 19), (22, "IF", "", 14), (23, "CONDITION", "", 22), (24, "BOP", ">", 23),
        (25, "NAME", "y", 24), (26, "LITERAL", "0", 24), (27, "THEN", "", 22), (28, "STATEMENT", "", 27), (29, "ASSIGN", "", 28), (30, "ASSIGN_LEFT", "", 29),
        (31, "NAME", "y", 30), (32, "ASSIGN_RIGHT", "", 29), (33, "LITERAL", "2", 32), (34, "RETURN", "", 14), (35, "NAME", "y", 34),
    ),
    "java_cfg_nodes": _values(
        "graph, id, kind",
        *_numbered("p.A.f", "ENTRY ASSIGN IF EXPR IF_END RET"),
        *_numbered("p.D.m", "ENTRY WHILE WHILE_END IF BREAK IF_END EXPR"),
        *_numbered("p.E.m", "ENTRY ASSIGN FOR_INIT FOR_EXPR FOR_UPDATE FOR_END EXPR RET"),
        *_numbered("p.F.m", "ENTRY TRY TRY_END EXPR FINALLY EXPR FINALLY_END CATCH_END CATCH EXPR"),
        *_numbered("p.G.m", "ENTRY SWITCH SWITCH_END CASE_STMT EXPR BREAK CASE_STMT EXPR CASE_STMT EXPR"),
        *_numbered("p.B.g", "ENTRY EXPR EXPR"), *_numbered("p.C.u", "ENTRY ASSIGN EXPR RET"), *_numbered("p.H.m", "ENTRY EXPR"), *_numbered("p.K.m", "ENTRY EXPR EXPR"),
        *_numbered("p.L.m", "ENTRY EXPR EXPR EXPR"), *_numbered("p.X.f#2", "ENTRY EXPR"),
        *[(m, 1, "ENTRY") for m in ("p.B.h", "p.F.a", "p.F.b", "p.F.c", "p.G.a", "p.G.b", "p.G.c", "p.Helper.run", "p.Run.Run", "p.Run.go", "p.List.add", "p.X.f")],
    ),
    "java_cfg_edges": _values(
        "graph, src, dst, label",
        *_listed("p.A.f", "1-EPS-2 2-EPS-3 3-TRUE-4 4-EPS-5 3-FALSE-5 5-EPS-6"),
        *_listed("p.D.m", "1-EPS-2 2-FALSE-3 2-TRUE-4 4-TRUE-5 5-EPS-3 4-FALSE-6 6-EPS-7 7-EPS-2"),
        *_listed("p.E.m", "1-EPS-2 2-EPS-3 3-EPS-4 4-FALSE-6 4-TRUE-7 7-EPS-5 5-EPS-4 6-EPS-8"),
        *_listed("p.F.m", "1-EPS-2 2-EPS-4 4-EPS-3 3-EPS-5 5-EPS-6 6-EPS-7 3-THROWS-9 9-EPS-10 10-EPS-8 8-EPS-5"),
        *_listed("p.G.m", "1-EPS-2 2-EPS-4 4-TRUE-5 5-EPS-6 6-EPS-3 4-FALSE-7 7-TRUE-8 8-EPS-9 7-FALSE-9 9-EPS-10 10-EPS-3"),
        *_listed("p.B.g", "1-EPS-2 2-EPS-3"), *_listed("p.C.u", "1-EPS-2 2-EPS-3 3-EPS-4"), *_listed("p.H.m", "1-EPS-2"), *_listed("p.K.m", "1-EPS-2 2-EPS-3"),
        *_listed("p.L.m", "1-EPS-2 2-EPS-3 3-EPS-4"), *_listed("p.X.f#2", "1-EPS-2"),
    ),
    "java_def_use": _values(
        "graph, id, code, defs, uses",
        ("p.A.f", 1, "int f(int x)", "x", ""), ("p.A.f", 2, "y = x + 1", "y", "x"), ("p.A.f", 3, "if (y > 0)", "", "y"), ("p.A.f", 4, "y = 2;", "y", ""), ("p.A.f", 5, "return y;", "", "y"),
        ("p.B.g", 1, "void g(Session s, String q)", "q,s", ""), ("p.B.g", 2, "s.createQuery(q);", "", "q,s"), ("p.B.g", 3, "h(q);", "", "q"),
        ("p.D.m", 1, "void m(int n)", "n", ""), ("p.D.m", 2, "while (n > 0)", "", "n"), ("p.D.m", 3, "if (n == 5)", "", "n"), ("p.D.m", 4, "n--;", "n", "n"),
        ("p.B.h", 1, "void h(String z)", "z", ""), ("p.C.u", 1, "String u(@RequestParam String id)", "id", ""), ("p.C.u", 2, 'q = "a" + id', "q", "id"), ("p.C.u", 3, "st.executeQuery(q);", "", "q"), ("p.C.u", 4, "return q;", "", "q"),
        ("p.E.m", 1, "int m(int n)", "n", ""), ("p.E.m", 2, "s = 0", "s", ""), ("p.E.m", 3, "int i = 0", "i", ""), ("p.E.m", 4, "i < n", "", "i,n"), ("p.E.m", 5, "i++", "i", "i"), ("p.E.m", 6, "s = s + i;", "s", "i,s"), ("p.E.m", 7, "return s;", "", "s"),
        ("p.F.m", 1, "void m()", "", ""), ("p.F.m", 2, "a();", "", ""), ("p.F.m", 3, "c();", "", ""), ("p.F.m", 4, "catch (E e)", "e", ""), ("p.F.m", 5, "b();", "", ""),
        ("p.G.m", 1, "void m(int k)", "k", ""), ("p.G.m", 2, "switch (k)", "", "k"), ("p.G.m", 3, "a();", "", ""), ("p.G.m", 4, "b();", "", ""), ("p.G.m", 5, "c();", "", ""),
        *[(f"p.{c}.{m}", 1, f"void {m}()", "", "") for c in "FG" for m in "abc"],
        ("p.H.m", 1, "void m(String a)", "a", ""), ("p.H.m", 2, "h.run(a);", "", "a,h"), ("p.Helper.run", 1, "void run(String b)", "b", ""),
        ("p.K.m", 1, "void m(U u)", "u", ""), ("p.K.m", 2, "u.a.b(1);", "", "u"), ("p.K.m", 3, "c();", "", ""),
        ("p.L.m", 1, "void m(List<String> l, String a)", "a,l", ""), ("p.L.m", 2, "l.add(a);", "l", "a,l"), ("p.L.m", 3, "r.go();", "", "r"), ("p.L.m", 4, "new Run(a);", "", "a"),
        ("p.Run.Run", 1, "Run(String s)", "s", ""), ("p.Run.go", 1, "void go()", "", ""), ("p.List.add", 1, "void add(String x)", "x", ""),
        ("p.X.f", 1, "void f(int a)", "a", ""), ("p.X.f#2", 1, "void f(String b)", "b", ""), ("p.X.f#2", 2, "products = getTitle();", "", ""),
    ),
    "java_data_flow": _values(
        "graph, src, dst, dst_graph, label, kind",
        *[("p.A.f", a, b, "p.A.f", v, "INTRA") for a, b, v in ((1, 2, "x"), (2, 3, "y"), (2, 5, "y"), (4, 5, "y"))],
        *[("p.B.g", 1, b, "p.B.g", v, "INTRA") for b, v in ((2, "s"), (2, "q"), (3, "q"))],
        ("p.B.g", 3, 1, "p.B.h", "inter-procedural", "INTER"),
        *[("p.C.u", a, b, "p.C.u", v, "INTRA") for a, b, v in ((1, 2, "id"), (2, 3, "q"), (2, 4, "q"))],
        *[("p.D.m", a, b, "p.D.m", "n", "INTRA") for a, b in ((1, 2), (1, 3), (1, 4), (4, 2), (4, 3))],
        ("p.H.m", 1, 2, "p.H.m", "a", "INTRA"), ("p.H.m", 2, 1, "p.Helper.run", "inter-procedural", "INTER"),
        # l.add defines l and has no edge to the project's class List
        ("p.L.m", 1, 2, "p.L.m", "l", "INTRA"), ("p.L.m", 1, 2, "p.L.m", "a", "INTRA"), ("p.L.m", 1, 4, "p.L.m", "a", "INTRA"),
        # a call without arguments has none either
        ("p.L.m", 4, 1, "p.Run.Run", "inter-procedural", "INTER"),
        *[("p.E.m", a, b, "p.E.m", v, "INTRA") for a, b, v in ((1, 4, "n"), (2, 6, "s"), (2, 7, "s"), (3, 4, "i"), (3, 5, "i"), (3, 6, "i"), (5, 4, "i"), (5, 6, "i"), (6, 7, "s"))],
        ("p.G.m", 1, 2, "p.G.m", "k", "INTRA"), ("p.K.m", 1, 2, "p.K.m", "u", "INTRA"),
    ),
    "java_call_graph": _values(
        "method_qn, callees", ("p.B.g", "createQuery,h"), ("p.C.u", "executeQuery"), ("p.F.m", "a,b,c"), ("p.G.m", "a,b,c"), ("p.H.m", "run"), ("p.K.m", "b,c"), ("p.L.m", "add,go"), ("p.X.f", "getTitle"),
    ),
    "java_sinks": _values("file, line, sink_text, vulnerability, checkpoint", ("p.B", 2, "createQuery", "SQL", "q"), ("p.C", 5, "executeQuery", "SQL", "q")),
    "java_routes": _values("class, method, route, params", ("p.C", "u", '"/u"', "id")),
    "java_taint": _values("source_graph, source_id, sink_graph, sink_id, vulnerability, checkpoint", ("p.C.u", 1, "p.C.u", 3, "SQL", "q")),
    "java_classes": _values("qn, name, extends", *[(f"p.{n}", n, {"X": "Base", "Base": "ActionSupport"}.get(n)) for n in ("A", "B", "C", "D", "E", "F", "G", "H", "Helper", "K", "L", "Run", "List", "X", "Base")]),
    "java_methods": _values(
        "graph, name, ret_type, args", ("p.A.f", "f", "int", "x"), ("p.B.g", "g", "void", "s,q"), ("p.B.h", "h", "void", "z"), ("p.C.u", "u", "String", "id"), ("p.D.m", "m", "void", "n"), ("p.E.m", "m", "int", "n"),
        ("p.F.m", "m", "void", ""), ("p.G.m", "m", "void", "k"), *[(f"p.{c}.{m}", m, "void", "") for c in "FG" for m in "abc"], ("p.H.m", "m", "void", "a"), ("p.Helper.run", "run", "void", "b"),
        ("p.K.m", "m", "void", "u"), ("p.L.m", "m", "void", "l,a"), ("p.Run.Run", "Run", None, "s"), ("p.Run.go", "go", "void", ""), ("p.List.add", "add", "void", "x"), ("p.X.f", "f", "void", "a"), ("p.X.f#2", "f", "void", "b"),
    ),
    "java_super_classes": _values("qn, ancestor", ("p.X", "Base"), ("p.X", "ActionSupport"), ("p.Base", "ActionSupport")),
    "java_dotted_calls": _values("file, dotted, args", ("p.B", "s.createQuery", "q"), ("p.B", "h", "q"), ("p.H", "h.run", "a"), ("p.K", "u.a.b", "1"), ("p.K", "c", ""),
        ("p.C", "st.executeQuery", "q"), *[(f"p.{c}", m, "") for c in "FG" for m in "abc"], ("p.L", "l.add", "a"), ("p.L", "r.go", ""), ("p.X", "getTitle", "")),
    "java_flow_node": _values("id, graph, df", (2, None, None), (21, "p.A.f", 2), (26, "p.A.f", 3), (33, "p.A.f", 4)),
    "java_first_call": _values("file, id, call", ("p.A", 6, None), ("p.B", 6, "h"), ("p.B", 30, None), ("p.K", 6, "c")),
    "java_paths": _values("path", ("1>2>3",), ("1>2>4>5>3",)),
    "java_subgraph": _values("src, dst, label", (4, 5, "TRUE"), (5, 3, "EPS"), (4, 6, "FALSE"), (6, 7, "EPS")),
    "java_callers": _values("method_qn", ("p.F.m",), ("p.G.m",), ("p.K.m",)),
    "java_fields": _values("qn, name, type", ("p.H", "h", "Helper"), ("p.L", "r", "Run"), ("p.X", "title", "String")),
    "java_node": _values("kind, line, code", ("IF", 2, "if (y > 0)")),
    "java_dot": "SELECT 'p.A.f' AS graph, concat_ws(chr(10), 'digraph {', '1 [label=\"int f(int x)\"];', '2 [label=\"int y = x + 1;\"];', '3 [label=\"if (y &gt; 0)\"];', '4 [label=\"y = 2;\"];', '5 [label=\"endif\"];', '6 [label=\"return y;\"];', "
    + "'1 -> 2 [label=\"EPS\"];', '2 -> 3 [label=\"EPS\"];', '3 -> 4 [label=\"TRUE\"];', '3 -> 5 [label=\"FALSE\"];', '4 -> 5 [label=\"EPS\"];', '5 -> 6 [label=\"EPS\"];', '}') AS dot",
    "java_method_calls": _values("file, line", ("p.F", 1)),
    "java_arguments": _values("file, line", ("p.B", 2), ("p.B", 2), ("p.C", 5)),
    "java_get_method": _values("graph, args", ("p.X.f", "a")),
    "java_class_by_name": _values("qn, file", ("p.Helper", "p.H")),
    "java_graphs_of_file": _values("graph, nodes", ("p.F.m", 10), ("p.F.a", 1), ("p.F.b", 1), ("p.F.c", 1)),
    "java_returns": _values("file, line", ("p.A", 2), ("p.C", 5), ("p.E", 1)),
    "java_parameters": _values("graph, id, name, type", ("p.B.g", 1, "s", "Session"), ("p.B.g", 2, "q", "String"), ("p.B.h", 1, "z", "String"), ("p.C.u", 1, "id", "String"),
        ("p.A.f", 1, "x", "int"), ("p.D.m", 1, "n", "int"), ("p.E.m", 1, "n", "int"), ("p.G.m", 1, "k", "int"), ("p.H.m", 1, "a", "String"), ("p.Helper.run", 1, "b", "String"), ("p.K.m", 1, "u", "U"),
        ("p.L.m", 1, "l", "List<String>"), ("p.L.m", 2, "a", "String"), ("p.Run.Run", 1, "s", "String"), ("p.List.add", 1, "x", "String"), ("p.X.f", 1, "a", "int"), ("p.X.f#2", 1, "b", "String")),
    "d04_usable": _values("e", ("x",), ("a.b",)),
    "d20_builtin": _values("t", ("List<String>",), ("Map.Entry",), ("Integer[]",)),
    "h08_infix": _values("k, infix", (1, "(a+b)"), (2, "((a+b)*c)"), (3, "x")),
    "java_assigned": _values("file, checkpoint, vulnerability", ("p.X", "getTitle()", "XSS")),
}
