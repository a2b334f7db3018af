import pytest
from oracle import compare

from graphloom.plans import java, wide
from graphloom.sources.java import CodeGraph, read_sources
from graphloom.sources.javarows import java_rows
from graphloom.operators import code

WIDE = """package a.b; import java.util.*; import static x.Y.z;
@Anno(value="x", k={1,2}) public abstract class G<T extends Comparable<T> & Foo> extends Base<List<Map<String,int[]>>> implements I, J<K> {
 private static final int[] xs = {1, 2, 0x1F, 1e3, 'c'}; int a, b = 2, c[];
 static { a = 1; } { b = 2; }
 public G(int... v) throws E, F { this(v[0]); super.foo(); }
 <Q> Q gen(final @P("a") Q q, String[] s) { Runnable r = () -> { x(); }; F f = (a, b) -> a + b; G g = String::valueOf; H h = int[]::new; L l = List<String>::new;
   int z = (int) -1 + (String) foo >> 2 >>> 3; boolean t = x instanceof Foo ? a < b : c > d; int[][] m = new int[3][]; Object o = new Foo<>(1) { void q() {} };
   outer: for (int i = 0, j = 1; i < 10; i++, j--) { for (;;) break outer; }
   for (final String u : list) continue; do { q++; } while (q < 3);
   synchronized (this) { x.y().z(1, 2)[3].w++; } try (A aa = new A(); B bb = b()) { } catch (E1 | E2 e) { throw e; } finally { }
   switch (k) { case 1: case 2: a(); break; default: } assert x : "m"; List<String> ls = null; a.b.c = d += 2; i = j == 3 ? 1 : 2; return String.class == int.class; }
 interface Inner { default void dd() {} int CONST = 1; } enum En implements I { A(1) { void f() {} }, B; En() {} En(int i) {} } @interface Ann { int v() default 3; } abstract void nobody(); }"""


@pytest.mark.parametrize("name", list(java.QUERIES | wide.QUERIES))
def test_query_matches_expected_rows(spark, name):
    compare(spark, (java.QUERIES | wide.QUERIES)[name], (java.SQL | wide.SQL)[name])


def test_wide_source_makes_a_tree_and_connected_flow():
    rows = list(java_rows("/x/G.java", WIDE))
    assert not [r for r in rows if r["rel"] == "error"]
    ast = [r for r in rows if r["rel"] == "ast"]
    assert [r["id"] for r in ast] == list(range(1, len(ast) + 1))
    for r in ast[1:]:
        up = ast[r["parent"] - 1]
        assert up["id"] < r["id"] <= r["last_id"] <= up["last_id"] and r["depth"] == up["depth"] + 1
    nodes = {(r["graph"], r["id"]) for r in rows if r["rel"] == "cfg"}
    edges = [r for r in rows if r["rel"] == "cfg_edge"]
    assert all((e["graph"], e[k]) in nodes for e in edges for k in ("src", "dst"))


def test_edges_of_the_input(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Ok.java").write_text("class Ok { void m() { return; } }")
    (tmp_path / "Bad.java").write_text("class {")
    (tmp_path / "Empty.java").write_text("")
    (tmp_path / "note.txt").write_text("class No { }")
    g = CodeGraph(read_sources(spark, str(tmp_path)))
    assert [r.qn for r in g.classes.collect()] == ["None.Ok"]
    assert g.errors.count() == 1 and g.ast.where("kind = 'ROOT'").count() == 1
    none = CodeGraph(spark.createDataFrame([(None, None)], "path string, text string"))
    assert none.classes.count() == 0


def test_forms_and_routes(spark, tmp_path):
    html = '<form action="/go" method="post"><input name="a"><input type=x name=\'b\'></form><form action="/n"></form>'
    got = code.html_forms(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").orderBy("k").collect()
    assert [(r.action, r.method, r.params) for r in got] == [("/go", "post", ["a", "b"]), ("/n", "", [])]
    jsp = '<s:form action="one"><s:hidden name="h"/><s:textfield label="L" name="t"/></s:form> <s:form action="two"><s:password name="p"/></s:form>'
    got = code.jsp_forms(spark.createDataFrame([(1, jsp)], "id int, t string"), "id", "t").orderBy("k").collect()
    assert [(r.action, r.names) for r in got] == [("one", ["t", "h"]), ("two", ["p"])]
    one, two = tmp_path / "one.xml", tmp_path / "two.xml"
    one.write_text('<struts><package name="default"><action name="a" class="p.A" method="m"/></package><package name="x"><action name="b" class="p.B"/></package></struts>')
    two.write_text('<struts><package name="default"><action name="a" class="p.C" method="n"/></package></struts>')
    got = sorted((r["action"], r["class"], r["method"]) for r in code.struts_actions(spark, [str(one), str(two)]).collect())
    assert got == [("a", "p.C", "n"), ("x.b", "p.B", None)]
    # included files are merged, by name beside the including file, and win
    main = tmp_path / "struts.xml"
    main.write_text('<struts><include file="two.xml"/><package name="default"><action name="a" class="p.A"/><action name="z" class="p.Z"/></package></struts>')
    got = sorted((r["action"], r["class"], r["method"]) for r in code.struts_actions(spark, str(main)).collect())
    assert got == [("a", "p.C", "n"), ("z", "p.Z", None)]
    (tmp_path / "pages" / "sub").mkdir(parents=True)
    (tmp_path / "pages" / "sub" / "x.jsp").write_text(jsp)
    (tmp_path / "pages" / "y.html").write_text(html)
    found = code.views(spark, str(tmp_path / "pages"), ".jsp")
    assert [(r.path.rpartition("/")[2], r.action) for r in code.jsp_forms(found, "path", "text").orderBy("k").collect()] == [("x.jsp", "one"), ("x.jsp", "two")]


def test_paths_of_more_than_32_nodes(spark):
    body = " ".join(f"a{i}();" for i in range(40))
    g = CodeGraph(spark.createDataFrame([("/src/Z.java", f"package p; class Z {{ void m() {{ {body} }} }}")], "path string, text string"))
    assert [r.path for r in code.control_paths(g, "p.Z.m", 1, 41).collect()] == [list(range(1, 42))]
    assert code.control_paths(g, "p.Z.m", 1, 41, most=40).collect() == []


def test_reaching_definitions_by_loop_and_by_graph(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import closure

    g = wide.graph(spark, wide.WIDE | java.SOURCES)
    facts = g.dfg.select("graph", F.col("cfg_id").cast("long").alias("id"), "defs", "uses")
    cfg = g.cfg_edges.select("graph", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    rows = lambda df: sorted((r.graph, r.src, r.dst, r["var"]) for r in df.collect())
    by_loop, by_graph = rows(closure.reaching_definitions(cfg, facts)), rows(closure.reaching_definitions_by_graph(cfg, facts))
    assert by_loop == by_graph and len(by_loop) > 50
    at = {(r.graph, r.cfg_id): r.id for r in g.dfg.collect()}
    parsed = sorted((r.graph, r.src, r.dst, r.label) for r in g.flows.where("kind = 'INTRA'").collect())
    assert parsed == sorted((k, at[k, a], at[k, b], v) for k, a, b, v in by_loop)
