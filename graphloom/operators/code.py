"""Queries on code graphs: call graph, data flow, patterns, taint, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import algebra, closure
from graphloom.sources.java import CodeGraph


def _kind(g: CodeGraph, kind: str) -> DataFrame:
    return g.ast.where(F.col("kind") == kind)


def _child(g: CodeGraph, kind: str, code: str | None = None) -> DataFrame:
    """``(file, id, child_code)`` of the parents of children of a kind."""
    found = _kind(g, kind)
    if code is not None:
        found = found.where(F.col("code") == code)
    return found.select("file", F.col("parent").alias("id"), F.col("code").alias("child_code"))


def call_graph(g: CodeGraph) -> DataFrame:
    """``(method_qn, callees)``: names of the calls below each method, a bag in id order."""
    names = _child(g, "NAME")
    classes = _kind(g, "CLASS").join(names, ["file", "id"]).select("file", F.col("id").alias("c_id"), F.col("last_id").alias("c_last"), F.col("child_code").alias("cls"))
    methods = _kind(g, "METHOD").join(names, ["file", "id"]).select("file", "id", "last_id", F.col("parent").alias("c_id"), F.col("child_code").alias("method"))
    package = _kind(g, "PACKAGE").select("file", F.col("code").alias("package"))
    calls = _kind(g, "CALL").select("file", F.col("id").alias("call"), "name")
    named = methods.join(classes, ["file", "c_id"]).join(package, "file", "left")
    below = named.join(calls, (named["file"] == calls["file"]) & (calls["call"] > named["id"]) & (calls["call"] <= named["last_id"])).select(
        F.concat_ws(".", F.coalesce("package", F.lit("None")), "cls", "method").alias("method_qn"), "call", "name"
    )
    bag = F.array_sort(F.collect_list(F.struct("call", "name")))
    return below.groupBy("method_qn").agg(F.transform(bag, lambda x: x["name"]).alias("callees"))


def find_callers(calls: DataFrame, method_qn: str) -> DataFrame:
    return calls.where(F.array_contains("callees", scalar.last_segment(F.lit(method_qn)))).select("method_qn")


def data_flow(g: CodeGraph) -> DataFrame:
    """``(graph, src, dst, dst_graph, label, kind)``: INTRA and INTER edges on data-flow ids.

    A method's definitions are followed to their uses where it is parsed: methods are small and many.
    """
    intra = g.flows.where("kind = 'INTRA'").select("graph", "src", "dst", F.col("graph").alias("dst_graph"), "label", "kind")
    return intra.union(call_edges(g))


def self_flows(g: CodeGraph) -> DataFrame:
    """``(graph, src, label)``: statements that define a variable from itself (``++x``)."""
    return g.flows.where("kind = 'SELF'").select("graph", "src", "label")


def call_edges(g: CodeGraph) -> DataFrame:
    """INTER edges from calls to the entries of the project's methods.

    Calls without arguments and receivers of library types have none.  A call without a receiver is of its own class, one with a declared receiver
    type of the class of that simple name (the first by name), ``new T`` of its
    constructors; overloads are matched by name, the first wins.
    """
    classes = g.classes.select("qn", F.col("name").alias("cls"))
    first = algebra.keep_first(classes, ["cls"], ["qn"])
    simple = F.regexp_replace("type", r"\[\]", "")
    c = g.calls.where("n_args > 0").withColumn("cls", F.when(F.col("type").isNotNull(), scalar.last_segment(simple)))
    by_type = c.where(F.col("cls").isNotNull() & ~scalar.is_builtin(F.col("type"))).join(first, "cls").select("graph", "id", "name", "qn", "cls")
    own = c.where("receiver IS NULL AND type IS NULL").select("graph", "id", "name", F.col("owner").alias("qn"), F.lit(None).cast("string").alias("cls"))
    wanted = by_type.union(own).withColumn("name", F.when(F.col("name") == "<init>", F.col("cls")).otherwise(F.col("name"))).drop("cls")
    methods = algebra.keep_first(g.methods.select("qn", "name", F.col("graph").alias("dst_graph"), F.col("id").alias("k")), ["qn", "name"], ["k"])
    return wanted.join(methods, ["qn", "name"]).select(
        "graph", F.col("id").alias("src"), F.lit(1).alias("dst"), "dst_graph", F.lit("inter-procedural").alias("label"), F.lit("INTER").alias("kind")
    ).distinct()


def calls_named(g: CodeGraph, name: str, vulnerability: str, with_params: bool = False) -> DataFrame:
    """CALL nodes of a name (and with arguments), as sinks."""
    found = algebra.where_exists(_kind(g, "CALL"), _child(g, "NAME", name), ["file", "id"])
    if with_params:
        found = algebra.where_exists(found, _child(g, "PARAMS"), ["file", "id"])
    return found.select("file", "id", "line", "shared_id", F.col("args").alias("args"), F.lit(name).alias("sink_text"), F.lit(vulnerability).alias("vulnerability"), F.element_at("args", 1).alias("checkpoint"))


def create_query(g: CodeGraph) -> DataFrame:
    return calls_named(g, "createQuery", "SQL")


def execute_query(g: CodeGraph) -> DataFrame:
    return calls_named(g, "executeQuery", "SQL", True)


def save_calls(g: CodeGraph) -> DataFrame:
    return calls_named(g, "save", "XSS")


def exec_calls(g: CodeGraph) -> DataFrame:
    return calls_named(g, "exec", "CI")


def method_calls(g: CodeGraph, package: str, cls: str, method: str) -> DataFrame:
    """CALL nodes of a name below a class of a package (sinks and sources by qualified name)."""
    files = _kind(g, "PACKAGE").where(F.col("code") == package).select("file")
    classes = algebra.where_exists(_kind(g, "CLASS"), _child(g, "NAME", cls), ["file", "id"]).join(files, "file", "left_semi")
    return algebra.descendants(classes, _kind(g, "CALL").where(F.col("name") == method)).select("file", "id", "line", "shared_id", "args")


def assigned(g: CodeGraph, name: str) -> DataFrame:
    """Nodes of a code below ASSIGN_LEFT with the text that is assigned."""
    nodes = g.ast.where(F.col("code") == name).select("file", "id", "last_id")
    left = algebra.nearest_ancestor(nodes, _kind(g, "ASSIGN_LEFT")).where("ancestor IS NOT NULL")
    top = algebra.nearest_ancestor(nodes, _kind(g, "ASSIGN")).withColumnRenamed("ancestor", "top")
    text = _kind(g, "ASSIGN").select("file", F.col("id").alias("top"), F.col("text").alias("checkpoint"))
    return left.join(top, ["file", "id"]).join(text, ["file", "top"]).select("file", "id", "checkpoint", F.lit("XSS").alias("vulnerability"))


def arguments_named(g: CodeGraph, name: str) -> DataFrame:
    """Nodes of a code that are call arguments."""
    return algebra.where_exists(g.ast.where(F.col("code") == name), _kind(g, "PARAMS").select("file", F.col("id").alias("parent")), ["file", "parent"]).select("file", "id", "line", "shared_id")


_ROUTES = ("PostMapping", "GetMapping", "RequestMapping")


def spring_routes(g: CodeGraph) -> DataFrame:
    """``(class, method, route, params)`` of the mapped methods of controllers; quotes are kept."""
    control = g.annotations.where(F.col("graph").isNull() & F.col("name").isin("Controller", "RestController")).select("qn").distinct()
    mapped = g.annotations.where(F.col("graph").isNotNull() & F.col("name").isin(*_ROUTES)).join(control, "qn", "left_semi")
    first = mapped.groupBy("qn", "graph").agg(F.min_by("values", "id").alias("values"))
    asked = g.parameters.where(F.exists("annotations", lambda a: a.startswith("RequestParam("))).groupBy("graph").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda p: p["name"]).alias("params")
    )
    methods = g.methods.select("graph", F.col("name").alias("method"))
    return first.join(methods, "graph").join(asked, "graph", "left").select(
        F.col("qn").alias("class"), "method", F.get("values", F.lit(0)).alias("route"), F.coalesce("params", F.array().cast("array<string>")).alias("params"), "graph"
    )


def taint_flows(g: CodeGraph, sources: DataFrame, sinks: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Sources, data-flow nodes (graph, id), that reach sinks (file, id, vulnerability, checkpoint) over data-flow edges.

    A sink is the data-flow node whose statement is its nearest ancestor; one
    closure from all sources, then an equi-join; the first vulnerability of a
    pair wins.
    """
    flows = data_flow(g) if flows is None else flows
    ends = sinks.select("file", "id", "vulnerability", "checkpoint").join(flow_node(g, sinks), ["file", "id"]).where("df IS NOT NULL").select(
        F.struct("graph", F.col("df").alias("id")).alias("sink"), "vulnerability", "checkpoint", F.col("id").alias("seq")
    )
    edges = flows.select(F.struct("graph", F.col("src").alias("id")).alias("src"), F.struct(F.col("dst_graph").alias("graph"), F.col("dst").alias("id")).alias("dst"))
    starts = sources.select(F.struct("graph", "id").alias("id")).distinct()
    pairs = closure.reachable_pairs(edges, starts, ends.select(F.col("sink").alias("id")).distinct())
    found = algebra.keep_first(pairs.join(ends, "sink"), ["source", "sink"], ["seq"])
    return found.select(
        F.col("source.graph").alias("source_graph"), F.col("source.id").alias("source_id"), F.col("sink.graph").alias("sink_graph"), F.col("sink.id").alias("sink_id"), "vulnerability", "checkpoint"
    )


def flow_node(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """``(file, id, graph, df)``: the data-flow node of each syntax node or of its nearest ancestor that has one; null if none has."""
    return _nearest(g, nodes, g.dfg.select("file", "shared_id", "graph", F.col("id").alias("df")), "df")


def control_node(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """``(file, id, graph, cf)``: likewise the control-flow node."""
    return _nearest(g, nodes, g.cfg.where("shared_id IS NOT NULL").select("file", "shared_id", "graph", F.col("id").alias("cf")), "cf")


def _nearest(g: CodeGraph, nodes: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    marked = g.ast.join(placed, ["file", "shared_id"]).select("file", F.col("id").alias("at"), "last_id", "graph", name)
    own = nodes.select("file", "id").distinct()
    near = own.alias("s").join(marked.alias("m"), F.expr("s.file = m.file AND s.id >= m.at AND s.id <= m.last_id"), "left")
    best = near.groupBy("s.file", "s.id").agg(F.max(F.struct("m.at", "m.graph", f"m.{name}")).alias("n"))
    return best.select("file", "id", "n.graph", f"n.{name}")


def calls(g: CodeGraph, name: str | None = None) -> DataFrame:
    """CALL nodes, by simple or dotted name if one is given: ``(file, id, line, name, dotted, args)``."""
    found = _kind(g, "CALL").select("file", "id", "line", "name", F.coalesce("text", "name").alias("dotted"), "args")
    return found if name is None else found.where((F.col("name") == name) | (F.col("dotted") == name))


def get_method(g: CodeGraph, qn: str, name: str) -> DataFrame:
    """The first method of a name in a class."""
    return algebra.keep_first(g.methods.where((F.col("qn") == qn) & (F.col("name") == name)), ["qn", "name"], ["id"])


def class_by_name(g: CodeGraph, name: str) -> DataFrame:
    """Classes of a simple name."""
    return g.classes.where(F.col("name") == name)


def graphs_of_file(g: CodeGraph, file: str) -> DataFrame:
    """``(graph, nodes)`` of the control-flow graphs of a file."""
    return g.cfg.where(F.col("file") == file).groupBy("graph").agg(F.count("*").alias("nodes"))


def node(g: CodeGraph, kind: str, key: str, number: int) -> DataFrame:
    """The node of a file's syntax tree (``ast``) or a method's control flow (``cfg``) or data flow (``dfg``); no row if there is none."""
    table, by = {"ast": (g.ast, "file"), "cfg": (g.cfg, "graph"), "dfg": (g.dfg, "graph")}[kind]
    return table.where((F.col(by) == key) & (F.col("id") == number))


def plot(g: CodeGraph, kind: str) -> DataFrame:
    """Graphviz texts: of files' syntax trees, of methods' control flow with its kinds, of data flow.

    Edges of a tree are green; data flow shows the control flow as grey dashes and its own edges teal,
    flows to other methods are hidden.
    """
    if kind == "ast":
        text = F.when(F.col("code") == "", F.col("kind")).otherwise(F.concat("kind", F.lit(": "), "code"))
        tree = g.ast_edges.select("file", "src", "dst", F.lit('color="green"').alias("style"))
        return algebra.dot_text(g.ast.select("file", "id", text.alias("code")), tree, "file")
    if kind == "cfg":
        return algebra.dot_text(g.cfg, g.cfg_edges, "graph")
    placed = g.dfg.select("graph", "id", "cfg_id")
    end = lambda c: placed.select("graph", F.col("cfg_id").alias(c), F.col("id").alias(f"{c}_df"))
    control = g.cfg_edges.join(end("src"), ["graph", "src"]).join(end("dst"), ["graph", "dst"]).select(
        "graph", F.col("src_df").alias("src"), F.col("dst_df").alias("dst"), "label", F.lit('color="grey" style="dashed"').alias("style")
    )
    data = g.flows.select("graph", "src", "dst", "label", F.lit('color="teal"').alias("style"))
    return algebra.dot_text(g.dfg.select("graph", "id", "code"), control.union(data), "graph")


def returns(g: CodeGraph) -> DataFrame:
    """Nodes that are return statements with a value."""
    return _kind(g, "RETURN").select("file", "id", "line")


def first_call(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """``(file, id, call)``: the name of the first call in each subtree, by depth and id; null without one."""
    c = _kind(g, "CALL").select(F.col("file").alias("f"), F.col("id").alias("c"), "depth", "name")
    own = nodes.select("file", "id", "last_id")
    met = own.join(c, (own["file"] == c["f"]) & (c["c"] >= own["id"]) & (c["c"] <= own["last_id"]), "left")
    return met.groupBy("file", "id").agg(F.min_by("name", F.struct("depth", "c")).alias("call"))


def flows_from(flows: DataFrame, graph: str, node: int) -> DataFrame:
    """Data-flow edges that leave a node."""
    return flows.where((F.col("graph") == graph) & (F.col("src") == node))


def flow_targets(g: CodeGraph, flows: DataFrame, graph: str, node: int, call: str) -> DataFrame:
    """``(graph, id)``: targets of the data-flow edges that leave a node whose syntax subtree holds the call of a shared id."""
    ends = flows_from(flows, graph, node).select(F.col("dst_graph").alias("graph"), F.col("dst").alias("id")).distinct()
    at = g.dfg.select("file", "graph", "id", "shared_id").join(ends, ["graph", "id"])
    tops = g.ast.select("file", "shared_id", F.col("id").alias("top"), "last_id").join(at, ["file", "shared_id"])
    found = g.ast.where(F.col("shared_id") == call).select(F.col("file").alias("f"), F.col("id").alias("c"))
    return tops.join(found, (tops["file"] == found["f"]) & (found["c"] >= tops["top"]) & (found["c"] <= tops["last_id"]), "left_semi").select("graph", "id").distinct()


def initial_subgraph(g: CodeGraph, shared_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that control reaches from the node of a shared id, renumbered from 1 in order of ids."""
    start = g.cfg.where(F.col("shared_id") == shared_id).select("file", "graph", "id")
    key = F.struct("file", "graph", "id").alias("id")
    edges = g.cfg_edges.select("file", "graph", F.struct("file", "graph", F.col("src").alias("id")).alias("src"), F.struct("file", "graph", F.col("dst").alias("id")).alias("dst"), "label")
    seen = closure.reach(edges, start.select(key)).select("node.*").union(start).distinct()
    order = Window.partitionBy("file", "graph").orderBy("id")
    number = seen.withColumn("n", F.row_number().over(order))
    nodes = g.cfg.join(number, ["file", "graph", "id"]).select("graph", F.col("n").alias("id"), "kind", "code", "line")
    end = lambda c: number.select(key.alias(c), F.col("n").alias(f"{c}_n"))
    kept = edges.join(end("src"), "src").join(end("dst"), "dst")
    return nodes, kept.select("graph", F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "label")


def control_paths(g: CodeGraph, graph: str, start: int, end: int, most: int | None = None) -> DataFrame:
    """All simple control-flow paths between two nodes of a method, as arrays of ids; of up to ``most`` nodes if given."""
    edges = g.cfg_edges.where(F.col("graph") == graph).select("src", "dst")
    # paths end at their first visit of the end
    return closure.simple_paths(edges.where(F.col("src") != end), start, most).where(F.element_at("path", -1) == end)


def control_subgraph(g: CodeGraph, graph: str, source: int, target: int) -> DataFrame:
    """Control-flow edges reachable from ``source`` without going on past ``target``."""
    return closure.subgraph(g.cfg_edges.where(F.col("graph") == graph).select("src", "dst", "label"), source, target)


def parameters_named(g: CodeGraph, wanted: DataFrame) -> DataFrame:
    """``(file, id, line, shared_id, text)``: the VARIABLE nodes of method parameters, the first for each row of (class, method, param).

    ``class`` is a simple or qualified name.
    """
    kids = lambda kind: g.ast.where(F.col("kind") == kind)
    name = lambda as_: _child(g, "NAME").withColumnRenamed("child_code", as_)
    classes = kids("CLASS").join(name("cls"), ["file", "id"]).select("file", F.col("id").alias("c_id"), "cls")
    methods = kids("METHOD").join(name("method"), ["file", "id"]).select("file", F.col("id").alias("m_id"), F.col("parent").alias("c_id"), "method")
    params = kids("PARAMS").select("file", F.col("id").alias("p_id"), F.col("parent").alias("m_id"))
    own = kids("VARIABLE").join(name("param"), ["file", "id"]).select("file", "id", F.col("parent").alias("p_id"), "line", "shared_id", "param")
    every = own.join(params, ["file", "p_id"]).join(methods, ["file", "m_id"]).join(classes, ["file", "c_id"])
    asked = wanted.select(scalar.last_segment(F.col("class")).alias("cls"), "method", "param").distinct()
    first = algebra.keep_first(every.join(asked, ["cls", "method", "param"]), ["cls", "method", "param"], ["file", "id"])
    return first.select("file", "id", "line", "shared_id", F.concat(F.lit('Parameter "'), "param", F.lit('" of method "'), "method", F.lit('"')).alias("text"))


def spring_sources(g: CodeGraph) -> DataFrame:
    """The request parameters of routes."""
    return parameters_named(g, spring_routes(g).select("class", "method", F.explode("params").alias("param")))


def placed(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """``(graph, id)``: the data-flow nodes of syntax nodes."""
    return flow_node(g, nodes).where("df IS NOT NULL").select("graph", F.col("df").alias("id")).distinct()


def super_classes(g: CodeGraph) -> DataFrame:
    """``(qn, ancestor)``: every class's ancestors by simple name, parents looked up in the same package."""
    package = F.regexp_replace("qn", r"\.[^.]*$", "")
    c = g.classes.select("qn", F.col("extends").alias("parent"), F.concat_ws(".", package, "extends").alias("parent_qn")).where("parent IS NOT NULL")
    direct = c.select("qn", F.col("parent").alias("ancestor"))
    edges = c.select(F.col("qn").alias("src"), F.col("parent_qn").alias("dst"))
    far = closure.reach(edges, c.select(F.col("qn").alias("id"))).join(c.select(F.col("qn").alias("node"), "parent"), "node").select(F.col("source").alias("qn"), F.col("parent").alias("ancestor"))
    return direct.union(far).distinct()


def _action_fields(g: CodeGraph, base: str) -> DataFrame:
    """``(qn, name, accessor)`` of the fields of action classes; accessor is the name without get or set."""
    actions = super_classes(g).where(F.col("ancestor") == base).select("qn").distinct()
    return g.fields.join(actions, "qn", "left_semi").select("qn", "name", scalar.capitalise(F.col("name")).alias("accessor"))


def _calls_by_class(g: CodeGraph, wanted: DataFrame) -> DataFrame:
    """CALL nodes named ``name`` below the top-level class ``qn``, for rows of (qn, name)."""
    package = _kind(g, "PACKAGE").select("file", F.col("code").alias("package"))
    classes = _kind(g, "CLASS").join(_child(g, "NAME"), ["file", "id"]).where("depth = 1").join(package, "file")
    at = classes.select("file", F.concat_ws(".", "package", "child_code").alias("qn"), F.col("id").alias("c_id"), F.col("last_id").alias("c_last"))
    calls = _kind(g, "CALL").select("file", "id", "line", "shared_id", "name", "args")
    met = calls.join(at.join(wanted, "qn").withColumnRenamed("name", "wanted"), "file")
    return met.where("id > c_id AND id <= c_last AND name = wanted").select("file", "id", "line", "shared_id", "name", "args")


def struts_sources(g: CodeGraph, base: str = "ActionSupport") -> DataFrame:
    """``(file, id, line, shared_id, text)``: getter calls in action classes, and their fields' names as arguments; each node once."""
    fields = _action_fields(g, base)
    getters = _calls_by_class(g, fields.select("qn", F.concat(F.lit("get"), "accessor").alias("name")))
    called = getters.select("file", "id", "line", "shared_id", F.concat(F.lit('Call of method "'), "name", F.lit('"')).alias("text"), F.lit(0).alias("seq"))
    names = fields.select(F.col("name").alias("code")).distinct()
    params = algebra.where_exists(g.ast.join(names, "code"), _kind(g, "PARAMS").select("file", F.col("id").alias("parent")), ["file", "parent"])
    passed = params.select("file", "id", "line", "shared_id", F.concat(F.lit('Parameter "'), "code", F.lit('"')).alias("text"), F.lit(1).alias("seq"))
    return _once(called.union(passed))


def _once(nodes: DataFrame) -> DataFrame:
    """The first row of each syntax node."""
    return algebra.keep_first(nodes, ["file", "shared_id"], ["seq", "id"]).drop("seq")


def sources(g: CodeGraph, framework: str) -> DataFrame:
    """Taint sources of a web framework, ``Struts2`` or ``SpringMVC``, as syntax nodes."""
    if framework == "Struts2":
        return struts_sources(g)
    if framework == "SpringMVC":
        return _once(spring_sources(g).withColumn("seq", F.lit(0)))
    raise ValueError(f"no sources are known for {framework}")


def sinks(g: CodeGraph, framework: str, base: str = "ActionSupport", assigned_name: str = "products") -> DataFrame:
    """``(file, id, line, shared_id, sink_text, vulnerability, checkpoint)``: taint sinks, each syntax node once.

    Struts2: queries made, setters called in action classes, assignments to ``assigned_name`` if there
    is such a class with a field, saves and commands; SpringMVC: queries run.
    """
    columns = ["file", "id", "line", "shared_id", "sink_text", "vulnerability", "checkpoint"]
    if framework == "SpringMVC":
        return _once(execute_query(g).select(*columns, F.lit(0).alias("seq")))
    if framework != "Struts2":
        raise ValueError(f"no sinks are known for {framework}")
    fields = _action_fields(g, base)
    setters = _calls_by_class(g, fields.select("qn", F.concat(F.lit("set"), "accessor").alias("name")))
    text = F.concat(F.lit('Call of method "'), "name", F.lit('"')).alias("sink_text")
    found = create_query(g).select(*columns, F.lit(0).alias("seq")).union(
        setters.select("file", "id", "line", "shared_id", text, F.lit("XSS").alias("vulnerability"), F.get("args", F.lit(0)).alias("checkpoint"), F.lit(1).alias("seq"))
    )
    any_field = fields.select(F.lit(1).alias("one")).limit(1)
    left = assigned(g, assigned_name).join(g.ast.select("file", "id", "line", "shared_id"), ["file", "id"]).join(F.broadcast(any_field))
    found = found.union(left.select("file", "id", "line", "shared_id", F.lit(f'Variable "{assigned_name}" assignment').alias("sink_text"), "vulnerability", "checkpoint", F.lit(2).alias("seq")))
    for k, more in enumerate((save_calls(g), exec_calls(g)), 3):
        found = found.union(more.select(*columns, F.lit(k).alias("seq")))
    return _once(found)


def login_names(g: CodeGraph, name: str = "getLogin") -> DataFrame:
    """NAME nodes of the calls of a name."""
    names = _kind(g, "NAME").where(F.col("code") == name)
    return algebra.where_exists(names, _kind(g, "CALL").select("file", F.col("id").alias("parent")), ["file", "parent"]).select("file", "id", "line", "shared_id")


def method_names(g: CodeGraph) -> DataFrame:
    """``(file, name)`` of every METHOD node."""
    return _kind(g, "METHOD").select("file", "id").join(_child(g, "NAME"), ["file", "id"]).select("file", F.col("child_code").alias("name"))


def tag_attributes(pages: DataFrame, id_col: str, text_col: str, tag: str, attribute: str) -> DataFrame:
    """``(id, value)`` of an attribute, in double quotes or single ones, of every tag of a name that has it."""
    values = F.regexp_extract_all(text_col, F.lit(rf"""(?is)<{tag}\b[^>]*?\b{attribute}=["']([^"']*)["']"""), F.lit(1))
    return pages.select(id_col, F.explode(values).alias("value"))


def views(spark, folder: str, suffix: str) -> DataFrame:
    """``(path, text)`` of every file of a suffix below a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def html_forms(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, action, method, params)`` of each form, in order."""
    form = F.posexplode(F.regexp_extract_all(text_col, F.lit(r"(?is)(<form\b.*?</form>)"), F.lit(1)))
    each = pages.select(id_col, form.alias("k", "form"))
    attr = lambda name: F.regexp_extract("form", rf"""(?is)^<form\b[^>]*?\b{name}=["']([^"']*)["']""", 1)
    return each.select(id_col, "k", attr("action").alias("action"), attr("method").alias("method"), F.regexp_extract_all("form", F.lit(r"""(?is)<input\b[^>]*?\bname=["']([^"']*)["']"""), F.lit(1)).alias("params"))


def jsp_forms(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, k, action, names)`` of each Struts form; names by tag: textfield, password, textarea, hidden."""
    form = F.posexplode(F.regexp_extract_all(text_col, F.lit(r"(?s)(<s:form\b.*?</s:form>)"), F.lit(1)))
    each = pages.select(id_col, form.alias("k", "form"))
    names: list[Column] = [F.regexp_extract_all("form", F.lit(rf'(?s)<s:{t}\b[^>]*?\bname="([^"]*)"'), F.lit(1)) for t in ("textfield", "password", "textarea", "hidden")]
    return each.select(id_col, "k", F.regexp_extract("form", r'(?s)^<s:form\b[^>]*?\baction="([^"]*)"', 1).alias("action"), F.concat(*names).alias("names"))


def struts_actions(spark, paths: str | list[str]) -> DataFrame:
    """``(action, class, method)`` of route files and of the files they include; later files win.

    A plain name is of package ``default``.  An included file is looked up as it is named and else beside the
    including file; its own includes are not followed.
    """
    schema = "_name string, action array<struct<_name string, _class string, _method string>>"
    read = lambda path, tag, of: spark.read.format("xml").option("rowTag", tag).schema(of).load(path)
    out, k = None, 0
    for path in [paths] if isinstance(paths, str) else paths:
        included = [r[0] for r in read(path, "include", "_file string").collect() if r[0]]  # a few names
        for each in [path, *(f if _exists(spark, f) else f"{path.rpartition('/')[0]}/{f}" for f in included)]:
            a = read(each, "package", schema).select(F.col("_name").alias("package"), F.posexplode("action").alias("pos", "a")).select(
                F.when(F.col("package") == "default", F.col("a._name")).otherwise(F.concat_ws(".", "package", "a._name")).alias("action"),
                F.col("a._class").alias("class"), F.col("a._method").alias("method"), F.lit(k).alias("k"), "pos",
            )
            out, k = a if out is None else out.union(a), k + 1
    return algebra.keep_last(out, ["action"], ["k", "pos"]).drop("k", "pos")


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
