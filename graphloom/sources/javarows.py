"""Rows of the program graphs of one Java file: syntax tree, control flow, facts, classes.

Every row is a dict with the columns of ``COLUMNS``; ``rel`` names its table.
Tree ids are pre-order, so a subtree is the interval [id, last_id].
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from graphloom.functions.flow import reaching
from graphloom.sources.javasyntax import JavaSyntaxError, N, Parser, parse

COLUMNS = (
    "rel string, file string, graph string, id int, parent int, last_id int, depth int, src int, dst int, label string, "
    "kind string, line int, code string, shared_id string, name string, type string, owner string, args array<string>, "
    "text string, defs array<string>, uses array<string>, values array<string>"
)
_BLANK = {c.split()[0]: None for c in COLUMNS.split(", ")}

#: The syntax context that a node's shared id is computed from.
CONTEXT = {
    "if": "StmtIfContext", "while": "StmtWhileContext", "do": "StmtDoWhileContext", "for": "StmtForContext", "foreach": "StmtForContext",
    "return": "StmtReturnContext", "throw": "StmtThrowContext", "break": "StmtBreakContext", "continue": "StmtContinueContext",
    "expression": "StmtExprContext", "switch": "StmtSwitchContext", "try": "StmtTryContext", "synchronized": "StmtSynchronizedContext",
    "labeled": "StmtLabelContext", "method": "MethodDeclarationContext", "constructor": "ConstructorDeclarationContext",
    "declarator": "VariableDeclaratorContext", "local": "LocalVariableDeclarationContext", "parameter": "FormalParameterContext",
    "call": "MethodCallContext", "dot": "ExprDotContext", "assign": "ExprAssignContext", "class": "ClassDeclarationContext",
    "catch": "CatchClauseContext", "resource": "ResourceContext", "name": "TerminalNodeImpl", "literal": "LiteralContext",
    "block": "BlockContext", "finally": "FinallyBlockContext", "label": "SwitchLabelContext", "each": "EnhancedForControlContext",
    "array": "ExprArrayContext", "cast": "ExprCastingContext", "ternary": "ExprTernaryContext", "postfix": "ExprPostUnaryOpContext",
    "import": "ImportDeclarationContext", "package": "PackageDeclarationContext", "field": "FieldDeclarationContext", "type": "TypeTypeContext",
}
_STATE = re.compile("set|put|add|insert|push|append", re.I)


class Source:
    """Text and ids of syntax nodes."""

    def __init__(self, parser: Parser, file: str, compat: bool = False):
        self.p, self.file, self.compat = parser, file, compat

    def span(self, a: int, b: int) -> str:
        return self.p.text[self.p.toks[a].start : self.p.toks[b].stop + 1] if b >= a else ""

    def text(self, n: N) -> str:
        """The source slice."""
        return self.span(n.first, n.last)

    def joined(self, n: N | None) -> str:
        """The tokens without white space."""
        return "" if n is None else "".join(t.text for t in self.p.toks[n.first : n.last + 1])

    def line(self, n: N) -> int:
        return self.p.toks[n.first].line

    def shared(self, n: N) -> str:
        kind = CONTEXT.get(n.kind, n.kind.title().replace("_", "") + "Context")
        return hashlib.md5(f"{kind}{self.p.toks[n.first].start}{self.p.toks[n.last].stop}".encode()).hexdigest()


# -- syntax tree
class Tree:
    def __init__(self, s: Source):
        self.s, self.rows = s, []

    def add(self, parent: int, kind: str, code: str = "", at: N | None = None, **more) -> int:
        up = self.rows[parent - 1] if parent else None
        self.rows.append(
            _BLANK | {"rel": "ast", "file": self.s.file, "id": len(self.rows) + 1, "parent": parent or None, "depth": up["depth"] + 1 if up else 0, "kind": kind, "code": code,
                      "line": self.s.line(at) if at else None, "shared_id": self.s.shared(at) if at else None} | more
        )
        return len(self.rows)

    def build(self, unit: N) -> list[dict]:
        root = self.add(0, "ROOT", "Filename")
        if unit.package:
            self.add(root, "PACKAGE", unit.package.name, unit.package)
        for i in unit.imports:
            self.add(root, "IMPORT", i.name, i)
        for t in unit.types:
            self.type(root, t)
        for r in reversed(self.rows):
            r["last_id"] = max(r["last_id"] or 0, r["id"])
            if r["parent"]:
                up = self.rows[r["parent"] - 1]
                up["last_id"] = max(up["last_id"] or 0, r["last_id"])
        return self.rows

    def type(self, parent: int, t: N) -> None:
        if t.kind == "class":
            at = self.add(parent, "CLASS", "", t)
            self.add(at, "MODIFIER", " ".join(t.modifiers))
            self.add(at, "NAME", t.name)
            if t.extends:
                self.add(at, "EXTENDS", self.s.joined(t.extends), t.extends)
            if t.implements:
                faces = self.add(at, "IMPLEMENTS")
                for f in t.implements:
                    self.add(faces, "INTERFACE", self.s.joined(f), f)
            parent = at
        for m in t.body or []:
            self.member(parent, m)

    def member(self, parent: int, m: N) -> None:
        if m.kind == "initializer":
            self.block(self.add(parent, "STATIC_BLOCK", "", m) if m.static else parent, m.body)
        elif m.kind == "field":
            at = self.add(parent, "FIELD", "", m)
            for v in m.vars:
                self.add(at, "MODIFIER", " ".join(m.modifiers))
                self.variable(at, m.type, v)
        elif m.kind in ("method", "constructor"):
            at = self.add(parent, m.kind.upper(), "", m)
            self.add(at, "MODIFIER", " ".join(m.modifiers))
            if m.kind == "method":
                self.add(at, "RET_VAL_TYPE", self.s.joined(m.type), m.type)
                self.add(at, "NAME", m.name)
            if m.args:
                params = self.add(at, "PARAMS")
                for a in m.args:
                    v = self.add(params, "VARIABLE", "", a)
                    self.add(v, "TYPE", self.s.joined(a.type), a.type)
                    self.add(v, "NAME", a.name)
            if m.body:
                self.block(self.add(at, "BLOCK", "", m.body), m.body)
        else:
            self.type(parent, m)

    def variable(self, at: int, kind: N, v: N) -> None:
        self.add(at, "TYPE", self.s.joined(kind), kind)
        self.add(at, "NAME", v.name, v)
        if v.init:
            self.expr(self.add(at, "INIT_VALUE", "=", v.init), v.init)

    def block(self, parent: int, b: N) -> None:
        for x in b.body if b.kind == "block" else [b]:
            self.statement(parent, x)

    def statement(self, parent: int, n: N) -> None:
        k, add = n.kind, self.add
        if k == "local":
            for v in n.vars:
                self.variable(add(parent, "VARIABLE", "", v), n.type, v)
        elif k == "expression":
            self.expr(add(parent, "STATEMENT", "", n), n.expr)
        elif k in ("break", "continue"):
            add(parent, "STATEMENT", self.s.text(n), n)
        elif k == "return" and not n.expr:
            add(parent, "STATEMENT", self.s.text(n), n)
        elif k == "return":
            self.expr(add(parent, "RETURN", "", n), n.expr)
        elif k == "throw":
            self.expr(add(parent, "STATEMENT", self.s.text(n), n), n.expr)
        elif k == "synchronized":
            at = add(parent, "SYNC", "", n)
            self.expr(add(at, "STATEMENT", self.s.text(n.cond), n.cond), n.cond)
            self.block(add(at, "BLOCK", "", n.body), n.body)
        elif k == "labeled":
            at = add(parent, "LABELED", "", n)
            add(at, "NAME", n.label)
            self.statement(at, n.body)
        elif k == "if":
            at = add(parent, "IF", "", n)
            self.expr(add(at, "CONDITION", "", n.cond), n.cond)
            self.block(add(at, "THEN", "", n.then), n.then)
            if n.other:
                self.block(add(at, "ELSE", "", n.other), n.other)
        elif k == "foreach":
            at = add(parent, "FOR_EACH", "", n)
            add(at, "TYPE", self.s.joined(n.head.type), n.head.type)
            add(at, "NAME", n.head.name)
            self.expr(add(at, "FOR_IN", "", n.head), n.head.expr)
            self.block(add(at, "BLOCK", "", n.body), n.body)
        elif k == "for":
            at = add(parent, "FOR", "", n)
            if n.init:
                init = add(at, "FOR_INIT", "", n.init)
                if n.init.kind == "local":
                    self.statement(init, n.init)
                else:
                    for e in n.init.items:
                        self.expr(init, e)
            if n.cond:
                self.expr(add(at, "CONDITION", "", n.cond), n.cond)
            if n.update:
                update = add(at, "FOR_UPDATE", "", n.update)
                for e in n.update.items:
                    self.expr(add(update, "STATEMENT", "", e), e)
            self.block(add(at, "BLOCK", "", n.body), n.body)
        elif k == "while":
            at = add(parent, "WHILE", "", n)
            self.expr(add(at, "CONDITION", "", n.cond), n.cond)
            self.block(add(at, "BLOCK", "", n.body), n.body)
        elif k == "do":
            at = add(parent, "DO_WHILE", "", n)
            add(at, "CONDITION", self.s.text(n.cond), n.cond)
            self.block(add(at, "BLOCK", "", n.body), n.body)
        elif k == "try":
            at = add(parent, "TRY", "", n)
            if n.resources:
                rs = add(at, "RESOURCES")
                for r in n.resources:
                    add(rs, "VARIABLE", "", r)
                    add(rs, "TYPE", self.s.joined(r.type), r.type)
                    add(rs, "NAME", r.name)
                    self.expr(add(rs, "INIT_VALUE", "=", r), r.expr)
            self.block(add(at, "BLOCK", "", n.body), n.body)
            for c in n.catches:
                own = add(at, "CATCH", "", c)
                add(own, "TYPE", self.s.joined(c.type), c.type)
                add(own, "NAME", c.name)
                self.block(add(own, "BLOCK", "", c.body), c.body)
            if n.final:
                self.block(add(at, "FINALLY", "", n.final), n.final.body)
        elif k == "switch":
            at = add(parent, "SWITCH", "", n)
            add(at, "NAME", self.s.text(n.cond.expr), n.cond)
            for g in n.groups:
                for lab in g.labels:
                    add(at, "DEFAULT" if lab.default else "CASE", "" if lab.default else self.s.text(lab.value), lab)
                own = add(at, "BLOCK", "", g)
                for x in g.body:
                    self.statement(own, x)
        elif k in ("class", "interface", "enum"):
            self.type(parent, n)
        elif k == "block":
            self.block(parent, n)
        elif k == "assert":
            self.expr(parent, n.expr)
        elif k != "empty":
            add(parent, "STATEMENT", self.s.text(n), n)

    def path(self, n: N) -> str:
        """Names of an access path, joined by dots, without arguments and indexes."""
        if n.kind in ("name", "call"):
            return n.name
        if n.kind == "dot":
            return f"{self.path(n.left)}.{self.path(n.right)}"
        if n.kind == "array":
            return self.path(n.left)
        return self.path(n.expr) if n.kind == "paren" else self.s.joined(n)

    def expr(self, parent: int, n: N) -> None:
        k, add = n.kind, self.add
        if k == "paren":
            self.expr(parent, n.expr)
        elif k == "name":
            add(parent, "NAME", n.name, n)
        elif k == "literal":
            add(parent, "LITERAL", self.s.text(n), n)
        elif k == "dot":
            at = add(parent, "DOT", "", n, text=self.path(n))
            self.expr(at, n.left)
            self.expr(at, n.right)
            for r in self.rows[at:]:  # a call at the end of the path is known by all of it
                if n.right.kind == "call" and r["kind"] == "CALL" and r["parent"] == at and r["name"] == n.right.name:
                    r["text"] = self.path(n)
        elif k == "array":
            at = add(parent, "ARRAY", "", n)
            self.expr(at, n.left)
            self.expr(at, n.index)
        elif k == "call":
            args = [self.s.text(a) for a in n.args]
            at = add(parent, "CALL", "", n, name=n.name, args=args)
            add(at, "NAME", n.name, N("name", n.first, n.first))
            if n.args:
                params = add(at, "PARAMS", "", n.args[0])
                for a in n.args:
                    self.expr(params, a)
        elif k == "new":
            if n.args:
                own = add(parent, "ARGS", "", n)
                for a in n.args:
                    self.expr(own, a)
            for m in n.body or []:
                self.member(parent, m)
        elif k == "new_array":
            for e in n.sizes:
                self.expr(parent, e)
            if n.init:
                self.expr(parent, n.init)
        elif k == "cast":
            at = add(parent, "CAST", "", n)
            add(at, "TYPE", self.s.joined(n.type), n.type)
            self.expr(at, n.expr)
        elif k in ("postfix", "unary"):
            self.expr(add(parent, "UNARY", n.op, n), n.expr)
        elif k == "binary":
            shift = n.op in ("<<", ">>", ">>>") and self.s.compat
            at = add(parent, "BOP", n.op[0] if shift else n.op, n)
            self.expr(at, n.left)
            self.expr(at, n.right)
        elif k == "instanceof":
            at = add(parent, "BOP", "instanceof", n)
            self.expr(at, n.left)
            add(at, "TYPE", self.s.joined(n.type), n.type)
        elif k == "ternary":
            at = add(parent, "TERNARY", "", n)
            for kind, e in (("TERNARY_PREDICATE", n.cond), ("TERNARY_TRUE", n.then), ("TERNARY_FALSE", n.other)):
                self.expr(add(parent if self.s.compat else at, kind, "", e), e)
        elif k == "assign":
            at = add(parent, "ASSIGN", "", n, text=self.s.text(n.right))
            self.expr(add(at, "ASSIGN_LEFT", "", n.left), n.left)
            self.expr(add(at, "ASSIGN_RIGHT", "", n.right), n.right)
        elif k == "array_init":
            at = add(parent, "ARRAY_INIT", "", n)
            for e in n.items:
                self.expr(at, e)
        elif k == "lambda":
            (self.block if n.body.kind == "block" else self.expr)(parent, n.body)


# -- definitions and uses
class Facts:
    """Defined and used variables, and calls, of an expression."""

    def __init__(self, s: Source, scope: dict[str, str]):
        self.s, self.scope = s, scope
        self.defs: set[str] = set()
        self.uses: set[str] = set()
        self.calls: list[tuple[str, str | None, str | None, int]] = []  # method, receiver, its declared type, arguments
        self.self_flows: set[str] = set()

    def use(self, name: str | None) -> None:
        if name in self.scope:
            self.uses.add(name)

    def root(self, n: N) -> str | None:
        """The variable an access path starts with; ``this.x`` is x."""
        if n.kind == "paren":
            return self.root(n.expr)
        if n.kind == "name":
            return n.name
        if n.kind == "dot":
            if n.left.kind == "name" and n.left.name == "this":
                return self.root(n.right)
            return self.root(n.left)
        return self.root(n.left) if n.kind == "array" else None

    def assigned(self, n: N) -> str | None:
        """The variable that an assignment to ``n`` defines: none for an element or a part."""
        if n.kind == "paren":
            return self.assigned(n.expr)
        if n.kind == "dot" and n.left.kind == "name" and n.left.name == "this" and n.right.kind == "name":
            return n.right.name
        return n.name if n.kind == "name" else None

    def visit(self, n: N | None) -> Facts:
        if n is None:
            return self
        k = n.kind
        if k == "name":
            self.use(n.name)
        elif k == "dot":
            if n.right.kind == "call":
                root = self.root(n.left)
                self.visit(n.left)
                own = n.left.kind == "name" and n.left.name in ("this", "super")
                self.call(n.right, None if own else self.s.joined(n.left), None if own else self.scope.get(root or ""))
                if _STATE.match(n.right.name) and root in self.scope and n.left.kind in ("name", "dot"):
                    self.defs.add(root)
            else:
                self.use(self.root(n))
                if n.left.kind not in ("name", "dot"):
                    self.visit(n.left)
                if n.right.kind == "new":
                    self.visit(n.right)
        elif k == "call":
            self.call(n, None, None)
        elif k == "assign":
            name = self.assigned(n.left)
            if name in self.scope:
                self.defs.add(name)
                if n.op != "=" or self.s.compat:
                    self.uses.add(name)
            elif name is None:
                self.visit(n.left)
            self.visit(n.right)
        elif k in ("postfix", "unary"):
            self.visit(n.expr)
            silent = k == "unary" and self.s.compat
            if n.op in ("++", "--") and not silent and (name := self.assigned(n.expr)) in self.scope:
                self.defs.add(name)
                if k == "unary":
                    self.self_flows.add(name)
        elif k in ("paren", "cast"):
            self.visit(n.expr)
        elif k in ("binary", "array"):
            self.visit(n.left).visit(n.right or n.index)
        elif k == "instanceof":
            self.visit(n.left)
        elif k == "ternary":
            self.visit(n.cond).visit(n.then).visit(n.other)
        elif k == "new":
            self.calls.append(("<init>", None, self.s.joined(n.type).split("<")[0], len(n.args)))
            for a in n.args:
                self.visit(a)
        elif k in ("new_array", "array_init", "expressions"):
            for e in (n.sizes or []) + (n.items or []) + ([n.init] if n.init else []):
                self.visit(e)
        elif k == "lambda" and n.body.kind != "block":
            self.visit(n.body)
        return self

    def call(self, n: N, receiver: str | None, kind: str | None) -> None:
        self.calls.append((n.name, receiver, kind.split("<")[0] if kind else None, len(n.args)))
        for a in n.args:
            self.visit(a)


# -- control flow; its marker texts ("endif", "end-try", "finally" and the like) are fixed values
class Flow:
    """The control-flow graph of one method, with facts on its nodes.

    ``dangling`` holds the (node, label) ends that the next node joins.
    """

    def __init__(self, s: Source, graph: str, owner: str, fields: dict[str, str], compat: bool):
        self.s, self.graph, self.owner, self.compat = s, graph, owner, compat
        self.scope = dict(fields)
        self.nodes: list[dict] = []
        self.edges: dict[tuple[int, int, str], None] = {}
        self.calls: list[dict] = []
        self.dangling: list[tuple[int, str]] = []
        self.flows: list[dict] = []
        self.loops: list[tuple[int, int]] = []
        self.breaks: list[int] = []
        self.labels: dict[str, tuple[int, int]] = {}
        self.tries: list[int] = []
        self.fact_count = 0

    def node(self, kind: str, code: str, at: N | None = None, line: int = 0) -> int:
        self.nodes.append(
            _BLANK | {"rel": "cfg", "file": self.s.file, "graph": self.graph, "id": len(self.nodes) + 1, "kind": kind, "code": code,
                      "line": self.s.line(at) if at else line, "shared_id": self.s.shared(at) if at else None}
        )
        return len(self.nodes)

    def edge(self, a: int, b: int, label: str = "EPS") -> None:
        self.edges.setdefault((a, b, label))

    def join(self, to: int) -> None:
        for a, label in self.dangling:
            self.edge(a, to, label)
        self.dangling = []

    def step(self, kind: str, code: str, at: N | None = None, label: str = "EPS") -> int:
        n = self.node(kind, code, at)
        self.join(n)
        self.dangling = [(n, label)]
        return n

    def fact(self, at: int, code: str, defs: set[str], uses: set[str], calls: list = ()) -> None:
        self.fact_count += 1
        row = self.nodes[at - 1]
        self.nodes[at - 1] = row | {"defs": sorted(defs), "uses": sorted(uses), "text": code, "depth": self.fact_count}
        for name, receiver, kind, args in calls:
            self.calls.append(_BLANK | {"rel": "calls", "file": self.s.file, "graph": self.graph, "src": self.fact_count, "name": name, "owner": self.owner, "code": receiver, "type": kind, "depth": args})

    def facts(self, at: int, code: str, *parts: N | None, defs: tuple[str, ...] = ()) -> None:
        f = Facts(self.s, self.scope)
        for p in parts:
            f.visit(p)
        self.fact(at, code, f.defs | set(defs), f.uses, f.calls)
        for name in sorted(f.self_flows):
            self.flow(self.fact_count, self.fact_count, name, "SELF")

    def method(self, m: N) -> None:
        kind = self.s.joined(m.type) + " " if m.kind == "method" else ""
        code = f"{kind}{m.name}{self.s.span(*m.span)}"
        entry = self.step("ENTRY", code, m)
        self.nodes[0] |= {"name": m.name, "type": self.s.joined(m.type), "owner": self.owner}
        for a in m.args:
            self.scope[a.name] = self.s.joined(a.type)
        self.fact(entry, code, {a.name for a in m.args}, set())
        if m.body:
            self.run(m.body)

    def run(self, n: N) -> None:
        getattr(self, "_" + n.kind, self._other)(n)

    def _other(self, n: N) -> None:
        pass  # declarations, empty statements and assertions have no node

    def _block(self, n: N) -> None:
        outer = dict(self.scope)
        for x in n.body:
            self.run(x)
        self.scope = outer

    def _local(self, n: N) -> None:
        for v in n.vars:
            at = self.step("ASSIGN", f"{self.s.text(n.type)} {self.s.text(v)};", v)
            f = Facts(self.s, self.scope).visit(v.init)
            self.scope[v.name] = self.s.joined(n.type)
            self.fact(at, self.s.text(v), f.defs | ({v.name} if v.init else set()), f.uses, f.calls)

    def _expression(self, n: N) -> None:
        self.facts(self.step("EXPR", self.s.text(n), n), self.s.text(n), n.expr)

    def _if(self, n: N) -> None:
        code = f"if {self.s.text(n.cond)}"
        at = self.step("IF", code, n, "TRUE")
        self.facts(at, code, n.cond)
        self.run(n.then)
        ends = self.dangling
        self.dangling = [(at, "FALSE")]
        if n.other:
            self.run(n.other)
        self.dangling = ends + self.dangling
        self.step("IF_END", "endif")

    def _loop(self, start: int, end: int, body: N, back: int) -> None:
        self.loops.append((start, end))
        self.breaks.append(end)
        self.run(body)
        self.loops.pop()
        self.breaks.pop()
        self.join(back)

    def _while(self, n: N) -> None:
        code = f"while {self.s.text(n.cond)}"
        at = self.step("WHILE", code, n, "TRUE")
        self.facts(at, code, n.cond)
        end = self.node("WHILE_END", "endwhile")
        self.edge(at, end, "FALSE")
        self._loop(at, end, n.body, at)
        self.dangling = [(end, "EPS")]

    def _do(self, n: N) -> None:
        start = self.step("DO_WHILE", "do", n)
        code = f"while {self.s.text(n.cond)}"
        test, end = self.node("WHILE", code, n), self.node("DO_WHILE_END", "end-do-while")
        self._loop(test, end, n.body, test)
        self.facts(test, code, n.cond)
        self.edge(test, start, "TRUE")
        self.edge(test, end, "FALSE")
        self.dangling = [(end, "EPS")]

    def _foreach(self, n: N) -> None:
        outer, code = dict(self.scope), f"for ({self.s.text(n.head)})"
        at = self.step("FOR_EXPR", code, n.head, "TRUE")
        f = Facts(self.s, self.scope).visit(n.head.expr)
        self.scope[n.head.name] = self.s.joined(n.head.type)
        self.fact(at, code, f.defs | {n.head.name}, f.uses, f.calls)
        end = self.node("FOR_END", "endfor")
        self.edge(at, end, "FALSE")
        self._loop(at, end, n.body, at)
        self.dangling, self.scope = [(end, "EPS")], outer

    def _for(self, n: N) -> None:
        outer = dict(self.scope)
        code = self.s.text(n.init) if n.init else ""
        init = self.step("FOR_INIT", code, n.init)
        f = Facts(self.s, self.scope)
        for v in n.init.vars if n.init and n.init.kind == "local" else []:
            f.visit(v.init)
            self.scope[v.name] = self.s.joined(n.init.type)
            if v.init:
                f.defs.add(v.name)
        if n.init and n.init.kind == "expressions":
            f.visit(n.init)
        if n.init:
            self.fact(init, code, f.defs, f.uses, f.calls)
        test = self.step("FOR_EXPR", f"for ({self.s.text(n.cond) if n.cond else ' ; '})", n, "TRUE")
        if n.cond:
            self.facts(test, self.s.text(n.cond), n.cond)
        ends = self.dangling
        update, end = self.node("FOR_UPDATE", self.s.text(n.update) if n.update else "", n.update), self.node("FOR_END", "endfor")
        if n.update:
            self.facts(update, self.s.text(n.update), n.update)
        self.edge(update, test)
        self.edge(test, end, "FALSE")
        self.dangling = ends
        self._loop(update, end, n.body, update)
        self.dangling, self.scope = [(end, "EPS")], outer

    def _switch(self, n: N) -> None:
        code = f"switch {self.s.text(n.cond)}"
        at = self.step("SWITCH", code, n)
        self.facts(at, code, n.cond)
        end = self.node("SWITCH_END", "endswitch")
        self.breaks.append(end)
        outer = dict(self.scope)
        miss: list[tuple[int, str]] = [(at, "EPS")]  # where the next label is tested from
        default = None
        through: list[tuple[int, str]] = []
        for g in n.groups:
            hits = []
            for lab in g.labels:
                c = self.node("CASE_STMT", self.s.text(lab), lab)
                if lab.default and not self.compat:
                    default = c
                    hits.append((c, "EPS"))
                    through, keep = [], through
                    for a, label in keep:
                        self.edge(a, c, label)
                    continue
                for a, label in miss:
                    self.edge(a, c, label)
                miss = [(c, "FALSE")]
                hits.append((c, "TRUE"))
            self.dangling = hits + through
            for x in g.body:
                self.run(x)
            through = self.dangling
        for a, label in miss:
            self.edge(a, default or end, label)
        self.dangling = through
        self.join(end)
        self.breaks.pop()
        self.dangling, self.scope = [(end, "EPS")], outer

    def _labeled(self, n: N) -> None:
        at = self.step("LABEL", f"{n.label}: ", n)
        end = self.node("LABEL_END", "end-label")
        self.labels[n.label] = (at, end)
        before = len(self.nodes)
        self.label_of = (n.label, before)
        self.run(n.body)
        self.join(end)
        self.dangling = [(end, "EPS")]

    def _jump(self, n: N, kind: str, to: int | None) -> None:
        at = self.step(kind, self.s.text(n), n)
        self.dangling = []
        if to:
            self.edge(at, to)

    def _break(self, n: N) -> None:
        self._jump(n, "BREAK", self.labels[n.label][1] if n.label in self.labels else self.breaks[-1] if self.breaks else None)

    def _continue(self, n: N) -> None:
        self._jump(n, "CONTINUE", self.labels[n.label][0] if n.label in self.labels else self.loops[-1][0] if self.loops else None)

    def _return(self, n: N) -> None:
        at = self.step("RET", self.s.text(n), n)
        self.facts(at, self.s.text(n), n.expr)
        self.dangling = []

    def _throw(self, n: N) -> None:
        at = self.step("THROW", f"throw {self.s.text(n.expr)}", n)
        self.facts(at, self.s.text(n), n.expr)
        self.dangling = []
        if self.tries:
            self.edge(at, self.tries[0 if self.compat else -1], "THROWS")

    def _synchronized(self, n: N) -> None:
        code = f"synchronized {self.s.text(n.cond)}"
        self.facts(self.step("SYNC", code, n), code, n.cond)
        end = self.node("SYNC_END", "end-sync")
        self.run(n.body)
        self.join(end)
        self.dangling = [(end, "EPS")]

    def _try(self, n: N) -> None:
        outer = dict(self.scope)
        self.step("TRY", "try", n)
        for r in n.resources:
            at = self.step("RESOURCE", self.s.text(r), r)
            f = Facts(self.s, self.scope).visit(r.expr)
            self.scope[r.name] = self.s.joined(r.type)
            self.fact(at, self.s.text(r), f.defs | {r.name}, f.uses, f.calls)
        end = self.node("TRY_END", "end-try")
        self.tries.append(end)
        self.run(n.body)
        self.tries.pop()
        self.join(end)
        self.scope = dict(outer)
        final = None
        self.dangling = [(end, "EPS")]
        if n.final:
            final = self.step("FINALLY", "finally", n.final)
            self.run(n.final.body)
            self.step("FINALLY_END", "end-finally")
        after = self.dangling
        if n.catches or self.compat:
            caught = self.node("CATCH_END", "end-catch")
            for c in n.catches:
                at = self.node("CATCH", f"catch ({self.s.text(c.type)} {c.name})", c)
                self.edge(end, at, "THROWS")
                inner = dict(self.scope)
                self.scope[c.name] = self.s.joined(c.type)
                self.fact(at, f"catch ({self.s.text(c.type)} {c.name})", {c.name}, set())
                self.dangling = [(at, "EPS")]
                self.run(c.body)
                self.join(caught)
                self.scope = inner
            self.edge(caught, final or end)
        self.dangling, self.scope = after, outer

    def flow(self, src: int, dst: int, name: str, kind: str) -> None:
        self.flows.append(_BLANK | {"rel": "flow", "file": self.s.file, "graph": self.graph, "src": src, "dst": dst, "label": name, "type": kind})

    def reach(self) -> None:
        at = {r["id"]: r for r in self.nodes if r["defs"] is not None}
        edges = [(a, b) for a, b, _ in self.edges]
        for a, b, name in reaching(edges, {n: r["defs"] for n, r in at.items()}, {n: r["uses"] for n, r in at.items()}):
            self.flow(at[a]["depth"], at[b]["depth"], name, "INTRA")

    def rows(self) -> Iterator[dict]:
        self.reach()
        yield from self.flows
        yield from self.nodes
        for a, b, label in self.edges:
            yield _BLANK | {"rel": "cfg_edge", "file": self.s.file, "graph": self.graph, "src": a, "dst": b, "label": label}
        yield from self.calls


def java_rows(path: str, text: str, compat: bool = False) -> Iterator[dict]:
    """All rows of one file; one row of rel ``error`` if it can't be parsed."""
    base = path.rpartition("/")[2].removesuffix(".java")
    try:
        unit, parser = parse(text)
    except (JavaSyntaxError, RecursionError) as e:
        yield _BLANK | {"rel": "error", "file": path, "text": str(e)}
        return
    package = unit.package.name if unit.package else None
    file = f"{package}.{base}"
    s = Source(parser, file, compat)
    yield from Tree(s).build(unit)
    for t in unit.types:
        yield from _class_rows(s, t, package, t.name, compat)


def _notes(s: Source, notes: list[N]) -> list[str]:
    return [f"{a.name}({', '.join(s.text(v) for v in a.values)})" for a in notes or []]


def _class_rows(s: Source, t: N, package: str | None, name: str, compat: bool) -> Iterator[dict]:
    """Catalogue rows (class, field, method, parameter, annotation) and the methods' graphs."""
    qn = f"{package}.{name}"
    if t.kind == "class":
        yield _BLANK | {
            "rel": "class", "file": s.file, "owner": qn, "name": t.name, "type": s.joined(t.extends) or None, "line": s.line(t), "code": s.text(t),
            "args": [s.joined(x) for x in t.implements], "values": list(t.modifiers), "uses": _notes(s, t.annotations), "text": s.text(t.params) if t.params else None,
        }
    fields = {v.name: s.joined(m.type) + "[]" * v.dims for m in t.body if m.kind == "field" for v in m.vars}
    number = 0
    seen: dict[str, int] = {}
    for m in t.body:
        if m.kind == "field" and t.kind == "class":
            for v in m.vars:
                yield _BLANK | {"rel": "field", "file": s.file, "owner": qn, "name": v.name, "type": fields[v.name], "values": list(m.modifiers), "line": s.line(m)}
        elif m.kind in ("method", "constructor"):
            number += 1
            graph = f"{qn}.{m.name}"
            seen[graph] = seen.get(graph, 0) + 1
            if seen[graph] > 1:  # overloads are graphs of their own
                graph += f"#{seen[graph]}"
            if t.kind == "class":
                yield _BLANK | {
                    "rel": "method", "file": s.file, "owner": qn, "graph": graph, "id": number, "name": m.name, "type": s.joined(m.type) or None, "line": s.line(m), "shared_id": s.shared(m),
                    "args": [a.name for a in m.args], "values": list(m.modifiers), "uses": _notes(s, m.annotations),
                }
                for k, a in enumerate(m.args):
                    yield _BLANK | {"rel": "parameter", "file": s.file, "owner": qn, "graph": graph, "id": k + 1, "name": a.name, "type": s.joined(a.type), "uses": _notes(s, a.annotations)}
                for k, a in enumerate(m.annotations or []):
                    yield _BLANK | {"rel": "annotation", "file": s.file, "owner": qn, "graph": graph, "id": k, "name": a.name, "values": [s.text(v) for v in a.values]}
            if m.body:
                flow = Flow(s, graph, qn, fields, compat)
                flow.method(m)
                yield from flow.rows()
        elif m.kind in ("class", "interface", "enum"):
            yield from _class_rows(s, m, package, f"{name}.{m.name}", compat)
    for k, a in enumerate((t.annotations or []) if t.kind == "class" else []):
        yield _BLANK | {"rel": "annotation", "file": s.file, "owner": qn, "id": k, "name": a.name, "values": [s.text(v) for v in a.values]}
