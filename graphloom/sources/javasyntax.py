"""A Java 8 reader: tokens with offsets and a recursive-descent parser.

``parse`` returns a tree of :class:`N`; ``x`` holds a node's parts by name.
Types are kept as token spans, expressions as nested nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
  |(?P<name>[^\W\d][\w$]*|\$[\w$]*)
  |(?P<num>0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?[\d_]+[fFdD]?|0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?
      |(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[fFdDlL]?)
  |(?P<str>"(?:\\.|[^"\\\n])*")
  |(?P<chr>'(?:\\.[^']*|[^'\\\n])')
  |(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|[(){}\[\];,.@=<>!~?:+\-*/&|^%])""",
    re.S | re.X,
)
PRIMITIVE = {"boolean", "char", "byte", "short", "int", "long", "float", "double"}
_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends "
    "final finally float for goto if implements import instanceof int interface long native new package private "
    "protected public return short static strictfp super switch synchronized this throw throws transient try void "
    "volatile while true false null".split()
)
_MODIFIER = set("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_BINARY = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", ">>=", ">>>=", "<<=", "%="}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    line: int

    @property
    def stop(self) -> int:
        return self.start + len(self.text) - 1


@dataclass(slots=True)
class N:
    """A syntax node over tokens first..last (inclusive)."""

    kind: str
    first: int
    last: int = -1
    x: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        return self.x.get(name)


class JavaSyntaxError(ValueError):
    pass


def tokens(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise JavaSyntaxError(f"line {line}: {text[at : at + 20]!r}")
        kind = m.lastgroup
        if kind != "skip":
            word = m[0]
            out.append(Token("word" if kind == "name" and word in _WORDS else kind, word, at, line))
        line += m[0].count("\n")
        at = m.end()
    out.append(Token("end", "", len(text), line))
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i = text, tokens(text), 0

    # -- helpers
    def peek(self, k: int = 0) -> str:
        j = self.i + k
        t = self.toks[j] if j < len(self.toks) else self.toks[-1]
        return "" if t.kind in ("str", "chr", "num", "end") else t.text

    def at_name(self, k: int = 0) -> bool:
        return self.i + k < len(self.toks) and self.toks[self.i + k].kind == "name"

    def fail(self) -> None:
        t = self.toks[self.i]
        raise JavaSyntaxError(f"line {t.line}: unexpected {t.text!r}")

    def take(self, text: str) -> int:
        if self.peek() != text:
            self.fail()
        self.i += 1
        return self.i - 1

    def maybe(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def name(self) -> str:
        if not self.at_name():
            self.fail()
        self.i += 1
        return self.toks[self.i - 1].text

    def node(self, kind: str, first: int, **x) -> N:
        return N(kind, first, self.i - 1, x)

    def attempt(self, rule, *args):
        """The rule's result, or None with the position restored."""
        at = self.i
        try:
            return rule(*args)
        except JavaSyntaxError:
            self.i = at
            return None

    def qualified(self) -> str:
        parts = [self.name()]
        while self.peek() == "." and self.at_name(1):
            self.i += 1
            parts.append(self.name())
        return ".".join(parts)

    # -- types
    def type(self) -> N:
        first = self.i
        while self.peek() == "@":
            self.annotation()
        if self.peek() in PRIMITIVE or self.peek() == "void":
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.peek() == "." and self.at_name(1):
                self.i += 1
                self.name()
                self.type_arguments()
        self.dims()
        return self.node("type", first)

    def dims(self) -> int:
        n = 0
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            n += 1
        return n

    def type_arguments(self) -> bool:
        if self.peek() != "<":
            return False
        self.i += 1
        if self.maybe(">"):
            return True
        while True:
            while self.peek() == "@":
                self.annotation()
            if self.maybe("?"):
                if self.peek() in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
                while self.maybe("&"):
                    self.type()
            if not self.maybe(","):
                break
        self.take(">")
        return True

    def type_parameters(self) -> N | None:
        if self.peek() != "<":
            return None
        first = self.i
        self.i += 1
        while True:
            while self.peek() == "@":
                self.annotation()
            self.name()
            if self.maybe("extends"):
                self.type()
                while self.maybe("&"):
                    self.type()
            if not self.maybe(","):
                break
        self.take(">")
        return self.node("type_parameters", first)

    # -- declarations
    def annotation(self) -> N:
        first = self.take("@")
        name, values = self.qualified(), []
        if self.maybe("("):
            while self.peek() != ")":
                values.append(self.element())
                if not self.maybe(","):
                    break
            self.take(")")
        return self.node("annotation", first, name=name, values=values)

    def element(self) -> N:
        first = self.i
        key = None
        if self.at_name() and self.peek(1) == "=":
            key = self.name()
            self.i += 1
        if self.peek() == "@":
            self.annotation()
        elif self.maybe("{"):
            while self.peek() != "}":
                self.element()
                if not self.maybe(","):
                    break
            self.take("}")
        else:
            self.ternary()
        return self.node("element", first, key=key)

    def modifiers(self) -> tuple[list[str], list[N]]:
        words, notes = [], []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                notes.append(self.annotation())
            elif self.peek() in _MODIFIER and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                words.append(self.peek())
                self.i += 1
            else:
                return words, notes

    def unit(self) -> N:
        package, imports, types = None, [], []
        at = self.i
        self.modifiers()
        if self.maybe("package"):
            package = N("package", self.i, 0, {"name": self.qualified()})
            package.last = self.i - 1
            self.take(";")
        else:
            self.i = at
        while self.peek() == "import":
            first = self.i
            self.i += 1
            static = self.maybe("static")
            name = self.qualified()
            if self.maybe("."):
                self.take("*")
                name += ".*"
            self.take(";")
            imports.append(self.node("import", first, name=name, static=static))
        while self.toks[self.i].kind != "end":
            if not self.maybe(";"):
                types.append(self.type_declaration())
        return self.node("unit", 0, package=package, imports=imports, types=types)

    def type_declaration(self) -> N:
        words, notes = self.modifiers()
        first = self.i
        if self.maybe("class"):
            name, params = self.name(), self.type_parameters()
            base = self.type() if self.maybe("extends") else None
            faces = self.type_list() if self.maybe("implements") else []
            return self.node("class", first, name=name, params=params, extends=base, implements=faces, modifiers=words, annotations=notes, body=self.class_body(name))._closed(self)
        if self.maybe("enum"):
            name = self.name()
            faces = self.type_list() if self.maybe("implements") else []
            self.take("{")
            while self.at_name() or self.peek() == "@":
                self.modifiers()
                self.name()
                if self.peek() == "(":
                    self.arguments()
                if self.peek() == "{":
                    self.class_body(None)
                if not self.maybe(","):
                    break
            body = []
            if self.maybe(";"):
                while self.peek() != "}":
                    body += self.member(name)
            self.take("}")
            return self.node("enum", first, name=name, implements=faces, modifiers=words, annotations=notes, body=body)
        if self.maybe("@"):
            self.take("interface")
            name = self.name()
            return self.node("annotation_type", first, name=name, modifiers=words, annotations=notes, body=self.class_body(name))._closed(self)
        self.take("interface")
        name, params = self.name(), self.type_parameters()
        faces = self.type_list() if self.maybe("extends") else []
        return self.node("interface", first, name=name, params=params, implements=faces, modifiers=words, annotations=notes, body=self.class_body(name))._closed(self)

    def type_list(self) -> list[N]:
        out = [self.type()]
        while self.maybe(","):
            out.append(self.type())
        return out

    def class_body(self, name: str | None) -> list[N]:
        self.take("{")
        out = []
        while self.peek() != "}":
            out += self.member(name)
        self.take("}")
        return out

    def member(self, owner: str | None) -> list[N]:
        if self.maybe(";"):
            return []
        outer = self.i
        if self.peek() == "{" or self.peek() == "static" and self.peek(1) == "{":
            static = self.maybe("static")
            return [self.node("initializer", outer, static=static, body=self.block())._closed(self)]
        words, notes = self.modifiers()
        if self.peek() in ("class", "enum", "interface") or self.peek() == "@" and self.peek(1) == "interface":
            inner = self.type_declaration()
            inner.x["modifiers"], inner.x["annotations"] = words, notes
            return [inner]
        params = self.type_parameters()
        first = self.i
        own = {"modifiers": words, "annotations": notes, "type_params": params, "outer": outer}
        if self.at_name() and self.peek(1) == "(" and self.toks[self.i].text == owner:
            name = self.name()
            args, span = self.parameters()
            throws = self.type_list() if self.maybe("throws") else []
            return [self.node("constructor", first, name=name, args=args, span=span, throws=throws, body=self.block(), **own)._closed(self)]
        kind = self.type()
        if self.at_name() and self.peek(1) == "(":
            name = self.name()
            args, span = self.parameters()
            self.dims()
            throws = self.type_list() if self.maybe("throws") else []
            if self.maybe("default"):
                self.element()
            body = None if self.maybe(";") else self.block()
            return [self.node("method", first, type=kind, name=name, args=args, span=span, throws=throws, body=body, **own)]
        declared = self.declarators()
        self.take(";")
        return [self.node("field", first, type=kind, vars=declared, **own)]

    def parameters(self) -> tuple[list[N], tuple[int, int]]:
        start = self.take("(")
        out = []
        while self.peek() != ")":
            first = self.i
            words, notes = self.modifiers()
            kind = self.type()
            rest = self.maybe("...")
            if self.maybe("this"):
                pass
            else:
                name = self.name()
                self.dims()
                out.append(self.node("parameter", first, type=kind, name=name, modifiers=words, annotations=notes, varargs=rest))
            if not self.maybe(","):
                break
        return out, (start, self.take(")"))

    def declarators(self) -> list[N]:
        out = []
        while True:
            first = self.i
            name = self.name()
            dims = self.dims()
            init = self.initializer() if self.maybe("=") else None
            out.append(self.node("declarator", first, name=name, dims=dims, init=init))
            if not self.maybe(","):
                return out

    def initializer(self) -> N:
        if self.peek() != "{":
            return self.expression()
        first = self.take("{")
        items = []
        while self.peek() != "}":
            items.append(self.initializer())
            if not self.maybe(","):
                break
        self.take("}")
        return self.node("array_init", first, items=items)

    # -- statements
    def block(self) -> N:
        first = self.take("{")
        out = []
        while self.peek() != "}":
            out.append(self.block_statement())
        self.take("}")
        return self.node("block", first, body=out)

    def block_statement(self) -> N:
        at = self.i
        words, notes = self.modifiers()
        if self.peek() in ("class", "interface", "enum"):
            return self.type_declaration()
        if (words and words != ["synchronized"]) or notes:
            found = self.local()
        else:
            self.i = at
            found = self.attempt(self.local) if self.at_name() or self.peek() in PRIMITIVE else None
        return found or self.statement()

    def local(self, end: bool = True) -> N:
        first = self.i
        kind = self.type()
        declared = self.declarators()
        last = self.i - 1
        if end:
            self.take(";")
        out = self.node("local", first, type=kind, vars=declared)
        out.last = last
        return out

    def paren(self) -> N:
        first = self.take("(")
        inner = self.expression()
        self.take(")")
        return self.node("paren", first, expr=inner)

    def statement(self) -> N:
        first, word = self.i, self.peek()
        end = lambda kind, **x: (self.take(";"), self.node(kind, first, **x))[1]
        if word == "{":
            return self.block()
        if word == ";":
            self.i += 1
            return self.node("empty", first)
        if self.at_name() and self.peek(1) == ":":
            label = self.name()
            self.i += 1
            return self.node("labeled", first, label=label, body=self.statement())._closed(self)
        self.i += 1
        if word == "if":
            cond, then = self.paren(), self.statement()
            return self.node("if", first, cond=cond, then=then, other=self.statement() if self.maybe("else") else None)._closed(self)
        if word == "while":
            return self.node("while", first, cond=self.paren(), body=self.statement())._closed(self)
        if word == "do":
            body = self.statement()
            self.take("while")
            return end("do", body=body, cond=self.paren())
        if word == "for":
            return self.for_statement(first)
        if word == "return":
            return end("return", expr=None if self.peek() == ";" else self.expression())
        if word == "throw":
            return end("throw", expr=self.expression())
        if word in ("break", "continue"):
            return end(word, label=self.name() if self.at_name() else None)
        if word == "assert":
            return end("assert", expr=self.expression(), detail=self.expression() if self.maybe(":") else None)
        if word == "synchronized":
            return self.node("synchronized", first, cond=self.paren(), body=self.block())._closed(self)
        if word == "switch":
            return self.switch(first)
        if word == "try":
            return self.try_statement(first)
        self.i = first
        return end("expression", expr=self.expression())

    def for_statement(self, first: int) -> N:
        self.take("(")
        head = self.i
        each = self.attempt(self.each_head)
        if each:
            each.last = self.i - 1
            self.take(")")
            return self.node("foreach", first, head=each, body=self.statement())._closed(self)
        self.i = head
        init = None
        if self.peek() != ";":
            at = self.i
            self.modifiers()
            init = self.attempt(self.local, False)
            if not init:
                self.i = at
                init = self.expressions()
        self.take(";")
        cond = None if self.peek() == ";" else self.expression()
        self.take(";")
        update = None if self.peek() == ")" else self.expressions()
        self.take(")")
        return self.node("for", first, init=init, cond=cond, update=update, body=self.statement())._closed(self)

    def each_head(self) -> N:
        first = self.i
        self.modifiers()
        kind, name = self.type(), self.name()
        self.dims()
        self.take(":")
        return self.node("each", first, type=kind, name=name, expr=self.expression())

    def expressions(self) -> N:
        first = self.i
        out = [self.expression()]
        while self.maybe(","):
            out.append(self.expression())
        return self.node("expressions", first, items=out)

    def switch(self, first: int) -> N:
        cond = self.paren()
        self.take("{")
        groups = []
        while self.peek() != "}":
            at, labels, body = self.i, [], []
            while self.peek() in ("case", "default"):
                start = self.i
                default = self.peek() == "default"
                self.i += 1
                value = None if default else self.ternary()
                self.take(":")
                labels.append(self.node("label", start, value=value, default=default))
            if not labels:
                self.fail()
            while self.peek() not in ("case", "default", "}"):
                body.append(self.block_statement())
            groups.append(self.node("group", at, labels=labels, body=body))
        self.take("}")
        return self.node("switch", first, cond=cond, groups=groups)

    def try_statement(self, first: int) -> N:
        resources, catches, final = [], [], None
        if self.maybe("("):
            while self.peek() != ")":
                at = self.i
                self.modifiers()
                kind, name = self.type(), self.name()
                self.dims()
                self.take("=")
                resources.append(self.node("resource", at, type=kind, name=name, expr=self.expression())._closed(self))
                if not self.maybe(";"):
                    break
            self.take(")")
        body = self.block()
        while self.peek() == "catch":
            at = self.i
            self.i += 1
            self.take("(")
            self.modifiers()
            kinds = self.i
            self.type()
            while self.maybe("|"):
                self.type()
            kind = self.node("type", kinds)
            name = self.name()
            self.take(")")
            catches.append(self.node("catch", at, type=kind, name=name, body=self.block())._closed(self))
        if self.peek() == "finally":
            at = self.i
            self.i += 1
            final = self.node("finally", at, body=self.block())._closed(self)
        return self.node("try", first, resources=resources, body=body, catches=catches, final=final)

    # -- expressions
    def expression(self) -> N:
        first = self.i
        if self.lambda_ahead():
            return self.lambda_expression()
        left = self.ternary()
        if self.peek() in _ASSIGN:
            op = self.peek()
            self.i += 1
            return self.node("assign", first, left=left, op=op, right=self.expression())._closed(self)
        return left

    def lambda_ahead(self) -> bool:
        if self.at_name():
            return self.peek(1) == "->"
        if self.peek() != "(":
            return False
        depth, k = 0, 0
        while self.toks[self.i + k].kind != "end":
            depth += {"(": 1, ")": -1}.get(self.peek(k), 0)
            k += 1
            if depth == 0:
                return self.peek(k) == "->"
        return False

    def lambda_expression(self) -> N:
        first = self.i
        args = []
        if self.at_name():
            args.append(self.name())
        else:
            named = self.attempt(self.parameters)
            if named:
                args = [a.name for a in named[0]]
            else:
                self.take("(")
                while self.peek() != ")":
                    args.append(self.name())
                    if not self.maybe(","):
                        break
                self.take(")")
        self.take("->")
        return self.node("lambda", first, args=args, body=self.block() if self.peek() == "{" else self.expression())._closed(self)

    def ternary(self) -> N:
        first = self.i
        cond = self.binary(0)
        if not self.maybe("?"):
            return cond
        then = self.expression()
        self.take(":")
        other = self.expression() if self.lambda_ahead() else self.ternary()
        return self.node("ternary", first, cond=cond, then=then, other=other)

    def operator(self, level: int) -> str | None:
        ops = _BINARY[level]
        if "<<" in ops:  # single signs that touch
            t = self.toks[self.i : self.i + 4]
            for n, sign in ((3, ">"), (2, ">"), (2, "<")):
                run = t[:n]
                if len(run) == n and all(x.text == sign and x.kind == "op" for x in run) and all(b.start == a.start + 1 for a, b in zip(run, run[1:])):
                    return sign * n
            return None
        if self.peek() in ("<", ">") and self.operator(7):
            return None
        return self.peek() if self.peek() in ops else None

    def binary(self, level: int) -> N:
        if level == len(_BINARY):
            return self.unary()
        first = self.i
        left = self.binary(level + 1)
        while op := self.operator(level):
            if op == "instanceof":
                self.i += 1
                left = self.node("instanceof", first, left=left, type=self.type())._closed(self)
            else:
                self.i += len(op) if op[0] in "<>" and level == 7 else 1
                left = self.node("binary", first, op=op, left=left, right=self.binary(level + 1))._closed(self)
        return left

    def unary(self) -> N:
        first, op = self.i, self.peek()
        if op in ("+", "-", "++", "--", "~", "!"):
            self.i += 1
            return self.node("unary", first, op=op, expr=self.unary())._closed(self)
        if op == "(":
            cast = self.attempt(self.cast)
            if cast:
                return cast
        return self.postfix()

    def cast(self) -> N:
        first = self.take("(")
        kind = self.type()
        while self.maybe("&"):
            self.type()
        self.take(")")
        t = self.toks[self.i]
        primitive = kind.first == kind.last and self.toks[kind.first].text in PRIMITIVE
        starts = t.kind in ("name", "num", "str", "chr") or t.text in ("(", "!", "~", "this", "super", "new", "true", "false", "null", "void") or t.text in PRIMITIVE
        if not (starts or primitive and t.text in ("+", "-", "++", "--")):
            self.fail()
        inner = self.lambda_expression() if self.lambda_ahead() else self.unary()
        return self.node("cast", first, type=kind, expr=inner)

    def arguments(self) -> tuple[list[N], int, int]:
        start = self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if not self.maybe(","):
                break
        return out, start, self.take(")")

    def call(self) -> N:
        first = self.i
        name = self.toks[self.i].text
        self.i += 1
        args, start, stop = self.arguments()
        return self.node("call", first, name=name, args=args, inside=(start + 1, stop - 1))

    def primary(self) -> N:
        first, t = self.i, self.toks[self.i]
        if t.kind in ("num", "str", "chr") or t.text in ("true", "false", "null") and t.kind == "word":
            self.i += 1
            return self.node("literal", first)
        if t.text == "(":
            return self.paren()
        if t.text == "new":
            return self.creator()
        if t.text in ("this", "super"):
            if self.peek(1) == "(":
                return self.call()
            self.i += 1
            return self.node("name", first, name=t.text)
        if t.kind == "word" and (t.text in PRIMITIVE or t.text == "void"):
            self.type()
            if self.maybe("::"):
                self.maybe("new") or self.name()
                return self.node("method_ref", first)
            self.take(".")
            self.take("class")
            return self.node("literal", first)
        if t.text == "<":
            self.type_arguments()
            return self.call()
        if self.at_name():
            if self.peek(1) == "(":
                return self.call()
            ref = self.attempt(self.typed_reference)
            if ref:
                return ref
            self.i += 1
            return self.node("name", first, name=t.text)
        self.fail()

    def typed_reference(self) -> N:
        """``Type<..>[]::name`` and ``Type[].class``."""
        first = self.i
        self.type()
        spelled = any(x.text in ("<", "[") for x in self.toks[first : self.i])
        if spelled and self.maybe("::"):
            self.maybe("new") or self.name()
            return self.node("method_ref", first)
        if self.maybe(".") and self.maybe("class"):
            return self.node("literal", first)
        self.fail()

    def creator(self) -> N:
        first = self.take("new")
        self.type_arguments()
        at = self.i
        while self.peek() == "@":
            self.annotation()
        if self.peek() in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.maybe("."):
                self.name()
                self.type_arguments()
        kind = self.node("type", at)
        if self.peek() == "[":
            sizes = []
            while self.peek() == "[":
                self.i += 1
                if self.peek() != "]":
                    sizes.append(self.expression())
                self.take("]")
            init = self.initializer() if self.peek() == "{" else None
            return self.node("new_array", first, type=kind, sizes=sizes, init=init)
        args, start, stop = self.arguments()
        body = self.class_body(None) if self.peek() == "{" else None
        return self.node("new", first, type=kind, args=args, inside=(start + 1, stop - 1), body=body)

    def postfix(self) -> N:
        first = self.i
        left = self.primary()
        while True:
            op = self.peek()
            if op == ".":
                self.i += 1
                if self.peek() == "<":
                    self.type_arguments()
                if self.peek() == "new":
                    right = self.creator()
                elif self.peek() == "class":
                    self.i += 1
                    left = self.node("literal", first)
                    continue
                elif self.peek() in ("this", "super") and self.peek(1) != "(":
                    self.i += 1
                    right = N("name", self.i - 1, self.i - 1, {"name": self.toks[self.i - 1].text})
                elif self.peek(1) == "(":
                    right = self.call()
                else:
                    at = self.i
                    right = self.node("name", at, name=self.name())._closed(self)
                left = self.node("dot", first, left=left, right=right)
            elif op == "[":
                self.i += 1
                index = self.expression()
                self.take("]")
                left = self.node("array", first, left=left, index=index)
            elif op in ("++", "--"):
                self.i += 1
                left = self.node("postfix", first, op=op, expr=left)
            elif op == "::":
                self.i += 1
                self.type_arguments()
                self.maybe("new") or self.name()
                left = self.node("method_ref", first, left=left)
            else:
                return left


def _closed(self: N, parser: Parser) -> N:
    """Ends where the parser is now: for nodes whose parts were read while they were made."""
    self.last = parser.i - 1
    return self


N._closed = _closed


def parse(text: str) -> tuple[N, Parser]:
    """The compilation unit and its parser (tokens, source slices)."""
    p = Parser(text)
    return p.unit(), p
