"""Syntax of schemas: nodes, a reader for the text form and a printer."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# ----------------------------------------------------------------------------------- nodes


@dataclass(frozen=True)
class Lit:
    """A literal value; ``kind`` is null, bool, int, float or string."""

    kind: str
    value: object


@dataclass(frozen=True)
class ListNode:
    items: tuple


@dataclass(frozen=True)
class TupleNode:
    items: tuple


@dataclass(frozen=True)
class ObjectNode:
    fields: tuple  # of (name, node)


@dataclass(frozen=True)
class SumNode:
    members: tuple


@dataclass(frozen=True)
class Name:
    """A type or value by name."""

    name: str


@dataclass(frozen=True)
class Path:
    """A path from the root of the document: ``.types.user``."""

    parts: tuple


@dataclass(frozen=True)
class SchemaNode:
    """``(type, clause, …)``."""

    type: object
    clauses: tuple = ()


@dataclass(frozen=True)
class Check:
    expr: object


@dataclass(frozen=True)
class Flag:
    name: str


@dataclass(frozen=True)
class Attr:
    name: str
    value: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Group:
    expr: object


X = Name("x")
COMPARISONS = ("==", "!=", "<=", ">=", "<", ">")
#: How tightly operators bind, loosest first.
LEVELS = (("||",), ("&&",), ("==", "!=", "<=", ">=", "<", ">", "in", "~"), ("+", "-"), ("*", "/", "%"))
_BINDS = {op: i for i, level in enumerate(LEVELS) for op in level}


class SchemaError(ValueError):
    """A schema that can't be read, printed or compiled; ``at`` is its place in the text, if known."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} (at {at})")
        self.at = at


def lit(value) -> Lit:
    """The literal node of a Python value."""
    for kind, python in (("null", type(None)), ("bool", bool), ("int", int), ("float", float), ("string", str)):
        if isinstance(value, python):
            return Lit(kind, value)
    raise SchemaError(f"not a literal: {value!r}")


# ---------------------------------------------------------------------------------- reader

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\x00-\x1f]|\\.)*")"""
    r"""|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>\#\{|\|\||&&|[=!<>]=|[][(){},:.|<>!~+\-*/%=])""",
    re.S,
)


def _placed(method):
    """Notes where in the text the node that a method reads begins."""

    def read(self, *args):
        at = self.tokens[self.i][2]
        node = method(self, *args)
        self.places.setdefault(id(node), (node, at))
        return node

    return read


class Reader:
    """Recursive descent over the tokens of one text; ``places``: nodes by identity, and where they begin."""

    def __init__(self, text: str):
        self.places: dict[int, tuple[object, int]] = {}
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"unexpected {text[at]!r}", at)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.i = 0

    @property
    def now(self) -> str:
        return "" if self.tokens[self.i][0] == "string" else self.tokens[self.i][1]

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def take(self, *texts: str) -> str | None:
        if self.now in texts and self.now:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SchemaError(f"expected {text!r}, got {self.tokens[self.i][1]!r}", self.tokens[self.i][2])

    def next(self, kind: str) -> str:
        if self.kind != kind:
            raise SchemaError(f"expected a {kind}, got {self.tokens[self.i][1]!r}", self.tokens[self.i][2])
        self.i += 1
        return self.tokens[self.i - 1][1]

    def several(self, close: str, one) -> tuple:
        """Items up to ``close``, divided by commas; one comma may trail."""
        items = []
        while not self.take(close):
            if items:
                self.need(",")
                if self.take(close):
                    break
            items.append(one())
        return tuple(items)

    def document(self):
        node = self.value()
        self.next("end")
        return node

    @_placed
    def value(self):
        node = self.single()
        members = [node]
        while self.take("|"):
            members.append(self.single())
        return node if len(members) == 1 else SumNode(tuple(members))

    @_placed
    def single(self):
        if self.take("("):
            return self.schema()
        if self.take("["):
            return ListNode(self.several("]", self.value))
        if self.take("#{"):
            return TupleNode(self.several("}", self.value))
        if self.take("{"):
            return ObjectNode(self.several("}", self.field))
        return self.literal()

    def field(self):
        name = json.loads(self.next("string"), strict=False)
        self.need(":")
        return name, self.value()

    @_placed
    def literal(self) -> Lit:
        if self.kind == "string":
            return Lit("string", json.loads(self.next("string")))
        word = self.take("null", "true", "false")
        if word:
            return lit({"null": None, "true": True, "false": False}[word])
        sign = self.take("-", "+")
        return self.number(sign)

    def number(self, sign: str | None) -> Lit:
        text = self.next("number")
        if re.fullmatch(r"0\d+", text):
            raise SchemaError(f"a number with a leading zero: {text}", self.tokens[self.i - 1][2])
        value = float(text) if re.search("[.eE]", text) else int(text)
        return lit(-value if sign == "-" else value)

    def schema(self) -> SchemaNode:
        if self.kind == "name" and self.now not in ("null", "true", "false"):
            ref = Name(self.dotted())
        elif self.take("."):
            ref = Path(tuple(self.dotted().split(".")))
        else:
            ref = self.value()
        self.take(",")
        return SchemaNode(ref, self.several(")", self.clause))

    def dotted(self) -> str:
        parts = [self.next("name")]
        while self.now == "." and self.take("."):
            parts.append(self.next("name"))
        return ".".join(parts)

    @_placed
    def clause(self):
        start = self.i
        if self.kind == "name" and self.now not in ("x", "true", "false", "null"):
            name = self.dotted()
            if self.take("="):
                return Attr(name, self.value())
            if self.now in (",", ")"):
                return Flag(name)
            self.i = start
        return Check(self.expr())

    @_placed
    def expr(self, level: int = 0):
        if level == len(LEVELS):
            return self.unary()
        if level == 2 and self.take("!"):
            return Unary("!", self.expr(2))
        left = self.expr(level + 1)
        while True:
            op = self.take(*LEVELS[level], *(("IN",) if level == 2 else ()))
            if not op:
                return left
            left = Binary(op.lower(), left, self.expr(level + 1))

    def unary(self):
        sign = self.take("-", "+")
        if sign:
            if self.kind == "number":
                return self.number(sign)
            return Unary(sign, self.unary())
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return Group(inner)
        if self.take("["):
            return ListNode(self.several("]", self.expr))
        if self.take("."):
            return Path(tuple(self.dotted().split(".")))
        if self.kind == "name" and self.now not in ("null", "true", "false"):
            name = self.dotted()
            return Call(name, self.several(")", self.expr)) if self.take("(") else Name(name)
        return self.literal()


def parse(text: str):
    """The node of a schema or value written as text."""
    return Reader(text).document()


# --------------------------------------------------------------------------------- printer


def show(node) -> str:
    """The compact text of a node.  Parentheses are added where the reader needs them."""
    match node:
        case Lit("string", v):
            return json.dumps(v, ensure_ascii=False)
        case Lit(_, v):
            return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else repr(v)
        case ListNode(items):
            return f"[{','.join(map(show, items))}]"
        case TupleNode(items):
            return f"#{{{','.join(map(show, items))}}}"
        case ObjectNode(fields):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{show(v)}" for k, v in fields) + "}"
        case SumNode(members):
            return "|".join(map(show, members))
        case SchemaNode(ref, clauses):
            return f"({','.join([show(ref), *map(show, clauses)])})"
        case Name(name) | Flag(name):
            return name
        case Path(parts):
            return "." + ".".join(parts)
        case Check(expr):
            return show(expr)
        case Attr(name, value):
            return f"{name}={show(value)}"
        case Call(name, args):
            return f"{name}({','.join(map(show, args))})"
        case Group(expr):
            return f"({show(expr)})"
        case Unary(op, arg):
            loose = isinstance(arg, Binary) and (op != "!" or _BINDS[arg.op] < 2)
            return f"{op}({show(arg)})" if loose else f"{op}{show(arg)}"
        case Binary(op, left, right):
            l, r = show(left), show(right)
            l = f"({l})" if isinstance(left, Binary) and _BINDS[left.op] < _BINDS[op] else l
            r = f"({r})" if isinstance(right, Binary) and _BINDS[right.op] <= _BINDS[op] else r
            return f"{l} in {r}" if op == "in" else f"{l}{op}{r}"
    raise SchemaError(f"can't be printed: {node!r}")
