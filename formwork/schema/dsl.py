"""Schemas built in Python: each function returns a syntax node."""

from __future__ import annotations

from formwork.schema.syntax import (
    X,
    Attr,
    Binary,
    Call,
    Check,
    Flag,
    Group,
    ListNode,
    Lit,
    Name,
    ObjectNode,
    Path,
    SchemaError,
    SchemaNode,
    SumNode,
    TupleNode,
    Unary,
    lit,
)

_BINARY = ("==", "!=", "<", "<=", ">", ">=", "in", "~", "&&", "||", "+", "-", "*", "/", "%")
_NODES = (Lit, ListNode, TupleNode, ObjectNode, SumNode, Name, Path, SchemaNode, Call, Unary, Binary, Group)


def node(value):
    """A node as it is; None, bool, int, float and str as literals; list and dict as lists and objects."""
    if isinstance(value, _NODES):
        return value
    if isinstance(value, list):
        return ListNode(tuple(map(node, value)))
    if isinstance(value, dict):
        return ObjectNode(tuple((k, node(v)) for k, v in value.items()))
    return lit(value)


def type_(name: str) -> SchemaNode:
    if not name:
        raise SchemaError("a type needs a name")
    return SchemaNode(Name(name))


any_, never, null, bool_, int_, float_, string = (type_(n) for n in ("any", "never", "null", "bool", "int", "float", "string"))


def ref(*parts: str) -> SchemaNode:
    """The schema at a path of the document."""
    if not parts or not all(parts):
        raise SchemaError("a path needs parts")
    return SchemaNode(Path(parts))


def list_(*items) -> ListNode:
    """A list type (one schema) or a tuple of values."""
    return ListNode(tuple(map(node, items)))


def tuple_(*items) -> TupleNode:
    return TupleNode(tuple(map(node, items)))


def field(name: str, value) -> tuple:
    return name, node(value)


def object_(*fields) -> ObjectNode:
    return ObjectNode(tuple(fields))


def sum_(*members) -> SumNode:
    if len(members) < 2:
        raise SchemaError("a sum needs two members")
    return SumNode(tuple(map(node, members)))


def check(expr) -> Check:
    return Check(node(expr))


def flag(name: str) -> Flag:
    if not name:
        raise SchemaError("a flag needs a name")
    return Flag(name)


def attr(name: str, value) -> Attr:
    if not name:
        raise SchemaError("an attribute needs a name")
    return Attr(name, node(value))


def with_(value, *clauses) -> SchemaNode:
    """``value`` with further clauses."""
    for c in clauses:
        if not isinstance(c, (Check, Flag, Attr)):
            raise SchemaError(f"not a clause: {c!r}")
    value = node(value)
    if isinstance(value, SchemaNode):
        return SchemaNode(value.type, value.clauses + clauses)
    return SchemaNode(value, clauses)


def optional(value) -> SchemaNode:
    return with_(value, Flag("optional"))


def where(value, *exprs) -> SchemaNode:
    return with_(value, *map(check, exprs))


x = X


def ident(name: str) -> Name:
    return Name(name)


def path(*parts: str) -> Path:
    return Path(parts)


def call(name: str, *args) -> Call:
    if not name or not args:
        raise SchemaError("a call needs a name and an argument")
    return Call(name, tuple(map(node, args)))


def len_(arg=X) -> Call:
    return call("len", arg)


def unary(op: str, arg) -> Unary:
    if op not in ("!", "-", "+"):
        raise SchemaError(f"not a unary operator: {op}")
    return Unary(op, node(arg))


def binary(op: str, left, right) -> Binary:
    if op not in _BINARY:
        raise SchemaError(f"not a binary operator: {op}")
    return Binary(op, node(left), node(right))


def group(expr) -> Group:
    return Group(node(expr))
