"""From syntax to canonical types."""

from __future__ import annotations

import functools

from formwork.functions import arguments, layouts
from formwork.schema import types as t
from formwork.schema.syntax import (
    COMPARISONS,
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
    Reader,
    SchemaError,
    SchemaNode,
    SumNode,
    TupleNode,
    Unary,
    parse,
)

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
#: Ranges of the sized integer names.
SIZED = {f"int{n}": (-(1 << (n - 1)), (1 << (n - 1)) - 1) for n in (8, 16, 32, 64)} | {f"uint{n}": (0, (1 << n) - 1) for n in (8, 16, 32, 64)} | {"uint": (0, (1 << 63) - 1)}
_ALIASES = {"number": "(float)", "uuid": "(string,uuid(x))", "email": "(string,email(x))", "url": "(string,url(x))", "ipv4": "(string,ipv4(x))", "date": '(string,parsedate(x,"yyyy-MM-dd"))', "datetime": '(string,parsedate(x,"datetime"))'}


def located(method):
    """Gives an error without a place that of the innermost node of the text it concerns."""

    @functools.wraps(method)
    def run(self, node, *args):
        try:
            return method(self, node, *args)
        except SchemaError as e:
            held = self.places.get(id(node))
            if e.at is not None or held is None:
                raise
            raise SchemaError(str(e), held[1]) from None

    return run


class Compiler:
    """Compiles nodes of one document; ``names`` are the user's own types, as nodes or text;
    ``places`` are the reader's, for errors."""

    def __init__(self, root=None, names: dict | None = None, places: dict | None = None):
        self.root, self.places = root, places or {}
        self.names = {k: parse(v) if isinstance(v, str) else v for k, v in (_ALIASES | (names or {})).items()}
        self.open: list = []

    def whole(self, node) -> t.Type:
        return self.plain(node, "the root")

    def plain(self, node, where: str) -> t.Type:
        found, optional = self.value(node)
        if optional:
            raise SchemaError(f"optional doesn't belong to {where}")
        return found

    @located
    def value(self, node) -> tuple[t.Type, bool]:
        match node:
            case Lit(kind, v):
                if kind == "int" and not t.INT_MIN <= v <= t.INT_MAX:
                    raise SchemaError(f"integer beyond 64 bits: {v}")
                if kind == "float" and not t.finite(v):
                    raise SchemaError(f"not a finite number: {v}")
                return t.literal(node), False
            case ListNode(items):
                if any(map(has_schema, items)):
                    if len(items) != 1:
                        raise SchemaError("array schemas must contain exactly one element schema")
                    return t.ListType(self.plain(items[0], "an element")), False
                return t.TupleType(tuple(self.plain(x, "an element") for x in items)), False
            case TupleNode(items):
                return t.TupleType(tuple(self.plain(x, "an element") for x in items)), False
            case ObjectNode(fields):
                found: dict[str, t.Field] = {}
                for name, value in fields:
                    if name in found:
                        raise SchemaError(f"duplicate field {name!r}")
                    kind, optional = self.value(value)
                    found[name] = t.Field(name, kind, optional)
                return t.ObjectType(tuple(found[n] for n in sorted(found))), False
            case SumNode(members):
                return t.sum_of([self.plain(m, "a member of a sum") for m in members]), False
            case SchemaNode():
                return self.schema(node)
        raise SchemaError(f"neither a value nor a schema: {node!r}")

    def schema(self, node: SchemaNode) -> tuple[t.Type, bool]:
        base = self.reference(node.type)
        optional: bool | None = None
        for c in node.clauses:
            if isinstance(c, (Flag, Attr)) and c.name == "optional":
                said = c.value if isinstance(c, Attr) else Lit("bool", True)
                if not isinstance(said, Lit) or said.kind != "bool":
                    raise SchemaError("optional is true or false")
                if optional not in (None, said.value):
                    raise SchemaError("contradictory optional clauses")
                optional = said.value
        for c in node.clauses:
            if isinstance(c, Check):
                base = self.checked(c, base)
        return base, bool(optional)

    @located
    def checked(self, check: Check, base: t.Type) -> t.Type:
        return constrained(base, check.expr)

    def reference(self, ref) -> t.Type:
        if isinstance(ref, Name):
            if ref.name in t.KINDS:
                return t.Basic(ref.name)
            if ref.name == "uint64":
                return t.sum_of([t.refined(t.INT, t.Constraint(t.Bounds(0))), t.HUGE])
            if ref.name in SIZED:
                return t.refined(t.INT, t.Constraint(t.Bounds(*SIZED[ref.name])))
            if ref.name not in self.names:
                raise SchemaError(f"unresolved type {ref.name!r}")
            return self.expanded(ref, self.names[ref.name])
        if isinstance(ref, Path):
            node = self.root
            for part in ref.parts:
                node = node.type if isinstance(node, SchemaNode) and not isinstance(node.type, (Name, Path)) else node
                node = dict(node.fields).get(part) if isinstance(node, ObjectNode) else None
            if node is None:
                raise SchemaError(f"nothing at .{'.'.join(ref.parts)}")
            return self.expanded(ref, node)
        if isinstance(ref, ListNode):
            if len(ref.items) != 1:
                raise SchemaError("array schemas must contain exactly one element schema")
            return t.ListType(self.plain(ref.items[0], "an element"))
        return self.plain(ref, "a type")

    def expanded(self, ref, node) -> t.Type:
        if ref in self.open:
            raise SchemaError(f"recursive type {ref!r}")
        self.open.append(ref)
        try:
            return self.value(node)[0]
        finally:
            self.open.pop()


def has_schema(node) -> bool:
    match node:
        case SchemaNode() | SumNode():
            return True
        case ListNode(items) | TupleNode(items):
            return any(map(has_schema, items))
        case ObjectNode(fields):
            return any(has_schema(v) for _, v in fields)
    return False


def compile_schema(schema, names: dict | None = None) -> t.Type:
    """The canonical type of a schema: text, a syntax node, or a type as it is."""
    if isinstance(schema, t.Type):
        return schema
    if not isinstance(schema, str):
        return Compiler(schema, names).whole(schema)
    reader = Reader(schema)
    node = reader.document()
    return Compiler(node, names, reader.places).whole(node)


# ----------------------------------------------------------------------------- constraints


def bare(e):
    """The expression without groups at its top."""
    while isinstance(e, Group):
        e = e.expr
    return e


def tidy(e):
    """The expression without any groups."""
    match bare(e):
        case Binary(op, left, right):
            return Binary(op, tidy(left), tidy(right))
        case Unary(op, arg):
            return Unary(op, tidy(arg))
        case Call(name, args):
            return called(name, tuple(map(tidy, args)))
        case ListNode(items):
            return ListNode(tuple(map(tidy, items)))
        case other:
            return other


def called(name: str, args: tuple) -> Call:
    """The call, with ``x`` as first argument where one is missing; a date's layout is checked."""
    known = arguments(name)
    if known is not None and len(args) != known:
        if len(args) != known - 1:
            raise SchemaError(f"{name} takes {known} arguments, or {known - 1} and x before them")
        args = (X, *args)
    if name == "parsedate":
        try:
            layouts(args[1].value if isinstance(args[1], Lit) else None)
        except ValueError as e:
            raise SchemaError(str(e)) from None
    return Call(name, args)


_NOT = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def positive(e):
    """The expression with negations moved inwards over &&, ||, comparisons and lists."""
    match bare(e):
        case Unary("!", arg):
            return negative(arg)
        case Binary("&&" | "||" as op, left, right):
            return Binary(op, positive(left), positive(right))
        case other:
            return other


def negative(e):
    """What holds where the expression is false."""
    match bare(e):
        case Unary("!", arg):
            return positive(arg)
        case Binary("&&", left, right):
            return Binary("||", negative(left), negative(right))
        case Binary("||", left, right):
            return Binary("&&", negative(left), negative(right))
        case Binary("in", left, ListNode(items)) if items and all(isinstance(v, Lit) and v.kind in ("int", "float") for v in items):
            return functools.reduce(lambda a, b: Binary("&&", a, b), (Binary("!=", left, v) for v in items))
        case Binary(op, _, _) as one if op in _NOT:
            first, *rest = conjuncts(one)
            return functools.reduce(lambda a, b: Binary("||", a, negative(b)), rest, Binary(_NOT[first.op], first.left, first.right))
        case other:
            return Unary("!", other)


def conjuncts(e) -> list:
    """What must all hold: sides of &&, and the pairs of a chained comparison."""
    match bare(e):
        case Binary("&&", left, right):
            return conjuncts(left) + conjuncts(right)
        case Binary(op, Binary(inner, _, middle) as left, right) if op in COMPARISONS and inner in COMPARISONS:
            return conjuncts(left) + [Binary(op, middle, right)]
        case other:
            return [other]


def constrained(base: t.Type, expr) -> t.Type:
    for part in conjuncts(positive(expr)):
        if isinstance(base, t.SumType):
            base = t.sum_of([constrained(m, part) for m in base.members])
        elif base == t.HUGE and (said := of_huge(tidy(part))) is not None:
            base = base if said else t.NEVER
        elif base != t.NEVER:
            base = united(base, part) or t.refined(base, single(base, tidy(part)))
    return base


def of_huge(e) -> bool | None:
    """What comparing with ints and combining that says of every integer beyond an int; None for other expressions."""
    match e:
        case Binary("&&" | "||" as op, left, right):
            a, b = of_huge(left), of_huge(right)
            return None if a is None or b is None else (a and b) if op == "&&" else (a or b)
        case Unary("!", arg):
            said = of_huge(arg)
            return None if said is None else not said
        case Binary("in", left, ListNode(items)) if left == X and all(isinstance(v, Lit) and v.kind == "int" for v in items):
            return False
        case Binary(op, left, right) if op in _FLIP:
            if isinstance(left, Lit):
                op, left, right = _FLIP[op], right, left
            if left == X and isinstance(right, Lit) and right.kind == "int":
                return op in (">", ">=", "!=")
    return None


def united(base: t.Type, e) -> t.Type | None:
    """The union that a condition makes of a base, if normal forms can say it: an alternative of
    ranges, or all numbers but one.  None for any other condition."""
    match tidy(e):
        case Binary("||", left, right) as whole if alternatives(whole) is None:
            both = [constrained(base, side) for side in (left, right)]
            own = t.parts(base)[1].rest
            members = [m for k in both for m in (k.members if isinstance(k, t.SumType) else (k,))]
            return t.sum_of(both) if all(m == t.NEVER or t.parts(m)[1].rest == own for m in members) else None
        case Binary("!=", left, right) if t.parts(base)[0] in (t.INT, t.FLOAT) and ((left == X and isinstance(right, Lit)) or (right == X and isinstance(left, Lit))):
            return t.sum_of([constrained(base, Binary(op, left, right)) for op in ("<", ">")])
    return None


def single(base: t.Type, e) -> t.Constraint:
    """The constraint that one expression puts on a base type."""
    root = t.parts(base)[0]
    match e:
        case Binary("in", left, right) if left == X:
            if not isinstance(right, ListNode) or not all(isinstance(v, Lit) for v in right.items):
                raise SchemaError("in needs a list of literals")
            return t.Constraint(enum=frozenset(fitting(root, v) for v in right.items))
        case Binary("in", _, _):
            raise SchemaError("in needs x on its left")
        case Binary("||", _, _):
            values = alternatives(e)
            if values is not None:
                return t.Constraint(enum=frozenset(fitting(root, v) for v in values))
        case Binary(op, left, right) if op in _FLIP and op != "!=":
            if isinstance(left, Lit):
                op, left, right = _FLIP[op], right, left
            if isinstance(right, Lit) and left == X:
                return t.Constraint(enum=frozenset([fitting(root, right)])) if op == "==" else t.Constraint(number_bound(root, op, right))
            if isinstance(right, Lit) and left == Call("len", (X,)):
                return t.Constraint(length=length_bound(root, op, right))
            if not mentions(e):
                raise SchemaError("a comparison needs x")
    if not mentions(e) and not isinstance(e, Call):  # a function of the user's may look elsewhere
        raise SchemaError("a constraint needs x")
    if isinstance(e, (Name, Lit, ListNode)):
        raise SchemaError("a constraint is a condition")
    return t.Constraint(rest=frozenset([e]))


def mentions(e) -> bool:
    match e:
        case Binary(_, left, right):
            return mentions(left) or mentions(right)
        case Unary(_, arg):
            return mentions(arg)
        case Call(_, args):
            return any(map(mentions, args))
    return e == X


def alternatives(e) -> list[Lit] | None:
    """The literals of a tree of || over == and in; None for any other tree."""
    match e:
        case Binary("||", left, right):
            a, b = alternatives(left), alternatives(right)
            return None if a is None or b is None else a + b
        case Binary("==", left, Lit() as v) if left == X:
            return [v]
        case Binary("==", Lit() as v, right) if right == X:
            return [v]
        case Binary("in", left, ListNode(items)) if left == X and all(isinstance(v, Lit) for v in items):
            return list(items)
    return None


def fitting(base: t.Type, v: Lit) -> Lit:
    kind = base.kind if isinstance(base, t.Basic) else base.lit.kind if isinstance(base, t.Literal) else None
    if kind == "float" and v.kind in ("int", "float"):
        return Lit("float", float(v.value))
    if kind == "any" or kind == v.kind:
        return v
    raise SchemaError(f"{v.value!r} is no {kind or 'value of this type'}")


def number_bound(base: t.Type, op: str, v: Lit) -> t.Bounds:
    if base == t.INT:
        if v.kind != "int" or not t.INT_MIN <= v.value <= t.INT_MAX:
            raise SchemaError("a bound of an int is an int of 64 bits")
        step = v.value + {">": 1, "<": -1}.get(op, 0)
        return t.Bounds(step) if op[0] == ">" else t.Bounds(None, step)
    if base == t.FLOAT:
        if v.kind not in ("int", "float"):
            raise SchemaError("a bound of a float is a number")
        value = float(v.value) + 0.0
        return t.Bounds(value, None, op == ">") if op[0] == ">" else t.Bounds(None, value, False, op == "<")
    raise SchemaError("only int and float have bounds")


def length_bound(base: t.Type, op: str, v: Lit) -> t.Bounds:
    if not t.has_length(base):
        raise SchemaError("only strings, lists, tuples and objects have a length")
    if v.kind != "int" or v.value < 0:
        raise SchemaError("a length is an int of 0 or more")
    if op == "==":
        return t.Bounds(v.value, v.value)
    step = v.value + {">": 1, "<": -1}.get(op, 0)
    return t.Bounds(step) if op[0] == ">" else t.Bounds(None, step)
