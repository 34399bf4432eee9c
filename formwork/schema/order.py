"""Which types lie within others; least upper and greatest lower bounds; verdicts on changes."""

from __future__ import annotations

from formwork.schema import types as t
from formwork.schema.domains import covers


def is_subtype(a: t.Type, b: t.Type) -> bool:
    """Whether each value of ``a`` is one of ``b``.  True is always right; false may mean unknown.

    What comparing normal forms doesn't settle is decided for ints and enums by their values
    (``domains``): residual expressions, and several members of a sum that cover a type together."""
    if _within(a, b):
        return True
    if isinstance(a, t.SumType):
        return False  # each member has been asked
    members = list(b.members) if isinstance(b, t.SumType) else [b]
    return (len(members) > 1 or any(t.parts(m)[1].rest for m in (a, *members))) and covers(a, members)


def _within(a: t.Type, b: t.Type) -> bool:
    """``is_subtype`` by normal forms."""
    if a == b or a == t.NEVER or b == t.ANY:
        return True
    if isinstance(a, t.SumType):
        return all(is_subtype(m, b) for m in a.members)
    if isinstance(b, t.SumType):
        return any(is_subtype(a, m) for m in b.members)
    if b == t.NEVER or a == t.ANY:
        return False
    if isinstance(b, (t.Refined, t.Literal)):
        (base, c), (over, d) = t.parts(a), t.parts(b)
        if isinstance(b, t.Literal) and b.lit.kind == "float":
            return False
        return is_subtype(base, over) and _tighter(base, c, over, d)
    if isinstance(a, (t.Refined, t.Literal)):
        if isinstance(a, t.Literal):
            return b == t.Basic(a.lit.kind) or (b == t.FLOAT and a.lit.kind == "int")
        return is_subtype(a.base, b)
    if a == t.INT and b == t.FLOAT:
        return True
    if isinstance(b, t.ListType):
        items = a.items if isinstance(a, t.TupleType) else [a.item] if isinstance(a, t.ListType) else None
        return items is not None and all(is_subtype(x, b.item) for x in items)
    if isinstance(a, t.TupleType) and isinstance(b, t.TupleType):
        return len(a.items) == len(b.items) and all(map(is_subtype, a.items, b.items))
    if isinstance(a, t.ObjectType) and isinstance(b, t.ObjectType):
        for f in a.fields:
            g = b.get(f.name)
            if g is None or (f.optional and not g.optional) or not is_subtype(f.type, g.type):
                return False
        return all(g.optional or a.get(g.name) for g in b.fields)
    return False


def _tighter(base: t.Type, c: t.Constraint, over: t.Type, d: t.Constraint) -> bool:
    """Whether base under ``c`` satisfies ``d``."""
    if not d.rest <= c.rest:
        return False
    if c.enum is not None:
        held = lambda v: v.value if v.kind == "int" and over == t.INT else float(v.value) if v.kind in ("int", "float") else None
        for v in c.enum:
            if d.enum is not None and v not in d.enum and not any(held(v) is not None and held(v) == held(w) for w in d.enum):
                return False
            if not d.bounds.free and (held(v) is None or not d.bounds.holds(held(v))):
                return False
            if not d.length.free and (v.kind != "string" or not d.length.holds(len(v.value))):
                return False
        return True
    if d.enum is not None:
        return False
    length = c.length
    if isinstance(base, t.TupleType):
        length = t.Bounds(len(base.items), len(base.items))
    elif isinstance(base, t.ObjectType):
        length = length & t.Bounds(sum(not f.optional for f in base.fields), len(base.fields))
    return c.bounds.within(d.bounds) and length.within(d.length)


def lub(*members: t.Type) -> t.Type:
    """The least type above all: their canonical sum."""
    return t.sum_of(members)


def widen(a: t.Type, b: t.Type) -> t.Type:
    """A type above both that merges objects field by field; a field that one lacks becomes optional."""
    if isinstance(a, t.ObjectType) and isinstance(b, t.ObjectType):
        fields = []
        for name in sorted({f.name for f in a.fields + b.fields}):
            f, g = a.get(name), b.get(name)
            if f and g:
                fields.append(t.Field(name, widen(f.type, g.type), f.optional or g.optional))
            else:
                fields.append(t.Field(name, (f or g).type, True))
        return t.ObjectType(tuple(fields))
    if isinstance(a, t.ListType) and isinstance(b, t.ListType):
        return t.ListType(widen(a.item, b.item))
    return lub(a, b)


def glb(a: t.Type, b: t.Type) -> t.Type:
    """The greatest type below both."""
    if is_subtype(a, b):
        return a
    if is_subtype(b, a):
        return b
    if isinstance(a, t.SumType):
        return t.sum_of([glb(m, b) for m in a.members])
    if isinstance(b, t.SumType):
        return t.sum_of([glb(a, m) for m in b.members])
    if isinstance(a, (t.Refined, t.Literal)) or isinstance(b, (t.Refined, t.Literal)):
        (base, c), (other, d) = t.parts(a), t.parts(b)
        if isinstance(base, t.Literal) or isinstance(other, t.Literal):
            return t.NEVER
        low = glb(base, other)
        if low == t.NEVER:
            return low
        if low == t.INT and t.FLOAT in (base, other):
            whole = lambda x: _whole(x)
            c, d = (whole(x) if of == t.FLOAT else x for of, x in ((base, c), (other, d)))
        return t.refined(low, c & d)
    if {a, b} == {t.INT, t.FLOAT}:
        return t.INT
    if isinstance(a, t.ListType) and isinstance(b, t.ListType):
        return t.ListType(glb(a.item, b.item))
    if isinstance(a, t.TupleType) or isinstance(b, t.TupleType):
        pair = (a, b) if isinstance(a, t.TupleType) else (b, a)
        others = pair[1].items if isinstance(pair[1], t.TupleType) else [pair[1].item] * len(pair[0].items) if isinstance(pair[1], t.ListType) else None
        if others is None or len(others) != len(pair[0].items):
            return t.NEVER
        items = tuple(map(glb, pair[0].items, others))
        return t.NEVER if t.NEVER in items else t.TupleType(items)
    if isinstance(a, t.ObjectType) and isinstance(b, t.ObjectType):
        fields = []
        for name in sorted({f.name for f in a.fields + b.fields}):
            f, g = a.get(name), b.get(name)
            if f and g:
                low, optional = glb(f.type, g.type), f.optional and g.optional
                if low == t.NEVER and not optional:
                    return t.NEVER
                fields.append(t.Field(name, low, optional))
            elif not (f or g).optional:
                return t.NEVER
        return t.ObjectType(tuple(fields))
    return t.NEVER


def _whole(c: t.Constraint) -> t.Constraint:
    """A constraint of floats as one of ints."""
    import math

    b = c.bounds
    low = None if b.low is None else math.floor(b.low) + 1 if b.low_open else math.ceil(b.low)
    high = None if b.high is None else math.ceil(b.high) - 1 if b.high_open else math.floor(b.high)
    enum = None if c.enum is None else frozenset(t.Lit("int", int(v.value)) for v in c.enum if float(v.value).is_integer())
    return t.Constraint(t.Bounds(low, high), c.length, enum, c.rest)


def compare(old: t.Type, new: t.Type) -> str:
    """What a change from ``old`` to ``new`` is: equal, widening, narrowing or breaking."""
    up, down = is_subtype(old, new), is_subtype(new, old)
    return "equal" if up and down else "widening" if up else "narrowing" if down else "breaking"
