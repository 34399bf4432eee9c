"""Canonical types: equal sets of values, as far as the language can tell, are equal objects."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field, replace

from formwork.schema.syntax import Binary, Lit, show

KINDS = ("any", "never", "null", "bool", "int", "float", "string", "huge")
#: Integers up to here count as floats (a fixed value of the language).
FLOAT_LIMIT = 1 << 54
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
#: The kind ``huge`` has the integers beyond an int that unsigned 64 bits hold.
HUGE_MAX = (1 << 64) - 1


@dataclass(frozen=True)
class Type:
    def __str__(self) -> str:
        return text_of(self)

    @property
    def fingerprint(self) -> str:
        """A digest that is the same in every session."""
        return hashlib.sha256(str(self).encode()).hexdigest()


@dataclass(frozen=True)
class Basic(Type):
    kind: str


@dataclass(frozen=True)
class Literal(Type):
    lit: Lit


@dataclass(frozen=True)
class ListType(Type):
    item: Type


@dataclass(frozen=True)
class TupleType(Type):
    items: tuple


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    optional: bool = False


@dataclass(frozen=True)
class ObjectType(Type):
    fields: tuple  # of Field, by name

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class SumType(Type):
    members: tuple  # by text


@dataclass(frozen=True)
class Bounds:
    """An interval; None is no bound."""

    low: float | int | None = None
    high: float | int | None = None
    low_open: bool = False
    high_open: bool = False

    def __and__(self, other: Bounds) -> Bounds:
        low, high = (self.low, self.low_open), (self.high, self.high_open)
        if other.low is not None and (low[0] is None or (other.low, other.low_open) > low):
            low = (other.low, other.low_open)
        if other.high is not None and (high[0] is None or (other.high, not other.high_open) < (high[0], not high[1])):
            high = (other.high, other.high_open)
        return Bounds(low[0], high[0], low[1], high[1])

    @property
    def free(self) -> bool:
        return self.low is None and self.high is None

    @property
    def empty(self) -> bool:
        return self.low is not None and self.high is not None and (self.low > self.high or (self.low == self.high and (self.low_open or self.high_open)))

    def holds(self, v) -> bool:
        return (self.low is None or v > self.low or (v == self.low and not self.low_open)) and (self.high is None or v < self.high or (v == self.high and not self.high_open))

    def within(self, other: Bounds) -> bool:
        return (self & other) == self

    def joined(self, other: Bounds, whole: bool) -> Bounds | None:
        """The union if it is an interval; ``whole``: numbers are integers."""
        a, b = sorted((self, other), key=lambda x: (x.low is not None, x.low or 0, x.low_open))
        if a.high is not None and b.low is not None:
            gap = b.low > a.high + 1 if whole else b.low > a.high or (b.low == a.high and a.high_open and b.low_open)
            if gap:
                return None
        ends = [(x.high, not x.high_open) for x in (a, b)]
        high, closed = (None, True) if None in (a.high, b.high) else max(ends)
        return Bounds(a.low, high, a.low_open, not closed)


@dataclass(frozen=True)
class Constraint:
    """bounds: of the number; length: of the length; enum: the literals allowed (None: all);
    rest: expressions that no normal form covers, all of which must hold."""

    bounds: Bounds = Bounds()
    length: Bounds = Bounds()
    enum: frozenset | None = None
    rest: frozenset = field(default_factory=frozenset)

    def __and__(self, other: Constraint) -> Constraint:
        both = self.enum if other.enum is None else other.enum if self.enum is None else self.enum & other.enum
        return Constraint(self.bounds & other.bounds, self.length & other.length, both, self.rest | other.rest)


@dataclass(frozen=True)
class Refined(Type):
    base: Type
    constraint: Constraint


ANY, NEVER, NULL, BOOL, INT, FLOAT, STRING, HUGE = (Basic(k) for k in KINDS)


def key(value: Lit) -> tuple:
    """The order of literals: kind, then value."""
    v = value.value
    return KINDS.index(value.kind), 0 if v is None else v.encode() if isinstance(v, str) else v


def clean(value: Lit) -> Lit:
    """-0.0 is 0.0."""
    return Lit("float", 0.0) if value.kind == "float" and value.value == 0 else value


def literal(value: Lit) -> Type:
    return NULL if value.kind == "null" else Literal(clean(value))


def has_length(base: Type) -> bool:
    return base == STRING or isinstance(base, (ListType, TupleType, ObjectType)) or (isinstance(base, Literal) and base.lit.kind == "string")


def refined(base: Type, c: Constraint) -> Type:
    """The normal form of a base type under a constraint."""
    if isinstance(base, Refined):
        return refined(base.base, base.constraint & c)
    if isinstance(base, Literal) and base.lit.kind != "float":
        return refined(Basic(base.lit.kind), Constraint(enum=frozenset([base.lit])) & c)
    if base == NEVER or c.bounds.empty or c.length.empty:
        return NEVER
    if c.length.low is not None and c.length.low <= 0:
        c = replace(c, length=Bounds(None, c.length.high))
        if c.length.high is not None and c.length.high < 0:
            return NEVER
    if c.length.high is not None and c.length.high < 0:
        return NEVER
    if isinstance(base, TupleType) and not c.length.free:
        if not c.length.holds(len(base.items)):
            return NEVER
        c = replace(c, length=Bounds())
    if c.enum is None and base == INT and c.bounds.low is not None and c.bounds.low == c.bounds.high:
        c = replace(c, enum=frozenset([Lit("int", c.bounds.low)]), bounds=Bounds())
    if c.enum is None and base == FLOAT and c.bounds.low is not None and c.bounds.low == c.bounds.high:
        c = replace(c, enum=frozenset([Lit("float", float(c.bounds.low))]), bounds=Bounds())
    if c.enum is not None:
        kept = frozenset(clean(v) for v in c.enum if (v.kind not in ("int", "float") or c.bounds.holds(v.value)) and (v.kind != "string" or c.length.holds(len(v.value))))
        c = replace(c, enum=kept, bounds=Bounds(), length=Bounds() if base == STRING else c.length)
        if not kept:
            return NEVER
        if base == BOOL and len(kept) == 2:
            c = replace(c, enum=None)
        elif base == INT and len(kept) > 1:
            values = [v.value for v in kept]
            if max(values) - min(values) + 1 == len(values):
                c = replace(c, enum=None, bounds=Bounds(min(values), max(values)))
        elif len(kept) == 1 and not c.rest and base in (NULL, BOOL, INT, STRING):
            return literal(next(iter(kept)))
    if base == INT:
        low, high = c.bounds.low, c.bounds.high
        c = replace(c, bounds=Bounds(None if low is not None and low <= INT_MIN else low, None if high is not None and high >= INT_MAX else high))
        if (low is not None and low > INT_MAX) or (high is not None and high < INT_MIN):
            return NEVER
    if isinstance(base, Literal) and c.enum is None and c.bounds.free:
        if base.lit.kind == "string" and not c.length.holds(len(base.lit.value)):
            return NEVER
        c = replace(c, length=Bounds())
    return base if c == Constraint() else Refined(base, c)


# ------------------------------------------------------------------------------------ sums


def sum_of(members) -> Type:
    """The union of types: flat, without what others cover, neighbours of one base joined."""
    flat: list[Type] = []
    for m in members:
        flat += m.members if isinstance(m, SumType) else [m]
    flat = sorted({m for m in flat if m != NEVER}, key=str)
    if ANY in flat:
        return ANY
    flat = sorted(set(_merged(sorted(set(_united(flat)), key=str))), key=str)
    if not flat:
        return NEVER
    return flat[0] if len(flat) == 1 else SumType(tuple(flat))


def _united(flat: list[Type]) -> list[Type]:
    """Enums of one base as one, and intervals of numbers that touch as one: what would join pair
    by pair, in the time of a sort."""
    enums: dict[tuple, set] = {}
    ranges: dict[tuple, list[Bounds]] = {}
    out = []
    for m in flat:
        base, c = parts(m)
        if c.enum is not None:
            enums.setdefault((base, c.bounds, c.length, c.rest), set()).update(c.enum)
        elif base in (INT, FLOAT) and c.length.free and not c.bounds.free:
            ranges.setdefault((base, c.rest), []).append(c.bounds)
        else:
            out.append(m)
    out += [refined(base, Constraint(bounds, length, frozenset(values), rest)) for (base, bounds, length, rest), values in enums.items()]
    for (base, rest), held in ranges.items():
        held.sort(key=lambda b: (b.low is not None, b.low or 0, b.low_open))
        done = held[:1]
        for b in held[1:]:
            both = done[-1].joined(b, base == INT)
            done[-1:] = [both] if both else [done[-1], b]
        out += [refined(base, Constraint(b, rest=rest)) for b in done]
    return out


def _merged(flat: list[Type]) -> list[Type]:
    """Members of which no two can be said by one type: each is held against those before it, and
    what two make together begins anew."""
    from formwork.schema.order import is_subtype

    out: list[Type] = []
    waiting = list(reversed(flat))
    while waiting:
        a = waiting.pop()
        for i, b in enumerate(out):
            one = b if is_subtype(a, b) else a if is_subtype(b, a) else joined(b, a)
            if one == b:
                break
            if one is not None:
                del out[i]
                waiting.append(one)
                break
        else:
            out.append(a)
    return out


def parts(t: Type) -> tuple[Type, Constraint]:
    """Base and constraint of any type; a literal is its kind with one value."""
    if isinstance(t, Refined):
        return t.base, t.constraint
    if isinstance(t, Literal) and t.lit.kind != "float":
        return Basic(t.lit.kind), Constraint(enum=frozenset([t.lit]))
    return t, Constraint()


def joined(a: Type, b: Type) -> Type | None:
    """The union of two types of one base, if one type can say it."""
    (base, c), (other, d) = parts(a), parts(b)
    if base != other or c.rest != d.rest:
        return None
    if c.enum is not None and d.enum is not None:
        return refined(base, Constraint(c.bounds, c.length, c.enum | d.enum, c.rest)) if c.length == d.length else None
    if c.enum is not None or d.enum is not None:
        few, wide = (c, d) if c.enum is not None else (d, c)
        if base == INT and wide.length.free and few.length.free:
            bounds = wide.bounds
            for v in sorted(few.enum, key=key):
                bounds = bounds and bounds.joined(Bounds(v.value, v.value), True)
            return refined(base, Constraint(bounds, rest=c.rest)) if bounds else None
        return None
    if c.length == d.length:
        bounds = c.bounds.joined(d.bounds, base == INT)
        return refined(base, Constraint(bounds, c.length, None, c.rest)) if bounds else None
    if c.bounds == d.bounds:
        length = c.length.joined(d.length, True)
        return refined(base, Constraint(c.bounds, length, None, c.rest)) if length else None
    return None


# ------------------------------------------------------------------------------------ text


def _bounds_text(name: str, b: Bounds) -> list[str]:
    out = []
    if b.low is not None:
        out.append(f"{name}{'>' if b.low_open else '>='}{b.low!r}")
    if b.high is not None:
        out.append(f"{name}{'<' if b.high_open else '<='}{b.high!r}")
    return out


def text_of(t: Type, optional: bool = False) -> str:
    """The type as a schema's text; reading it gives the type again."""
    flag = ",optional" if optional else ""
    match t:
        case Basic(kind):
            return f"({kind}{flag})"
        case Literal(value):
            return f"({show(value)}{flag})" if optional else show(value)
        case ListType(item):
            return f"([{text_of(item)}]{flag})" if optional or not isinstance(item, Literal) and not isinstance(item, TupleType) else f"([{text_of(item)}])"
        case TupleType(items):
            inner = "#{" + ",".join(map(text_of, items)) + "}"
        case ObjectType(fields):
            inner = "{" + ",".join(f"{json.dumps(f.name, ensure_ascii=False)}:{text_of(f.type, f.optional)}" for f in fields) + "}"
        case SumType(members):
            inner = "|".join(text_of(m) if text_of(m).startswith("(") else f"({text_of(m)})" for m in members)
        case Refined(base, c):
            clauses = _bounds_text("x", c.bounds) + _bounds_text("len(x)", c.length)
            if c.enum is not None:
                clauses.append(f"x in [{','.join(show(v) for v in sorted(c.enum, key=key))}]")
            clauses += sorted(f"({show(e)})" if isinstance(e, Binary) and e.op in ("&&", "||") else show(e) for e in c.rest)
            name = base.kind if isinstance(base, Basic) else text_of(base)
            return f"({name},{','.join(clauses)}{flag})"
        case _:
            raise TypeError(t)
    return f"({inner}{flag})" if optional else inner


def finite(x: float) -> bool:
    return not (math.isnan(x) or math.isinf(x))
