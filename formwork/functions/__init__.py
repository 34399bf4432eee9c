"""Functions that schema expressions can call, each from columns to a column."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the format functions (fixed values).
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$"
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


_RFC3339 = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"
#: Patterns of the layouts that have names; any of them may fit.
LAYOUTS = {"rfc3339": (_RFC3339,), "date": ("yyyy-MM-dd",), "time": ("HH:mm:ss",), "datetime": ("yyyy-MM-dd HH:mm:ss", _RFC3339)}
#: Letters that Spark's patterns read, and how often each may stand in a row.
_LETTERS = {"G": 5, "y": 6, "M": 4, "L": 4, "d": 2, "D": 3, "a": 1, "H": 2, "h": 2, "K": 2, "k": 2, "m": 2, "s": 2, "S": 9, "V": 2, "z": 4, "O": 4, "X": 5, "x": 5}


def layouts(name: str) -> tuple[str, ...]:
    """The patterns of a layout: a name of ``LAYOUTS``, or a pattern of Spark's, which is checked."""
    if name in LAYOUTS:
        return LAYOUTS[name]
    if not isinstance(name, str) or not name:
        raise ValueError("parsedate needs a layout's name or pattern")
    bare = re.sub(r"'(?:[^']|'')*'", "", name)
    if "'" in bare or any(run[0] not in _LETTERS or len(run) > _LETTERS[run[0]] for run in (m[0] for m in re.finditer(r"([A-Za-z])\1*", bare))) or re.search("[{}#]", bare) or bare.count("[") != bare.count("]"):
        raise ValueError(f"neither a layout's name nor a pattern: {name!r}")
    return (name,)


def _dated(x: Column, *patterns: Column | str) -> Column:
    return reduce(or_, (F.try_to_timestamp(x, F.lit(p)).isNotNull() for p in patterns))


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


REGISTRY: dict[str, Callable[..., Column]] = {
    "match": lambda x, pattern: F.rlike(x, pattern),
    "startsWith": lambda x, s: F.startswith(x, s),
    "endsWith": lambda x, s: F.endswith(x, s),
    "contains": lambda x, s: F.contains(x, s),
    "email": _matches(EMAIL),
    "uuid": _matches(UUID),
    "url": _matches(URL),
    "ipv4": _matches(IPV4),
    "parsedate": lambda x, layout: _dated(x, *layouts(layout)),
}
#: What the format functions make of an accepted value.
NORMAL: dict[str, Callable[[Column], Column]] = {"email": F.lower, "uuid": F.lower, "url": F.trim, "ipv4": F.trim}


def arguments(name: str) -> int | None:
    """How many arguments a function takes; None if that is open or the function unknown."""
    if name == "len":
        return 1
    if name not in REGISTRY:
        return None
    given = inspect.signature(REGISTRY[name]).parameters.values()
    fixed = all(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty for p in given)
    return len(given) if fixed else None


def register(name: str, function: Callable[..., Column]) -> None:
    """Let schemas call ``function`` (of columns, the value first) by ``name``."""
    REGISTRY[name] = function


def normalize(name: str, column: Column) -> Column:
    """The normal form of values that the format function ``name`` accepts; others become null."""
    return F.when(REGISTRY[name](column), NORMAL[name](column))
