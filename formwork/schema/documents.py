"""Schemas in several documents that name each other's types: ``user`` in one is the document ``user``."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from formwork.schema import types as t
from formwork.schema.compile import _ALIASES, SIZED, Compiler
from formwork.schema.syntax import ListNode, Name, ObjectNode, Reader, SchemaError, SchemaNode, SumNode, TupleNode

#: Given a name that no document has, a schema (text or type), or None.
Host = Callable[[str], "str | t.Type | None"]


class DocumentError(SchemaError):
    """An error in one of several documents; ``document`` names it, ``line`` counts from 1."""

    def __init__(self, message: str, document: str, text: str, at: int | None):
        self.document, self.line = document, None if at is None else text.count("\n", 0, at) + 1
        place = document if at is None else f"{document}:{self.line}"
        super().__init__(f"{place}: {re.sub(r' [(]at [0-9]+[)]$', '', message)}")
        self.at = at


def named(node) -> set[str]:
    """The names of types that a node refers to, but for those of the language."""
    match node:
        case SchemaNode(ref, _):
            own = {ref.name} - set(t.KINDS) - set(SIZED) if isinstance(ref, Name) else set()
            return own if isinstance(ref, Name) else named(ref)
        case ListNode(items) | TupleNode(items) | SumNode(items):
            return set().union(*map(named, items))
        case ObjectNode(fields):
            return set().union(*(named(v) for _, v in fields))
    return set()


@dataclass
class Documents:
    """Compiles documents that depend on each other, each once, whatever depends on it.

    ``texts``: schemas by name; ``host``: gives types that are defined elsewhere.  Dependencies are followed
    before anything is compiled, so that cycles and names that nobody knows are told with their document."""

    texts: dict[str, str]
    host: Host = lambda name: None
    _nodes: dict[str, tuple] = field(default_factory=dict)
    _types: dict[str, t.Type] = field(default_factory=dict)

    def _node(self, name: str) -> tuple:
        """The document's node and places."""
        if name not in self._nodes:
            try:
                reader = Reader(self.texts[name])
                self._nodes[name] = reader.document(), reader.places
            except SchemaError as e:
                raise self._error(name, e) from None
        return self._nodes[name]

    def _error(self, name: str, e: SchemaError) -> DocumentError:
        return DocumentError(str(e), name, self.texts[name], e.at)

    def graph(self) -> dict[str, set[str]]:
        """The other documents that each document names."""
        return {name: named(self._node(name)[0]) & set(self.texts) for name in self.texts}

    def order(self) -> list[str]:
        """Documents, each behind all that it names."""
        graph, done, path = self.graph(), [], []

        def visit(name: str) -> None:
            if name in done:
                return
            if name in path:
                cycle = " -> ".join([*path[path.index(name) :], name])
                raise DocumentError(f"documents name each other in a circle: {cycle}", name, self.texts[name], None)
            path.append(name)
            for other in sorted(graph[name]):
                visit(other)
            path.pop()
            done.append(name)

        for name in sorted(graph):
            visit(name)
        return done

    def compile(self, name: str) -> t.Type:
        """The type of a document."""
        if name not in self.texts:
            raise SchemaError(f"no document {name!r}")
        if not self._types:
            for one in self.order():
                self._types[one] = self._compiled(one)
        return self._types[name]

    def _compiled(self, name: str) -> t.Type:
        node, places = self._node(name)
        names: dict = {}
        for other in named(node):
            known = self._types.get(other)
            if known is None and other not in _ALIASES:
                known = self.host(other)
            if known is not None:
                names[other] = known if isinstance(known, str) else str(known)
        try:
            return Compiler(node, names, places).whole(node)
        except SchemaError as e:
            raise self._error(name, e) from None

    def all(self) -> dict[str, t.Type]:
        return {name: self.compile(name) for name in self.texts}
