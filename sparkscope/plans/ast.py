"""Expressions of the metric query language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

SCALAR, VECTOR, MATRIX, STRING = "scalar", "instant vector", "range vector", "string"


class QueryError(ValueError):
    """The query's text is not valid."""


@dataclass
class Node:
    def type(self) -> str:
        raise NotImplementedError

    def walk(self) -> Iterator[Node]:
        """This node and all below, parents first."""
        yield self
        for f in fields(self):
            value = getattr(self, f.name)
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, Node):
                    yield from x.walk()


@dataclass
class Number(Node):
    value: float

    def type(self) -> str:
        return SCALAR


@dataclass
class Text(Node):
    value: str

    def type(self) -> str:
        return STRING


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str


@dataclass
class Selector(Node):
    matchers: list[Matcher]
    offset: float = 0.0
    at: float | str | None = None  # a time, "start" or "end"

    def type(self) -> str:
        return VECTOR


@dataclass
class Range(Node):
    selector: Selector
    seconds: float

    def type(self) -> str:
        return MATRIX


@dataclass
class Subquery(Node):
    inner: Node
    seconds: float
    step: float | None
    offset: float = 0.0
    at: float | str | None = None

    def type(self) -> str:
        return MATRIX


@dataclass
class Paren(Node):
    inner: Node

    def type(self) -> str:
        return self.inner.type()


@dataclass
class Unary(Node):
    op: str
    inner: Node

    def type(self) -> str:
        return self.inner.type()


@dataclass
class Matching:
    on: bool = False
    labels: list[str] = field(default_factory=list)
    group: str = "one"  # one, left, right
    include: list[str] = field(default_factory=list)


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node
    returns_bool: bool = False
    matching: Matching | None = None

    def type(self) -> str:
        return SCALAR if self.left.type() == SCALAR == self.right.type() else VECTOR


@dataclass
class Aggregate(Node):
    op: str
    inner: Node
    param: Node | None = None
    labels: list[str] = field(default_factory=list)
    exclude: bool = False

    def type(self) -> str:
        return VECTOR


@dataclass
class Call(Node):
    name: str
    args: list[Node]
    returns: str

    def type(self) -> str:
        return self.returns
