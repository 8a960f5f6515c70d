"""Statements and expressions as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Param:
    index: int


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    """A scalar function."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any
    distinct: bool = False


@dataclass(frozen=True)
class Op:
    """Arithmetic, comparison or logic on two sides."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Negative:
    arg: Any


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool


@dataclass(frozen=True)
class InList:
    arg: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    arg: Any
    query: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Scalar:
    """A sub-query that gives one value."""

    query: Any


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Relation:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    relation: Relation
    on: Any


@dataclass
class Select:
    items: list[Item]
    source: Relation
    joins: list[Join] = field(default_factory=list)
    where: Any = None
    group: list[Col] = field(default_factory=list)
    having: Any = None
    order: list[tuple[Col, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False


@dataclass
class Union:
    branches: list[Select]
    every: list[bool]  # UNION ALL between branch k and k + 1


@dataclass
class Statement:
    """Anything but a query: a kind and its parts."""

    kind: str
    parts: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None
