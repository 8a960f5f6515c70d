"""Queries of the dialect compiled to DataFrames: one Spark SQL text over the tables' DataFrames, left to Catalyst.

Predicates stay declarative, so Catalyst pushes them to the Parquet scan, prunes columns, turns IN sub-queries into semi joins, ORDER BY with
LIMIT into a top-k, and picks and re-plans joins by size.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import SyntaxProblem
from ..functions.scalar import Bound, Renderer, Scope, plain, quoted
from ..plans import nodes as n


_planning = threading.RLock()


@contextmanager
def dialect_settings(spark: SparkSession) -> Iterator[None]:
    """Integers wrap and bad casts are NULL while a plan is made, by one thread at a time; the caller's settings come back afterwards."""
    with _planning:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


class Compiler:
    """Compiles one statement. table gives a relation's DataFrame by name.

    compat turns on results of the older dialect where they differ from SQL: a chain with any plain UNION drops
    all duplicates, * over a join is one JSON column, a bare column beside aggregates takes a row's value, and aggregates are as Renderer says.
    """

    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], params: list[Any] | None = None, compat: bool = False):
        self.spark, self.table, self.params, self.compat = spark, table, list(params or []), compat
        self.bound = Bound()
        self.frames: dict[str, DataFrame] = {}
        self.named: dict[str, str] = {}

    def run(self, query: n.Select | n.Union) -> DataFrame:
        with dialect_settings(self.spark):
            return self.spark.sql(self.query(query), args=self.bound.values, **self.frames)

    def frame(self, name: str) -> tuple[str, DataFrame]:
        if name not in self.named:
            self.named[name] = f"r{len(self.frames)}"
            self.frames[self.named[name]] = self.table(name)
        key = self.named[name]
        return "{" + key + "}", self.frames[key]

    def query(self, query: n.Select | n.Union) -> str:
        if isinstance(query, n.Select):
            return self.select(query)
        # an ORDER BY or LIMIT belongs to its branch
        out = f"({self.select(query.branches[0])})"
        for branch, every in zip(query.branches[1:], query.every, strict=True):
            out = f"({out} UNION {'ALL' if every or self.compat else 'DISTINCT'} ({self.select(branch)}))"
        if self.compat and not all(query.every):
            return f"SELECT DISTINCT * FROM {out}"
        return f"SELECT * FROM {out}"

    def inner(self, query: n.Select | n.Union, not_in: bool) -> str:
        """A sub-query: its first column; NOT IN ignores its NULLs."""
        if isinstance(query, n.Select) and len(query.items) > 1:
            query = n.Select(query.items[:1], query.source, query.joins, query.where, query.group, query.having, query.order, query.limit, query.offset, query.distinct)
        text = self.query(query)
        return f"SELECT * FROM ({text}) AS t(v) WHERE v IS NOT NULL" if not_in else text

    def without(self, e: Any, value: Callable[[Any], str]) -> str | None:
        """A conjunct x NOT IN (sub-query) as an anti join on equality, which may shuffle; Spark broadcasts the sub-query of any other NOT IN, whatever its size.

        A NULL x passes only if the sub-query gives nothing.
        """
        if not isinstance(e, n.InQuery) or not e.negated or not plain(e.arg):
            return None
        x, rows = value(e.arg), self.inner(e.query, True)
        return f"(NOT EXISTS (SELECT 1 FROM ({rows}) AS __not_in(v) WHERE __not_in.v = {x}) AND ({x} IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ({rows}) AS __not_in(v))))"

    def where(self, e: Any, value: Callable[[Any], str]) -> str:
        """A WHERE's predicate, with anti joins for its NOT IN conjuncts."""
        return " AND ".join(self.without(c, value) or value(c) for c in _conjuncts(e))

    def kind(self, query: n.Select | n.Union) -> str:
        """The kind of a sub-query's first column."""
        q = query if isinstance(query, n.Select) else query.branches[0]
        scope = Scope([(r.alias or r.name.rpartition(".")[2], dict(self.frame(r.name)[1].dtypes)) for r in (q.source, *(j.relation for j in q.joins))])
        first = q.items[0].expr
        if isinstance(first, n.Star):
            alias, columns = scope.relations[0]
            first = n.Col(next(iter(columns)), alias)
        return Renderer(scope, self.bound, self.inner, self.params, self.compat, self.kind).kind(first)

    def select(self, q: n.Select) -> str:
        relations: list[tuple[str, dict[str, str]]] = []
        sources: list[str] = []
        for relation in (q.source, *(j.relation for j in q.joins)):
            alias = relation.alias or relation.name.rpartition(".")[2]
            if any(alias.lower() == a.lower() for a, _ in relations):
                raise SyntaxProblem(f"{alias} names two relations; give one an alias")
            marker, frame = self.frame(relation.name)
            relations.append((alias, dict(frame.dtypes)))
            sources.append(f"{marker} AS {quoted(alias)}")
        scope = Scope(relations)
        render = Renderer(scope, self.bound, self.inner, self.params, self.compat, self.kind)

        def value(e: Any) -> str:
            return render(_first_rows(e))

        text = sources[0]
        for join, source in zip(q.joins, sources[1:], strict=True):
            text += f" {join.kind} JOIN {source} ON {value(join.on)}"
        aggregated = bool(q.group) or q.having is not None or any(_has_aggregate(i.expr) for i in q.items)
        columns, names = [], []
        for item in q.items:
            if isinstance(item.expr, n.Star):
                if aggregated:
                    raise SyntaxProblem("* can't stand beside aggregates")
                got = self.star(relations, bool(q.joins))
                columns += [c for c, _ in got]
                names += [name for _, name in got]
                continue
            name = item.alias or _default_name(item.expr)
            text_ = value(item.expr)
            if self.compat and aggregated and isinstance(item.expr, n.Col) and not any(scope.find(item.expr) == scope.find(g) for g in q.group):
                text_ = f"first({text_})"  # some row's value
            columns.append(f"{text_} AS {quoted(name)}")
            names.append(name)
        out = f"SELECT {'DISTINCT ' * q.distinct}{', '.join(columns)} FROM {text}"
        if q.where is not None:
            out += f" WHERE {self.where(q.where, value)}"
        if q.group:
            out += " GROUP BY " + ", ".join(render(c) for c in q.group)
        if q.having is not None:
            out += f" HAVING {value(q.having)}"
        if q.order:
            out += " ORDER BY " + ", ".join(f"{self.key(c, names, render, q.distinct or aggregated)} {'DESC NULLS FIRST' if down else 'ASC NULLS LAST'}" for c, down in q.order)
        if q.limit is not None:
            out += f" LIMIT {q.limit}"
        if q.offset is not None:
            out += f" OFFSET {q.offset}"
        return out

    def key(self, col: n.Col, names: list[str], render: Renderer, only_output: bool) -> str:
        """What ORDER BY sorts by: an output column if it has the name, else a column of the relations."""
        if col.table is None and col.name in names:
            return quoted(col.name)
        text = render(col)
        if only_output and col.name in names:
            return quoted(col.name)
        return text

    def star(self, relations: list[tuple[str, dict[str, str]]], joined: bool) -> list[tuple[str, str]]:
        if not joined:
            alias, columns = relations[0]
            return [(f"{quoted(alias)}.{quoted(c)}", c) for c in columns]
        if self.compat:
            fields = ", ".join(f"{self.bound.add(f'{alias}.{c}')}, {quoted(alias)}.{quoted(c)}" for alias, columns in relations for c in columns)
            return [(f"to_json(named_struct({fields})) AS `*`", "*")]
        return [(f"{quoted(alias)}.{quoted(c)} AS {quoted(f'{alias}_{c}')}", f"{alias}_{c}") for alias, columns in relations for c in columns]


def _conjuncts(e: Any) -> list[Any]:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, n.Op) and e.op == "AND" else [e]


def _first_rows(e: Any) -> Any:
    """The expression with every scalar sub-query limited to one row."""
    if isinstance(e, n.Scalar):
        q = e.query
        if isinstance(q, n.Select) and q.limit is None and not (not q.group and any(_has_aggregate(i.expr) for i in q.items)):
            return n.Scalar(n.Select(q.items, q.source, q.joins, q.where, q.group, q.having, q.order, 1, q.offset, q.distinct))
        return e
    if hasattr(e, "__dataclass_fields__") and not isinstance(e, (n.Select, n.Union, n.Statement)):
        return type(e)(*(_first_rows(getattr(e, f)) for f in e.__dataclass_fields__))
    return tuple(map(_first_rows, e)) if isinstance(e, tuple) else e


def _has_aggregate(e: Any) -> bool:
    if isinstance(e, n.Agg):
        return True
    if isinstance(e, (n.Scalar, n.InQuery)):
        return isinstance(e, n.InQuery) and _has_aggregate(e.arg)
    if hasattr(e, "__dataclass_fields__"):
        return any(_has_aggregate(getattr(e, f)) for f in e.__dataclass_fields__)
    return isinstance(e, tuple) and any(map(_has_aggregate, e))


def _default_name(e: Any) -> str:
    match e:
        case n.Col(name, _):
            return name
        case n.Agg(name, n.Star(), _):
            return f"{name}(*)"
        case n.Agg(name, n.Col(column, _), distinct):
            return f"{name}({'DISTINCT ' * distinct}{column})"
        case n.Agg(name, _, _):
            return name
        case n.Call(name, _):
            return name.lower()
    return "expr"
