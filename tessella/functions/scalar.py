"""Expressions of the dialect rendered as Spark SQL, with the values of literals and parameters bound, never spliced in.

Spark already has the three-valued logic of the dialect. What differs is settled here: integer division truncates and dividing by zero is NULL, LENGTH
counts bytes, LIKE has no escape character, and TRIM takes tabs and line ends too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..errors import NotFound, SyntaxProblem
from ..plans import nodes as n

#: Functions of the dialect, and how many arguments each takes (None: one or more).
FUNCTIONS = {"ABS": 1, "LENGTH": 1, "CHAR_LENGTH": 1, "UPPER": 1, "LOWER": 1, "TRIM": 1, "COALESCE": None, "NULLIF": 2}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def plain(e: Any) -> bool:
    """No sub-query inside."""
    if isinstance(e, (n.Scalar, n.InQuery)):
        return False
    if hasattr(e, "__dataclass_fields__"):
        return all(plain(getattr(e, f)) for f in e.__dataclass_fields__)
    return all(map(plain, e)) if isinstance(e, tuple) else True


@dataclass
class Bound:
    """Values of a statement's literals, by the marker that stands for each."""

    values: dict[str, Any] = field(default_factory=dict)

    def add(self, value: Any) -> str:
        name = f"p{len(self.values)}"
        self.values[name] = value
        return f":{name}"


class Scope:
    """The relations that names resolve in: alias to columns with their Spark types, in order."""

    def __init__(self, relations: list[tuple[str, dict[str, str]]]):
        self.relations = relations

    def find(self, col: n.Col) -> tuple[str, str, str]:
        """(alias, column, type); the first relation that has an unqualified name is meant."""
        for alias, columns in self.relations:
            if (col.table is None or alias.lower() == col.table.lower()) and col.name in columns:
                return alias, col.name, columns[col.name]
        raise NotFound(f"no column {col.table + '.' if col.table else ''}{col.name}")


_WHOLE = {"tinyint", "smallint", "int", "bigint"}
_REAL = {"float", "double"}


class Renderer:
    """Renders expressions over one scope. query renders a sub-query, query_kind tells its first column's kind; params are the statement's parameters from 1.

    compat: DISTINCT counts in COUNT only, and sums and averages are rounded to four decimals.
    """

    def __init__(self, scope: Scope, bound: Bound, query: Callable[[Any, bool], str], params: list[Any], compat: bool = False, query_kind: Callable[[Any], str] = lambda _: "other"):
        self.scope, self.bound, self.query, self.params, self.compat, self.query_kind = scope, bound, query, params, compat, query_kind

    def kind(self, e: Any) -> str:
        """whole, real, text, bool, null or other: as much of an expression's type as the dialect's rules need."""
        match e:
            case n.Param(index) if 1 <= index <= len(self.params):
                return self.kind(n.Lit(self.params[index - 1]))
            case n.Lit(None):
                return "null"
            case n.Lit(value):
                return "bool" if isinstance(value, bool) else "whole" if isinstance(value, int) else "real" if isinstance(value, float) else "text" if isinstance(value, str) else "other"
            case n.Col():
                kind = self.scope.find(e)[2]
                return "whole" if kind in _WHOLE else "real" if kind in _REAL else "text" if kind == "string" else "bool" if kind == "boolean" else "other"
            case n.Op("+" | "-" | "*" | "/", left, right):
                return "whole" if {self.kind(left), self.kind(right)} <= {"whole", "null"} else "real"
            case n.Negative(arg) | n.Call("ABS", (arg,)):
                return self.kind(arg)
            case n.Call("LENGTH" | "CHAR_LENGTH", _) | n.Agg("COUNT", _, _):
                return "whole"
            case n.Call("COALESCE", args):
                return self.common(args)
            case n.Call("NULLIF", args):
                return self.kind(args[0])
            case n.Scalar(query):
                return self.query_kind(query)
            case n.Agg("AVG", _, _):
                return "real"
            case n.Agg(_, arg, _):
                return self.kind(arg)
            case n.Case(whens, default):
                return self.common([*(v for _, v in whens), default])
            case n.Call("UPPER" | "LOWER" | "TRIM", _):
                return "text"
        return "other"

    def common(self, values: Any) -> str:
        """The kind of a value that is one of several; NULL is of any kind."""
        kinds = {self.kind(v) for v in values} - {"null"}
        return kinds.pop() if len(kinds) == 1 else "null" if not kinds else "real" if kinds == {"whole", "real"} else "other"

    def __call__(self, e: Any) -> str:
        match e:
            case n.Lit(None):
                return "NULL"
            case n.Lit(value):
                return self.bound.add(value)
            case n.Param(index):
                if not 1 <= index <= len(self.params):
                    raise SyntaxProblem(f"no value for ${index}")
                return self.bound.add(self.params[index - 1])
            case n.Col():
                alias, name, _ = self.scope.find(e)
                return f"{quoted(alias)}.{quoted(name)}"
            case n.Op("/", left, right):
                if self.kind(e) == "whole":
                    return f"({self(left)} div nullif({self(right)}, 0))"
                return f"({self(left)} / nullif({self(right)}, 0))"
            case n.Op(op, left, right):
                return f"({self(left)} {op} {self(right)})"
            case n.Negative(arg):
                return f"(- {self(arg)})"
            case n.Not(arg):
                return f"(NOT {self(arg)})"
            case n.IsNull(arg, negated):
                return f"({self(arg)} IS {'NOT ' * negated}NULL)"
            case n.InList(arg, (), negated):
                # no item equals anything, not even NULL
                return f"({self(arg)} IS NULL AND false)" if not negated else f"({self(arg)} IS NULL OR true)"
            case n.InList(arg, items, negated):
                return f"({self(arg)} {'NOT ' * negated}IN ({', '.join(map(self, items))}))"
            case n.InQuery(arg, query, True) if plain(arg):
                # Spark pairs all rows for a NOT IN inside an expression; a positive IN becomes a join on equality
                x, rows = self(arg), self.query(query, True)
                return f"(CASE WHEN {x} IS NOT NULL THEN NOT coalesce({x} IN ({rows}), false) WHEN NOT EXISTS ({rows}) THEN true END)"
            case n.InQuery(arg, query, negated):
                return f"({self(arg)} {'NOT ' * negated}IN ({self.query(query, negated)}))"
            case n.Like(arg, n.Lit(str() as pattern), negated):
                return f"({self(arg)} {'NOT ' * negated}LIKE {self.bound.add(pattern.replace(chr(92), chr(92) * 2))})"
            case n.Like(arg, pattern, negated):
                slash, two = self.bound.add("\\"), self.bound.add("\\\\")
                return f"({self(arg)} {'NOT ' * negated}LIKE replace({self(pattern)}, {slash}, {two}))"
            case n.Between(arg, low, high, negated):
                return f"({self(arg)} {'NOT ' * negated}BETWEEN {self(low)} AND {self(high)})"
            case n.Case(whens, default):
                body = " ".join(f"WHEN {self(c)} THEN {self(v)}" for c, v in whens)
                return f"(CASE {body} ELSE {self(default)} END)"
            case n.Scalar(query):
                return f"({self.query(query, False)})"
            case n.Agg("COUNT", n.Star(), _):
                return "count(1)"
            case n.Agg(name, n.Star(), _):
                raise SyntaxProblem(f"{name}(*) has no meaning")
            case n.Agg("SUM" | "AVG" as name, arg, _) if self.compat:
                return f"round({name.lower()}(CAST({self(arg)} AS DOUBLE)), 4)"
            case n.Agg(name, arg, distinct):
                return f"{name.lower()}({'DISTINCT ' * distinct}{self(arg)})"
            case n.Call(name, args):
                return self.call(name, args)
        raise SyntaxProblem(f"can't render {e!r}")

    def call(self, name: str, args: tuple) -> str:
        if name not in FUNCTIONS:
            raise NotFound(f"no function {name}")
        if not args or FUNCTIONS[name] not in (None, len(args)):
            raise SyntaxProblem(f"{name} takes {FUNCTIONS[name] or 'some'} arguments")
        got = [self(a) for a in args]
        if name in ("LENGTH", "CHAR_LENGTH"):
            return f"CAST(octet_length({got[0]}) AS BIGINT)"
        if name == "TRIM":
            return f"trim(BOTH {self.bound.add(' ' + chr(9) + chr(13) + chr(10))} FROM {got[0]})"
        return f"{name.lower()}({', '.join(got)})"
