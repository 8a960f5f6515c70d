"""Random queries of the dialect, answered by the engine and by DuckDB."""

import random

import duckdb
import pytest

from tessella import queries as dialect

from .test_oracle import SF_DIR, plain

NUMBERS = ["o_orderkey", "o_custkey", "c_custkey", "c_nationkey"]
TEXTS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name"]


def scalar(rng, depth=0):
    pick = rng.randrange(8 if depth < 2 else 2)
    if pick == 0:
        return str(rng.randrange(0, 900))
    if pick == 1 or depth >= 2:
        return rng.choice(NUMBERS)
    a, b = scalar(rng, depth + 1), scalar(rng, depth + 1)
    if pick == 2:
        return f"({a} {rng.choice('+-*')} {b})"
    if pick == 3:
        return f"ABS({a} - {b})"
    if pick == 4:
        return f"COALESCE(NULLIF({a}, {b}), {rng.randrange(9)})"
    if pick == 5:
        return f"CASE WHEN {predicate(rng, depth + 1)} THEN {a} ELSE {b} END"
    if pick == 6:
        return f"({a} / {rng.choice([b, rng.randrange(4)])})"
    return f"LENGTH({rng.choice(TEXTS)})"


def predicate(rng, depth=0):
    pick = rng.randrange(9 if depth < 2 else 6)
    a = scalar(rng, 2)
    if pick == 0:
        return f"{a} {rng.choice(['=', '<>', '<', '<=', '>', '>='])} {scalar(rng, depth + 1)}"
    if pick == 1:
        return f"{a} {rng.choice(['', 'NOT '])}BETWEEN {rng.randrange(300)} AND {rng.randrange(300, 900)}"
    if pick == 2:
        return f"{a} {rng.choice(['', 'NOT '])}IN ({', '.join(str(rng.randrange(60)) for _ in range(5))})"
    if pick == 3:
        return f"{rng.choice(TEXTS)} {rng.choice(['', 'NOT '])}LIKE '{rng.choice(['%0%', 'B%', '_-%', '%G', '1-URGENT', '%_1'])}'"
    if pick == 4:
        return f"{rng.choice(NUMBERS + TEXTS)} IS {rng.choice(['', 'NOT '])}NULL"
    if pick == 5:
        return f"{rng.choice(TEXTS)} {rng.choice(['=', '<', '>='])} '{rng.choice(['F', 'BUILDING', '3-MEDIUM'])}'"
    if pick == 6:
        return f"NOT ({predicate(rng, depth + 1)})"
    return f"({predicate(rng, depth + 1)} {rng.choice(['AND', 'OR'])} {predicate(rng, depth + 1)})"


def query(rng):
    join = rng.choice(["JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL OUTER JOIN"])
    source = f"orders {join} customer ON o_custkey = c_custkey AND o_orderkey > {rng.randrange(0, 1400)}"
    where = f" WHERE {predicate(rng)}" if rng.random() < 0.8 else ""
    if rng.random() < 0.5:
        return f"SELECT {rng.choice(['', 'DISTINCT '])}o_orderkey, c_custkey, {scalar(rng)} AS v FROM {source}{where}"
    key = rng.choice(TEXTS[:3] + ["c_nationkey"])
    having = f" HAVING COUNT(*) > {rng.randrange(5)}" if rng.random() < 0.5 else ""
    return f"SELECT {key}, COUNT(*) AS c, COUNT(DISTINCT o_custkey) AS d, SUM({scalar(rng)}) AS s, MIN({scalar(rng)}) AS lo, MAX({rng.choice(TEXTS)}) AS hi FROM {source}{where} GROUP BY {key}{having}"


@pytest.mark.parametrize("seed", range(25))
def test_random_query(spark, seed):
    text = query(random.Random(seed))
    con = duckdb.connect()
    con.sql("SET error_on_division_by_zero = false")
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got = sorted(repr([plain(v) for v in r]) for r in dialect.engine(spark, SF_DIR).sql(text).collect())
    # the dialect's LENGTH counts bytes
    assert got == sorted(repr([plain(v) for v in r]) for r in con.sql(text.replace("LENGTH(", "strlen(").replace(" / ", " // ")).fetchall()), text
