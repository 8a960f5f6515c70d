"""The dialect's operators as named queries over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .script_queries import COMPAT, CUSTOMER, MORE, scratch_path, with_customers

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
Query = Callable[[SparkSession, str], DataFrame]

#: Total order of lineitem.
KEY4 = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEY_PRICE = f"SELECT {KEY4}, l_extendedprice FROM lineitem"

#: Name: statement of the dialect, and DuckDB's text where it has to be another (NULL order, integer division, byte length, names).
SQL: dict[str, str | tuple[str, str]] = {
    # scans, projection, predicates
    "scan_project": "SELECT c_custkey, c_name FROM customer",
    "scan_star": "SELECT * FROM nation",
    "pk_point": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 500",
    "pk_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 200 AND 1200",
    "eq_filter": "SELECT o_orderkey FROM orders WHERE o_custkey = 77",
    "range_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 250000",
    "range_filter_desc": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "in_list": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 14, 15, 92, 653)",
    "or_union": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 3 OR o_custkey = 14 OR o_custkey = 15",
    "not_in_list": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2)",
    "comparisons": "SELECT p_partkey FROM part WHERE p_size <> 7 AND p_size != 9 AND p_size <= 30 AND p_retailprice > 950.5",
    "and_or_not": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey = 3) AND (c_mktsegment = 'BUILDING' OR NOT c_custkey > 100)",
    "is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL",
    "is_not_null": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NOT NULL",
    "three_valued": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE NOT (o_totalprice > 350000 AND c_acctbal > 0)",
    "like_prefix": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000001%'",
    "like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_2'",
    "not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%BRASS%'",
    "between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20",
    "not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20",
    "precedence": "SELECT p_partkey FROM part WHERE p_size + 2 * 3 > 40 OR p_size - 1 = 3 AND NOT p_partkey < 100",
    # sub-queries
    "scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
    "scalar_subquery_first": "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 1)",
    "scalar_subquery_empty": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT c_acctbal FROM customer WHERE c_custkey = 0 - 1)",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "nested_subquery": "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))",
    "having_subquery": "SELECT c_nationkey, COUNT(*) AS c FROM customer GROUP BY c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) FROM nation)",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_range": "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey > r_regionkey * 4 AND n_nationkey < r_regionkey * 6",
    "join_cross": "SELECT r_name, n_name FROM region JOIN nation ON 1 = 1",
    "join_three_way": "SELECT r_name, COUNT(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_self_alias": "SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer AS x INNER JOIN customer AS y ON x.c_custkey = y.c_custkey - 1 AND x.c_nationkey = y.c_nationkey",
    "join_residual": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40",
    "join_star": (
        "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
        "SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey, r_regionkey AS region_r_regionkey, r_name AS region_r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    # aggregates
    "agg_count_star": "SELECT COUNT(*) AS c FROM lineitem",
    "agg_count_col": "SELECT COUNT(o_orderkey) AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "agg_count_distinct": "SELECT COUNT(DISTINCT l_suppkey) AS c FROM lineitem",
    "agg_sum": "SELECT SUM(l_quantity) AS s, SUM(l_orderkey) AS k FROM lineitem",
    "agg_avg": "SELECT AVG(l_quantity) AS a FROM lineitem",
    "agg_min_max": "SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem",
    "agg_min_max_text": "SELECT MIN(c_name) AS lo, MAX(c_mktsegment) AS hi FROM customer",
    "agg_empty": "SELECT COUNT(*) AS c, SUM(o_custkey) AS s, MIN(o_custkey) AS lo, AVG(o_custkey) AS a FROM orders WHERE o_orderkey < 0",
    "agg_sum_distinct": "SELECT SUM(DISTINCT l_linenumber) AS s FROM lineitem",
    "agg_expression": "SELECT SUM(l_orderkey * 2 + l_linenumber) AS s FROM lineitem",
    "group_by_one": "SELECT l_returnflag, COUNT(*) AS c, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag",
    "group_by_multi": "SELECT l_returnflag, l_linestatus, COUNT(*) AS c, MIN(l_orderkey) AS lo FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_join": "SELECT n_name, COUNT(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "group_by_null": "SELECT o_custkey, COUNT(*) AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY o_custkey",
    "having": "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "having_hidden_agg": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 400000 AND NOT COUNT(*) < 10",
    "having_arith": "SELECT l_suppkey, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_suppkey HAVING SUM(l_linenumber) * 2 > COUNT(*) * 8",
    "group_order_limit": "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey ORDER BY c DESC, o_custkey LIMIT 10 OFFSET 5",
    # order, limit, distinct
    "order_multi": "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC",
    "order_nulls": (
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey DESC, c_custkey LIMIT 40",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey DESC NULLS FIRST, c_custkey LIMIT 40",
    ),
    "order_nulls_last": (
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey, c_custkey LIMIT 40",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey ASC NULLS LAST, c_custkey LIMIT 40",
    ),
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    "distinct_one": "SELECT DISTINCT l_linenumber FROM lineitem",
    "distinct_multi": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_limit": "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 30 OFFSET 3",
    # set operations
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union_chain": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region",
    # scalar expressions
    "arith_int": "SELECT o_orderkey, o_orderkey * 3 + o_custkey - 7 AS v FROM orders",
    "arith_div_int": ("SELECT o_orderkey, (o_custkey - 500) / 7 AS v FROM orders", "SELECT o_orderkey, (o_custkey - 500) // 7 AS v FROM orders"),
    "arith_div_zero": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey / (l_linenumber - 3) AS v, l_quantity / (l_linenumber - 3) AS w FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey // NULLIF(l_linenumber - 3, 0) AS v, l_quantity / NULLIF(l_linenumber - 3, 0) AS w FROM lineitem",
    ),
    "arith_float": "SELECT p_partkey, p_retailprice * 2.0 - 1.5 AS v FROM part",
    "arith_where": "SELECT o_orderkey FROM orders WHERE o_orderkey - o_custkey * 2 > 100",
    "fn_abs": "SELECT c_custkey, ABS(c_acctbal) AS v, ABS(0 - c_custkey) AS w FROM customer",
    "fn_length": ("SELECT doc_id, LENGTH(text) AS n, CHAR_LENGTH(lang) AS m FROM documents", "SELECT doc_id, strlen(text) AS n, strlen(lang) AS m FROM documents"),
    "fn_upper_lower": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l FROM customer",
    "fn_trim": ("SELECT doc_id, LENGTH(TRIM(text)) AS n FROM documents", "SELECT doc_id, strlen(trim(text, ' ' || chr(9) || chr(13) || chr(10))) AS n FROM documents"),
    "fn_coalesce": "SELECT c_custkey, COALESCE(o_orderkey, 0 - 1) AS v FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "fn_nullif": "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS v FROM nation",
    "case_when": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS v FROM customer",
    # divisions whose kind is that of branches, arguments or sub-queries
    "arith_div_mixed": (
        "SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN o_custkey END / 7 AS a, COALESCE(NULL, o_custkey, 3) / 4 AS b, NULLIF(o_orderkey, 5) / 2 AS c, (SELECT COUNT(*) FROM nation) / 4 AS d, CASE WHEN o_custkey > 50 THEN 7 ELSE 2.5 END / 2 AS e, (SELECT MAX(o_orderkey) FROM orders) / 2.0 AS f FROM orders",
        "SELECT o_orderkey, CASE WHEN o_custkey > 50 THEN o_custkey END // 7 AS a, COALESCE(NULL, o_custkey, 3) // 4 AS b, NULLIF(o_orderkey, 5) // 2 AS c, (SELECT COUNT(*) FROM nation) // 4 AS d, CASE WHEN o_custkey > 50 THEN 7 ELSE 2.5 END / 2 AS e, (SELECT MAX(o_orderkey) FROM orders) / 2.0 AS f FROM orders",
    ),
    "case_subquery": "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT AVG(c_acctbal) FROM customer) THEN 'above' ELSE 'below' END AS v FROM customer",
    "not_in_subquery_nulls": (
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 4) FROM orders)",
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey <> 4)",
    ),
    "not_in_subquery_null_side": (
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 350000)",
        "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE NOT o_totalprice > 350000",
    ),
    "not_in_subquery_empty": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey < 0)",
    "union_branch_limit": (
        "SELECT n_regionkey AS k FROM nation ORDER BY n_regionkey LIMIT 3 UNION ALL SELECT r_regionkey FROM region ORDER BY r_regionkey DESC LIMIT 2",
        "(SELECT n_regionkey AS k FROM nation ORDER BY n_regionkey LIMIT 3) UNION ALL (SELECT r_regionkey FROM region ORDER BY r_regionkey DESC LIMIT 2)",
    ),
    "limit_without_order": ("SELECT COUNT(*) AS c FROM orders WHERE 5 > (SELECT o_orderkey - o_orderkey FROM orders LIMIT 1)", "SELECT COUNT(*) AS c FROM orders"),
    # the benchmark's eighteen queries
    "bench_q01": f"{_KEY_PRICE} WHERE l_linenumber = 3 ORDER BY {KEY4} LIMIT 1000",
    "bench_q02": f"{_KEY_PRICE} WHERE l_linenumber = 3 AND l_extendedprice > 10000 ORDER BY {KEY4} LIMIT 1000",
    "bench_q03": f"{_KEY_PRICE} WHERE l_linenumber = 3 AND l_extendedprice > 10000 ORDER BY l_extendedprice DESC, {KEY4} LIMIT 1000",
    "bench_q04": f"{_KEY_PRICE} WHERE l_extendedprice > 50000 ORDER BY {KEY4} LIMIT 500",
    "bench_q05": f"{_KEY_PRICE} WHERE l_extendedprice > 50000 ORDER BY l_extendedprice DESC, {KEY4} LIMIT 500",
    "bench_q06": f"{_KEY_PRICE} WHERE l_suppkey = 45 ORDER BY {KEY4} LIMIT 1000",
    "bench_q07": f"{_KEY_PRICE} WHERE l_linenumber IN (1, 3, 5) ORDER BY {KEY4} LIMIT 1000",
    "bench_q08": f"{_KEY_PRICE} WHERE l_extendedprice > 10000 AND l_extendedprice < 50000 ORDER BY {KEY4} LIMIT 1000",
    "bench_q09": "SELECT COUNT(*) AS c FROM lineitem WHERE l_linenumber = 3",
    "bench_q10": "SELECT l_suppkey, AVG(l_extendedprice) AS a FROM lineitem GROUP BY l_suppkey ORDER BY a DESC, l_suppkey LIMIT 5",
    "bench_q11": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 500",
    "bench_q12": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 2000 AND o_orderkey <= 3000",
    "bench_q13": "SELECT COUNT(*) AS c FROM lineitem",
    "bench_q14": "SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem",
    "bench_q15": "SELECT DISTINCT l_linenumber FROM lineitem",
    "bench_q16": "SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 ORDER BY c DESC, o_custkey LIMIT 10",
    "bench_q17": f"{_KEY_PRICE} WHERE l_linenumber = 3 AND l_extendedprice >= 20000 AND l_extendedprice <= 40000 ORDER BY {KEY4} LIMIT 1000",
    "bench_q18": f"{_KEY_PRICE} WHERE l_linenumber = 3 ORDER BY l_extendedprice, {KEY4} LIMIT 100 OFFSET 5000",
}
#: Results whose floating-point sums depend on the order of rows: rounded on both sides.
ROUNDED = {"bench_q10": ["a"]}

#: Whole-number sums, which DuckDB makes 128 bits wide.
SUMS = {"agg_sum": ["k"], "agg_empty": ["s"], "agg_sum_distinct": ["s"], "agg_expression": ["s"], "having_arith": ["s"]}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the tables' files, each opened when a query names it."""
    return Engine(spark, opener=lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in TABLES else None)


def _dialect(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = SQL[name]
        text = text if isinstance(text, str) else text[0]
        out = engine(spark, sf_dir).sql(text)
        for c in ROUNDED.get(name, ()):
            out = out.withColumn(c, F.round(c, 4))
        return out

    return run


def bind_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT c_custkey FROM customer WHERE c_mktsegment = $1 AND c_acctbal > $2", ["BUILDING", 100])


# changes, on a scratch database that holds whole tables
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("INSERT INTO customer (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES (-1, 'it''s new', 3, 1.5, 'NONE'), (-2, 'other', 4, 2.0, 'NONE')")
    return s.execute("SELECT * FROM customer").frame


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("UPDATE customer SET c_nationkey = c_nationkey + 100, c_mktsegment = 'X' WHERE c_acctbal < 0")
    return s.execute("SELECT * FROM customer").frame


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("DELETE FROM customer WHERE c_nationkey IN (1, 2, 3)")
    return s.execute("SELECT * FROM customer").frame


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    for text in ("BEGIN", "DELETE FROM customer WHERE c_custkey > 10", "ROLLBACK"):
        s.execute(text)
    return s.execute("SELECT * FROM customer").frame


def txn_savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    for text in ("BEGIN", "DELETE FROM customer WHERE c_nationkey = 1", "SAVEPOINT a", "DELETE FROM customer WHERE c_nationkey = 2", "ROLLBACK TO SAVEPOINT a", "COMMIT"):
        s.execute(text)
    return s.execute("SELECT * FROM customer").frame


def ddl_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    for text in ("ALTER TABLE customer ADD COLUMN age INT DEFAULT 25", "ALTER TABLE customer RENAME TO members"):
        s.execute(text)
    return s.execute("SELECT c_custkey, age FROM members").frame


def analyze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("ANALYZE TABLE customer")
    return s.execute("SELECT table_name, row_count FROM sys.table_stats").frame


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_customers(spark, sf_dir).execute("SELECT name, data_type, ordinal, is_primary_key FROM sys.columns").frame


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = with_customers(spark, sf_dir), scratch_path(spark)
    s.execute(f"EXPORT TABLE customer TO CSV '{path}'")
    s.execute("DELETE FROM customer")
    s.execute(f"IMPORT TABLE customer FROM CSV '{path}'")
    return s.execute("SELECT * FROM customer").frame


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = with_customers(spark, sf_dir), scratch_path(spark)
    s.execute(f"EXPORT TABLE customer TO JSON '{path}'")
    s.execute("DELETE FROM customer")
    s.execute(f"IMPORT TABLE customer FROM JSON '{path}'")
    return s.execute("SELECT * FROM customer").frame


#: Queries that run more than one statement, with their SQL for DuckDB.
SCRIPTS: dict[str, tuple[Query, str]] = {
    "bind_params": (bind_params, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100"),
    "dml_insert": (dml_insert, f"{CUSTOMER} UNION ALL VALUES (-1, 'it''s new', 3, 1.5, 'NONE'), (-2, 'other', 4, 2.0, 'NONE')"),
    "dml_update": (
        dml_update,
        "SELECT c_custkey, c_name, CAST(CASE WHEN c_acctbal < 0 THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    ),
    "dml_delete": (dml_delete, f"{CUSTOMER} WHERE c_nationkey NOT IN (1, 2, 3)"),
    "txn_rollback": (txn_rollback, CUSTOMER),
    "txn_savepoint": (txn_savepoint, f"{CUSTOMER} WHERE c_nationkey <> 1"),
    "ddl_add_column": (ddl_add_column, "SELECT c_custkey, CAST(25 AS BIGINT) AS age FROM customer"),
    "analyze_table": (analyze_table, "SELECT 'customer' AS table_name, COUNT(*) AS row_count FROM customer"),
    "catalog_columns": (
        catalog_columns,
        "SELECT * FROM (VALUES ('c_custkey', 'int64', 1, true), ('c_name', 'text', 2, false), ('c_nationkey', 'int64', 3, false), ('c_acctbal', 'float64', 4, false), ('c_mktsegment', 'text', 5, false)) AS t(name, data_type, ordinal, is_primary_key)",
    ),
    "csv_roundtrip": (csv_roundtrip, CUSTOMER),
    "json_roundtrip": (json_roundtrip, CUSTOMER),
} | MORE


def _compat(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        older = engine(spark, sf_dir)
        older.compat = True
        return older.sql(COMPAT[name][0])

    return run


def queries() -> dict[str, Query]:
    return {name: _dialect(name) for name in SQL} | {name: _compat(name) for name in COMPAT} | {name: q for name, (q, _) in SCRIPTS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: text if isinstance(text, str) else text[1] for name, text in (SQL | COMPAT).items()}
    for name, columns in ROUNDED.items():
        out[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in columns)}) FROM ({out[name]})"
    for name, columns in SUMS.items():
        out[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({out[name]})"
    return out | {name: text for name, (_, text) in SCRIPTS.items()}
