"""Named queries that run several statements on a scratch database, or in the older dialect, each with the same question in DuckDB's SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Session
from .errors import EngineError
from .sources.store import Log
from .streaming.feed import changes, follow

Query = Callable[[SparkSession, str], DataFrame]

#: The table that most scripts work on.
CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
_COLUMNS = "(c_custkey INT PRIMARY KEY, c_name TEXT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment TEXT)"

#: Statements under the older dialect's rules, and DuckDB's text.
COMPAT: dict[str, tuple[str, str]] = {
    "compat_star_join": (
        "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
        """SELECT '{"nation.n_nationkey":' || n_nationkey || ',"nation.n_name":"' || n_name || '","nation.n_regionkey":' || n_regionkey || ',"region.r_regionkey":' || r_regionkey || ',"region.r_name":"' || r_name || '"}' AS "*" FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "compat_sum_format": (
        "SELECT SUM(l_quantity) AS s, AVG(l_linenumber) AS a FROM lineitem",
        "SELECT round(CAST(SUM(l_quantity) AS DOUBLE), 4) AS s, round(AVG(l_linenumber), 4) AS a FROM lineitem",
    ),
    "compat_bare_column": (
        "SELECT n_regionkey, r_name, COUNT(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
        "SELECT n_regionkey, any_value(r_name) AS r_name, COUNT(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
    ),
    "compat_union_chain": (
        "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region",
        "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION SELECT r_regionkey FROM region",
    ),
}


def scratch_path(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share; a private one only in local mode without such a folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise EngineError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tessella-')).rstrip('/')}/tessella-db-{uuid.uuid4().hex}"


def with_customers(spark: SparkSession, sf_dir: str) -> Session:
    """A session on a fresh database that holds all customers."""
    session = Engine(spark, scratch_path(spark)).session()
    session.execute(f"CREATE TABLE customer {_COLUMNS}")
    session.insert_frame("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return session


def _with_orders(spark: SparkSession, sf_dir: str) -> Session:
    s = with_customers(spark, sf_dir)
    s.execute("CREATE TABLE orders (o_orderkey INT PRIMARY KEY, o_custkey INT REFERENCES customer(c_custkey), o_totalprice DOUBLE)")
    s.insert_frame("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return s


def _outcome(s: Session, text: str) -> str:
    try:
        s.execute(text)
    except EngineError as e:
        return type(e).__name__
    return "done"


def _outcomes(s: Session, texts: list[str]) -> DataFrame:
    return s.spark.createDataFrame([(k, _outcome(s, t)) for k, t in enumerate(texts)], "step int, outcome string")


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(v) if isinstance(v, str) else 'true' if v is True else 'false' if v is False else 'NULL' if v is None else str(v) for v in r) + ')' for r in rows)}) AS t({names})"


def _steps(*outcomes: str) -> str:
    return _values(list(enumerate(outcomes)), "step, outcome")


def _new(key: int) -> str:
    return f"INSERT INTO customer (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES ({key}, 'new', 3, 1.5, 'NONE')"


def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("CREATE UNIQUE INDEX names ON customer (c_name)")
    return _outcomes(s, [_new(1), _new(-1), _new(-2), "UPDATE customer SET c_custkey = 2 WHERE c_custkey = 1", "UPDATE customer SET c_custkey = 0 - 5 WHERE c_custkey = 1"])


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    return _outcomes(
        s,
        [
            "INSERT INTO orders (o_orderkey, o_custkey, o_totalprice) VALUES (-1, -1, 1.0)", "INSERT INTO orders (o_orderkey, o_custkey, o_totalprice) VALUES (-1, 1, 1.0)",
            "INSERT INTO orders (o_orderkey, o_custkey, o_totalprice) VALUES (-2, NULL, 1.0)", "DELETE FROM customer WHERE c_custkey = 1", "UPDATE orders SET o_custkey = 0 - 9 WHERE o_orderkey = 0 - 1",
            "DROP TABLE customer", "DROP TABLE orders", "DROP TABLE customer",
        ],
    )


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("CREATE INDEX i ON customer (c_nationkey)")
    return _outcomes(s, ["DROP TABLE customer", "SELECT c_custkey FROM customer", "DROP INDEX i", f"CREATE TABLE customer {_COLUMNS}", f"CREATE TABLE customer {_COLUMNS}", f"CREATE TABLE IF NOT EXISTS customer {_COLUMNS}"])


def create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    s.execute("CREATE INDEX by_nation ON customer (c_nationkey)")
    s.optimize("customer", ["c_nationkey"])
    return s.execute("SELECT c_custkey FROM customer WHERE c_nationkey = 7").frame


def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    for text in ("CREATE INDEX a ON customer (c_nationkey)", "CREATE INDEX b ON customer (c_name)", "BEGIN", "DROP INDEX a", "COMMIT"):
        s.execute(text)
    return s.execute("SELECT name FROM sys.indexes").frame


def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, copy = with_customers(spark, sf_dir), scratch_path(spark)
    s.execute(f"BACKUP TO '{copy}'")
    s.execute("DELETE FROM customer WHERE c_nationkey < 20")
    s.restore(copy)
    s.execute(_new(-1))
    return s.execute("SELECT * FROM customer").frame


def backup_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, copy = with_customers(spark, sf_dir), scratch_path(spark)
    s.execute(f"BACKUP TO '{copy}'")
    s.execute("DELETE FROM customer")
    return Engine(spark, copy).sql("SELECT * FROM customer")


def compact_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    for k in range(3):
        s.execute(f"DELETE FROM customer WHERE c_nationkey = {k}")
        s.execute(_new(-k - 1))
    s.compact("customer")
    s.log.vacuum(grace=0)
    return s.execute("SELECT * FROM customer").frame


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    before = s.log.latest()
    s.execute("DELETE FROM customer WHERE c_nationkey > 3")
    return s.at(before, "SELECT * FROM customer")


def _two(spark: SparkSession, sf_dir: str, level: str) -> tuple[Session, Session]:
    a = with_customers(spark, sf_dir)
    a.execute(f"SET TRANSACTION ISOLATION LEVEL {level}")
    a.execute("BEGIN")
    return a, a.engine.session()


def _seen(s: Session) -> int:
    return s.execute("SELECT COUNT(*) AS c FROM customer WHERE c_custkey < 0").rows()[0][0]


def isolation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees of a row that another session commits meanwhile, and of its own."""
    out = []
    for level in ("READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"):
        a, b = _two(spark, sf_dir, level)
        before = _seen(a)
        b.execute(_new(-1))
        meanwhile = _seen(a)
        a.execute("COMMIT")
        out.append((level, before, meanwhile, _seen(a)))
    return spark.createDataFrame(out, "level string, before long, meanwhile long, after long")


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncommitted rows are seen by their own session only, and rolled-back ones by none."""
    a, b = _two(spark, sf_dir, "READ COMMITTED")
    a.execute(_new(-1))
    out = [("open", _seen(a), _seen(b))]
    a.execute("COMMIT")
    out.append(("committed", _seen(a), _seen(b)))
    for text in ("BEGIN", _new(-2), "ROLLBACK"):
        a.execute(text)
    return spark.createDataFrame([*out, ("rolled back", _seen(a), _seen(b))], "moment string, own long, other long")


def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COMMIT after another session has written the same table, by level and by whether the change came before this one's."""
    out = []
    for level in ("READ COMMITTED", "REPEATABLE READ"):
        for first in (True, False):
            a, b = _two(spark, sf_dir, level)
            texts = ["UPDATE customer SET c_nationkey = 1 WHERE c_custkey = 1"]
            if first:
                b.execute(_new(-1))
            a.execute(texts[0])
            if not first:
                b.execute(_new(-1))
            out.append((level, first, _outcome(a, "COMMIT")))
    return spark.createDataFrame(out, "level string, others_first boolean, outcome string")


def serializable_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction that read a table which another session has changed since can't commit what it wrote elsewhere, if it is serializable."""
    out = []
    for level in ("REPEATABLE READ", "SERIALIZABLE"):
        a, b = _two(spark, sf_dir, level)
        _seen(a)
        b.execute(_new(-1))
        a.execute("CREATE TABLE own (id INT)")
        out.append((level, _outcome(a, "COMMIT")))
    return spark.createDataFrame(out, "level string, outcome string")


def fence_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    return _outcomes(s, ["SET FENCE EPOCH 3", "SET FENCE EPOCH 2", "SET FENCE EPOCH 3", _new(-1)])


def catalog_in_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, roles, grants, indexes and statistics that a transaction makes survive commits of others."""
    a, b = _two(spark, sf_dir, "REPEATABLE READ")
    for text in ("CREATE USER ann IDENTIFIED BY 'pw' ROLE 'none'", "CREATE ROLE readers", "GRANT SELECT ON customer TO readers", "CREATE INDEX i ON customer (c_name)", "ANALYZE TABLE customer"):
        a.execute(text)
    for text in ("CREATE TABLE other (id INT)", "CREATE USER bob IDENTIFIED BY 'pw' ROLE 'none'"):
        b.execute(text)
    a.execute("COMMIT")
    views = {"user": "sys.users", "role": "sys.roles", "grant": "sys.privileges", "index": "sys.indexes", "table": "sys.tables", "stats": "sys.table_stats"}
    return spark.createDataFrame([(k, b.execute(f"SELECT COUNT(*) AS c FROM {v}").rows()[0][0]) for k, v in views.items()], "kind string, n long")


def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query within its limits, one that takes too long, and one with too large a result."""
    s = with_customers(spark, sf_dir)
    slow = "SELECT COUNT(*) AS c FROM customer a JOIN customer b ON a.c_custkey + b.c_custkey > 0 JOIN customer c ON b.c_custkey + c.c_custkey > 0 JOIN customer d ON c.c_custkey + d.c_custkey > 0"

    def tried(text: str, **limits) -> str:
        try:
            return "done" if s.execute(text).rows(**limits) else "nothing"
        except EngineError:
            return "too large"
        except Exception:
            return "cancelled"

    out = [("fast", tried("SELECT COUNT(*) AS c FROM customer", timeout=600.0)), ("slow", tried(slow, timeout=1.0)), ("large", tried("SELECT * FROM customer", most_bytes=1000))]
    return spark.createDataFrame(out, "query string, outcome string")


def statement_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text, parsed once, over data that changes."""
    s = with_customers(spark, sf_dir)
    text, out = "SELECT COUNT(*) AS c FROM customer WHERE c_nationkey = 3", []
    for k in range(2):
        out.append((k, s.execute(text).rows()[0][0]))
        s.execute("DELETE FROM customer WHERE c_nationkey = 3")
    return spark.createDataFrame(out, "run int, c long")


def prepared_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared statement run with other values, and its rows fetched in portions."""
    ready, out = with_customers(spark, sf_dir).prepare("SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_acctbal > ? ORDER BY c_custkey"), []
    for nation in (3, 4):
        ready.execute([nation, 0])
        while got := ready.fetch(7):
            out += [(nation, r[0]) for r in got]
    return spark.createDataFrame(out, "nation long, c_custkey long")


def result_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    return spark.createDataFrame([tuple(r) for r in s.execute("SELECT c_custkey, c_name FROM customer").stream()], "c_custkey long, c_name string")


def users_and_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user may do: before and after grants to a role and to the user, and after the grants are taken back."""
    s, out = with_customers(spark, sf_dir), []
    for text in ("CREATE USER ann IDENTIFIED BY 'pw' ROLE 'none'", "CREATE USER bob IDENTIFIED BY 'pw' ROLE 'read_only'", "CREATE ROLE writers"):
        s.execute(text)
    ann, bob = s.engine.session(), s.engine.session()
    ann.execute("LOGIN ann 'pw'")
    bob.execute("LOGIN bob 'pw'")

    def tried(moment: str) -> None:
        reads, writes = "SELECT c_custkey FROM customer", "UPDATE customer SET c_nationkey = 1 WHERE c_custkey < 0"
        out.extend((moment, who, _outcome(x, reads), _outcome(x, writes)) for who, x in (("ann", ann), ("bob", bob)))

    tried("at first")
    for text in ("GRANT SELECT ON customer TO ann", "GRANT UPDATE ON customer TO writers", "GRANT writers TO bob"):
        s.execute(text)
    tried("granted")
    for text in ("REVOKE SELECT ON customer FROM ann", "REVOKE UPDATE ON customer FROM writers"):
        s.execute(text)
    tried("revoked")
    return spark.createDataFrame(out, "moment string, who string, reads string, writes string")


def lock_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_customers(spark, sf_dir)
    for text in ("CREATE USER ann IDENTIFIED BY 'old' ROLE 'none'", "ALTER USER ann IDENTIFIED BY 'pw'"):
        s.execute(text)
    return _outcomes(s.engine.session(), ["LOGIN ann 'old'", "LOGIN ann 'pw'", *["LOGIN ann 'no'"] * 5, "LOGIN ann 'pw'"])


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follower after the leader's changes have been streamed to it, in two runs of the stream."""
    s, there, checkpoint = with_customers(spark, sf_dir), scratch_path(spark), scratch_path(spark)
    follow(spark, s.log.root, there, checkpoint).awaitTermination()
    s.execute("UPDATE customer SET c_mktsegment = 'X' WHERE c_acctbal < 0")
    s.execute("DELETE FROM customer WHERE c_nationkey = 5")
    follow(spark, s.log.root, there, checkpoint).awaitTermination()
    return Engine(spark, there).sql("SELECT * FROM customer")


def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came and went between two versions."""
    s = with_customers(spark, sf_dir)
    before = s.log.latest()
    s.execute("UPDATE customer SET c_nationkey = 99 WHERE c_nationkey = 5")
    s.execute("DELETE FROM customer WHERE c_nationkey = 6")
    return changes(Log(spark, s.log.root), "customer", before).select("c_custkey", "c_nationkey", "_change")


def update_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_orders(spark, sf_dir)
    s.execute("UPDATE customer SET c_mktsegment = 'RICH' WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
    s.execute("DELETE FROM orders WHERE o_totalprice < (SELECT AVG(o_totalprice) FROM orders)")
    s.execute("DELETE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
    return s.execute("SELECT c_custkey, c_mktsegment FROM customer").frame


def concurrent_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen sessions insert into one table at once, and none fails."""
    from concurrent.futures import ThreadPoolExecutor

    s = with_customers(spark, sf_dir)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda k: s.engine.session().execute(_new(-k)), range(1, 17)))
    return s.execute("SELECT * FROM customer").frame


def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends, quotes and separators."""
    s, path = Engine(spark, scratch_path(spark)).session(), scratch_path(spark)
    s.execute("CREATE TABLE documents (doc_id INT PRIMARY KEY, text TEXT, lang TEXT)")
    s.insert_frame("documents", spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", """concat(text, ' "a"', char(92), ',', char(10), char(9), '; ') AS text""", "lang"))
    for text in (f"EXPORT TABLE documents TO CSV '{path}'", "DELETE FROM documents", f"IMPORT TABLE documents FROM CSV '{path}'"):
        s.execute(text)
    return s.execute("SELECT * FROM documents").frame


def _all_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s, path = _with_orders(spark, sf_dir), scratch_path(spark)
    for text in (f"EXPORT ALL TO {kind} '{path}'", "DELETE FROM orders", "DELETE FROM customer", f"IMPORT ALL FROM {kind} '{path}'"):
        s.execute(text)
    return s.execute("SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey").frame


def export_import_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_files(spark, sf_dir, "CSV")


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables exported by one manifest, and made and filled by another."""
    s, path = with_customers(spark, sf_dir), scratch_path(spark)
    fields = "".join(f"      - name: {c}\n        type: {t}\n" for c, t in (("c_custkey", "INT"), ("c_name", "TEXT"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE"), ("c_mktsegment", "TEXT")))
    text = f"store: x\nformat: csv\noutput_dir: {path}/out\nentities:\n  - name: customer\n    file: customer.csv\n    fields:\n{fields}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/out")
    s.execute(f"EXPORT MANIFEST '{path}/out'")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/out/m.yaml")
    fresh = Engine(spark, scratch_path(spark)).session()
    fresh.execute(f"IMPORT MANIFEST '{path}/out/m.yaml'")
    return fresh.execute("SELECT * FROM customer").frame


def _catalog(spark: SparkSession, sf_dir: str) -> Session:
    s = _with_orders(spark, sf_dir)
    for text in (
        "CREATE INDEX by_nation ON customer (c_nationkey)", "CREATE UNIQUE INDEX by_name ON customer (c_name, c_custkey)", "CREATE ROLE readers", "CREATE USER ann IDENTIFIED BY 'pw' ROLE 'read_only'",
        "GRANT SELECT ON customer TO readers", "GRANT UPDATE ON orders TO ann",
    ):
        s.execute(text)
    return s


def _view(text: str) -> Query:
    return lambda spark, sf_dir: _catalog(spark, sf_dir).execute(text).frame


#: Queries over catalog views: the statement, and its rows.
VIEWS: dict[str, tuple[str, str]] = {
    "sys_tables": ("SELECT name, schema_id, type_desc FROM sys.tables", _values([("customer", 1, "USER_TABLE"), ("orders", 1, "USER_TABLE")], "name, schema_id, type_desc")),
    "sys_objects": ("SELECT name, type FROM sys.objects", _values([("customer", "U"), ("orders", "U"), ("by_nation", "IX"), ("by_name", "IX")], "name, type")),
    "sys_indexes": (
        "SELECT table_name, name, type_desc, is_unique FROM sys.indexes",
        _values([("customer", "by_nation", "NONCLUSTERED", False), ("customer", "by_name", "COMPOSITE", True)], "table_name, name, type_desc, is_unique"),
    ),
    "sys_schemas": ("SELECT schema_id, name FROM sys.schemas", _values([(1, "dbo")], "schema_id, name")),
    "sys_types": (
        "SELECT name, max_length FROM sys.types",
        _values([("bool", 1), ("int32", 4), ("int64", 8), ("uint32", 4), ("uint64", 8), ("float32", 4), ("float64", 8), ("timestamp", 8), ("text", 0), ("blob", 0)], "name, max_length"),
    ),
    "sys_constraints": ("SELECT name, type FROM sys.constraints", _values([("fk_orders_o_custkey", "FOREIGN KEY")], "name, type")),
    "sys_users": ("SELECT username, role FROM sys.users", _values([("ann", "read_only")], "username, role")),
    "sys_roles": ("SELECT role_name FROM sys.roles", _values([("readers",)], "role_name")),
    "sys_privileges": ("SELECT grantee, object_name, privilege FROM sys.privileges", _values([("readers", "customer", "SELECT"), ("ann", "orders", "UPDATE")], "grantee, object_name, privilege")),
}
_LEVELS = ("READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE")
_DENIED = "AccessDenied"
MORE: dict[str, tuple[Query, str]] = {name: (_view(text), want) for name, (text, want) in VIEWS.items()} | {
    "unique_keys": (unique_keys, _steps("ConstraintViolation", "done", "ConstraintViolation", "ConstraintViolation", "done")),
    "foreign_keys": (foreign_keys, _steps("ConstraintViolation", "done", "done", "ConstraintViolation", "ConstraintViolation", "ConstraintViolation", "done", "done")),
    "drop_table": (drop_table, _steps("done", "NotFound", "NotFound", "done", "ConstraintViolation", "done")),
    "create_index": (create_index, "SELECT c_custkey FROM customer WHERE c_nationkey = 7"),
    "drop_index": (drop_index, "SELECT 'b' AS name"),
    "backup_restore": (backup_restore, f"{CUSTOMER} UNION ALL VALUES (-1, 'new', 3, 1.5, 'NONE')"),
    "backup_copy": (backup_copy, CUSTOMER),
    "compact_vacuum": (compact_vacuum, f"{CUSTOMER} WHERE c_nationkey > 2 UNION ALL VALUES (-1, 'new', 3, 1.5, 'NONE'), (-2, 'new', 3, 1.5, 'NONE'), (-3, 'new', 3, 1.5, 'NONE')"),
    "time_travel": (time_travel, CUSTOMER),
    "isolation_levels": (isolation_levels, _values([(level, 0, int(level == _LEVELS[0]), 1) for level in _LEVELS[:2]] + [(_LEVELS[2], 0, 0, 1)], "level, before, meanwhile, after")),
    "visibility": (visibility, _values([("open", 1, 0), ("committed", 1, 1), ("rolled back", 1, 1)], "moment, own, other")),
    "write_conflicts": (
        write_conflicts,
        _values([(_LEVELS[0], True, "done"), (_LEVELS[0], False, "TransactionConflict"), (_LEVELS[1], True, "TransactionConflict"), (_LEVELS[1], False, "TransactionConflict")], "level, others_first, outcome"),
    ),
    "serializable_reads": (serializable_reads, _values([(_LEVELS[1], "done"), (_LEVELS[2], "TransactionConflict")], "level, outcome")),
    "fence_epoch": (fence_epoch, _steps("done", "TransactionConflict", "done", "done")),
    "catalog_in_transaction": (catalog_in_transaction, _values([("user", 2), ("role", 1), ("grant", 1), ("index", 1), ("table", 2), ("stats", 1)], "kind, n")),
    "timeouts": (timeouts, _values([("fast", "done"), ("slow", "cancelled"), ("large", "too large")], "query, outcome")),
    "statement_cache": (statement_cache, "SELECT 0 AS run, COUNT(*) AS c FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 1, 0"),
    "prepared_portal": (prepared_portal, "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey FROM customer WHERE c_nationkey IN (3, 4) AND c_acctbal > 0"),
    "result_stream": (result_stream, "SELECT c_custkey, c_name FROM customer"),
    "users_and_roles": (
        users_and_roles,
        _values(
            [("at first", "ann", _DENIED, _DENIED), ("at first", "bob", "done", _DENIED), ("granted", "ann", "done", _DENIED), ("granted", "bob", "done", "done"), ("revoked", "ann", _DENIED, _DENIED), ("revoked", "bob", "done", _DENIED)],
            "moment, who, reads, writes",
        ),
    ),
    "lock_out": (lock_out, _steps(_DENIED, "done", *[_DENIED] * 6)),
    "change_feed": (
        change_feed,
        "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 5",
    ),
    "feed_changes": (
        feed_changes,
        "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, 'delete' AS _change FROM customer WHERE c_nationkey IN (5, 6) UNION ALL SELECT c_custkey, 99, 'insert' FROM customer WHERE c_nationkey = 5",
    ),
    "update_subquery": (
        update_subquery,
        "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= (SELECT AVG(o_totalprice) FROM orders))",
    ),
    "concurrent_writers": (concurrent_writers, f"{CUSTOMER} UNION ALL SELECT -k, 'new', 3, 1.5, 'NONE' FROM range(1, 17) AS r(k)"),
    "csv_text_roundtrip": (csv_text_roundtrip, """SELECT doc_id, text || ' "a"' || chr(92) || ',' || chr(10) || chr(9) || '; ' AS text, lang FROM documents"""),
    "export_import_all": (export_import_all, "SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"),
    "manifest_roundtrip": (manifest_roundtrip, CUSTOMER),
}
