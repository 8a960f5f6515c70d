"""Catalog views, built from the state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import NotFound

_OBJECTS = "object_id long, name string, schema_id int, type string, type_desc string, is_ms_shipped boolean, root_page_id long"
#: The storage types with their ids and widths, as the catalog lists them (0: text and bytes, of any length).
STORAGE_TYPES = [("bool", 1), ("int32", 4), ("int64", 8), ("uint32", 4), ("uint64", 8), ("float32", 4), ("float64", 8), ("timestamp", 8), ("text", 0), ("blob", 0)]
_NAMES = {"boolean": ("bool", 1), "bigint": ("int64", 8), "double": ("float64", 8)}


def view(spark: SparkSession, state: dict[str, Any], name: str) -> DataFrame:
    rows, schema = _rows(state, name)
    return spark.createDataFrame(rows, schema)


def _rows(state: dict[str, Any], name: str) -> tuple[list[tuple], str]:
    tables, indexes = state["tables"], state.get("indexes", {})
    objects = [(t["id"], k, 1, "U", "USER_TABLE", False, None) for k, t in sorted(tables.items())]
    match name:
        case "sys.tables":
            return objects, _OBJECTS
        case "sys.objects":
            return objects + [(i["id"], k, 1, "IX", "INDEX", False, None) for k, i in sorted(indexes.items())], _OBJECTS
        case "sys.indexes":
            rows = [
                (tables[i["table"]]["id"], i["table"], i["id"], k, 2, "COMPOSITE" if len(i["columns"]) > 1 else "NONCLUSTERED", i["unique"], False, None)
                for k, i in sorted(indexes.items())
            ]
            return rows, "object_id long, table_name string, index_id long, name string, type int, type_desc string, is_unique boolean, is_primary_key boolean, root_page_id long"
        case "sys.columns":
            rows = [
                (t["id"], k, n, c["name"], *_NAMES.get(c["type"], ("text", 0)), n, c["nullable"], False, bool(c.get("primary")))
                for k, t in sorted(tables.items())
                for n, c in enumerate(t["columns"], 1)
            ]
            return rows, "object_id long, table_name string, column_id int, name string, data_type string, max_length int, ordinal int, is_nullable boolean, is_identity boolean, is_primary_key boolean"
        case "sys.schemas":
            return [(1, "dbo", 1)], "schema_id int, name string, principal_id int"
        case "sys.types":
            return [(n, k, w, True) for n, (k, w) in enumerate(STORAGE_TYPES, 1)], "user_type_id int, name string, max_length int, is_nullable boolean"
        case "sys.constraints":
            rows = [
                (f"fk_{k}_{c['name']}", "FOREIGN KEY", f"{k}({c['name']}) REFERENCES {c['references'][0]}({c['references'][1]})")
                for k, t in sorted(tables.items())
                for c in t["columns"]
                if c.get("references")
            ]
            return rows, "name string, type string, definition string"
        case "sys.table_stats":
            return [(k, *v) for k, v in sorted(state.get("stats", {}).items())], "table_name string, row_count long, page_count long"
        case "sys.users":
            return [(k, u["password_hash"], u["role"]) for k, u in sorted(state["users"].items())], "username string, password_hash string, role string"
        case "sys.roles":
            return [(k,) for k in sorted(state["roles"])], "role_name string"
        case "sys.privileges":
            grants = [(who, g) for who, x in sorted((state["users"] | state["roles"]).items()) for g in x.get("grants", ())]
            return [(n, who, g["on"], g["privilege"]) for n, (who, g) in enumerate(grants, 1)], "id long, grantee string, object_name string, privilege string"
    raise NotFound(f"no view {name}")
