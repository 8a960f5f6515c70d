"""Files in and out: CSV and JSON import and export, and manifests of several tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError


#: Texts may hold quotes, which are doubled, and line ends; an empty text is not NULL.
_CSV = {"multiLine": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": None, "encoding": "UTF-8"}


def read_file(spark: SparkSession, kind: str, path: str, columns: list[dict[str, Any]]) -> DataFrame:
    """A file's rows with the table's columns, matched by header name; a column that the file lacks is NULL.

    Fractional text goes into whole-number columns without its fraction; text that is no number is an error.
    """
    if kind == "csv":
        raw = spark.read.options(header=True, **_CSV).csv(path)
    elif kind == "json":
        raw = spark.read.json(path)
    elif kind in ("parquet", "orc"):
        raw = spark.read.format(kind).load(path)
    else:
        raise EngineError(f"can't import {kind}")
    held = {c.lower(): c for c in raw.columns}

    def cast(c: dict[str, Any]):
        if c["name"].lower() not in held:
            return F.lit(None).cast(c["type"]).alias(c["name"])
        got = F.col(f"`{held[c['name'].lower()]}`")
        if c["type"] == "string":
            return got.cast("string").alias(c["name"])
        value = F.trim(got.cast("string"))
        if c["type"] == "boolean":
            return F.when(got.isNotNull(), F.lower(value).isin("true", "1")).alias(c["name"])
        number = value.try_cast("decimal(38,18)").cast(c["type"]) if c["type"] == "bigint" else value.try_cast(c["type"])
        return F.when(got.isNull(), F.lit(None)).when(number.isNull(), F.raise_error(F.concat(F.lit(f"{c['name']}: not a number: "), value)).cast(c["type"])).otherwise(number).alias(c["name"])

    return raw.select(*map(cast, columns))


def write_file(df: DataFrame, kind: str, path: str) -> None:
    """Export to a folder of files; Spark writes one for each partition."""
    if kind == "csv":
        df.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **{k: v for k, v in _CSV.items() if k != "multiLine"}).csv(path)
    elif kind in ("json", "parquet", "orc"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise EngineError(f"can't export {kind}")


def parse_manifest(text: str) -> dict[str, Any]:
    """The part of YAML that manifests use: scalar keys, and entities with name, role, file and fields of name and type."""
    out: dict[str, Any] = {"entities": []}
    where = out
    in_fields = False
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if body.startswith("- "):
            body = body[2:].strip()
            if in_fields and indent > in_indent:
                target: dict[str, Any] = {}
                out["entities"][-1]["fields"].append(target)
            else:
                target = {"fields": []}
                out["entities"].append(target)
                in_fields = False
            where = target
        elif indent == 0:
            where, in_fields = out, False
        elif in_fields and indent <= in_indent:
            where, in_fields = out["entities"][-1], False
        key, _, value = (p.strip() for p in body.partition(":"))
        if key == "entities":
            continue
        if key == "fields":
            in_fields, in_indent = True, indent
            continue
        if value.startswith("{"):
            raise EngineError("manifest fields are written one to a line")
        where[key] = value.strip("'\"")
    return out
