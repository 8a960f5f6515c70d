"""Shared helpers: table access, shared scratch space, Arrow map stages, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one is made only in local mode where none is configured (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-ckpt-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessella-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch() named, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


#: Bytes of an Arrow batch, whatever the number of its rows: a longer text comes alone. One value for all stages, as it is read when a plan runs.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Edges (16 bytes each) that one task contracts.
TASK_EDGES = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex but the smallest of a component, with that smallest one."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while (w := up.setdefault(v, v)) != v:
            up[v] = v = up[w]
        return v

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    rows = [(v, top(v)) for v in up if top(v) != v]
    yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def connected_components(vertices: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): component is the smallest id reachable over edges (a, b).

    In each round, edges are dealt out to tasks of TASK_EDGES by a hash, and each task contracts its own to stars by union-find. While there is
    more than one task, a large-star and a small-star step (Kiveris et al.) bring the stars together: both are a groupBy-min and a join, so a hub
    is pre-aggregated before the shuffle, and the number of rounds is logarithmic in the longest path. Rounds end when one task has
    held all edges, or at the fixed point. State is written to the shared folder after each round. Vertices without an edge are their own
    component. Null ids link with nothing.
    """
    held: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df, name)
        for path in held:  # the round before is no longer read
            drop_path(edges.sparkSession, path)
        held[:] = [out._tessella_path]
        return out

    def fold(e: DataFrame) -> DataFrame:
        # e: (a, b); every vertex v points at the smallest member m of its closed neighbourhood
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: neighbours above v go to m
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small-star: neighbours at or below v, and v, go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a")
        return small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(lowest.select("a", F.col("m").alias("b"))).distinct()

    e = keep(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        # a forest of stars is the fixed point: no vertex is both a child and a parent, and each child has one parent
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or (state["n"], state["s"]) == last:
            break
        last = (state["n"], state["s"])
        tasks = -(-state["n"] // TASK_EDGES)
        stars = map_arrow(e.repartition(tasks, F.xxhash64("a", "b")) if tasks > 1 else e.repartition(1), _stars, "a long, b long")
        e = keep(fold(stars) if tasks > 1 else stars)
        if tasks == 1:
            break
    labels = e.groupBy("a").agg(F.min("b").alias("component"))
    return vertices.join(labels, vertices["id"] == labels["a"], "left").select(vertices["id"], F.coalesce("component", "id").alias("component"))
