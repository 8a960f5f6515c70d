"""Exact embedding near-duplicates by dual traversal of cover trees.

Vectors are normalised, so a cosine threshold is a distance threshold. The upper levels of the tree are cells around pivots, packed into
blocks and, where there are many, these into groups; a vector goes to the pairs of its own group and of each group with a cell whose covering radius cannot
rule it out. The task of a pair builds a cover tree for each block (nested levels, radii halving) and walks two at once: node pairs too far apart are pruned,
pairs wholly within the threshold are linked at once, and the rest is split down to leaves, where cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, table, written
from .neardup import Forest

MIN_COSINE = 0.9
#: Pivots are the distinct vectors with the smallest hashes: PIVOTS times the root of their number, as far as MOST_PIVOTS, so that they grow with the data.
PIVOTS, MOST_PIVOTS = 3, 4096
#: Members of a block; a cell that holds more is split by a hash of the id.
BLOCK = 4096
LEAF = 256
#: More blocks than this are dealt out in groups of several, so that a vector is sent less often; the vectors of a group have so many bytes at most, or are one block.
GROUPS, GROUP_BYTES = 16, 16 << 20
#: Bytes that a worker holds at once of distances from the pivots, and of vectors that it sends on.
PART_BYTES = 8 << 20
#: Room for rounding in bounds; never used to decide a link.
_SLACK = 1e-7


class Tree:
    """Cover tree of unit vectors in arrays: node k covers order[first[k]:last[k]] within radius[k] of centre[k]."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.first, self.last, self.centre, self.radius, self.children = [], [], [], [], []
        self._grow(np.arange(len(x)), 0, 0, 1.0)

    def _grow(self, members: np.ndarray, centre: int, at: int, cover: float) -> int:
        """members[0] is the centre; children cover the members within half the radius and stand further apart than that."""
        k = len(self.first)
        away = self._distances(members, centre)
        self.first.append(at)
        self.last.append(at + len(members))
        self.centre.append(centre)
        self.radius.append(float(away.max()) if len(away) else 0.0)
        self.children.append([])
        self.order[at : at + len(members)] = members
        if len(members) <= LEAF or self.radius[k] <= _SLACK:
            return k
        while cover / 2 >= self.radius[k]:
            cover /= 2
        half = cover / 2
        nearest, owner, best = [centre], np.zeros(len(members), int), away
        while best.max() > half and len(nearest) < 64:
            far = int(best.argmax())
            nearest.append(int(members[far]))
            away = self._distances(members, members[far])
            closer = away < best
            owner[closer] = len(nearest) - 1
            best = np.where(closer, away, best)
        if len(nearest) == 1:
            return k
        for c, point in enumerate(nearest):
            own = members[owner == c]
            child = self._grow(own, point, at, max(half, _SLACK))
            self.children[k].append(child)
            at += len(own)
        return k

    def _distances(self, members: np.ndarray, point: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[point])))


def dual_links(a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, threshold: float = MIN_COSINE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between two trees (or inside one): summed weights of each member's partners, and edges that span the links.

    Positions of b count from len(a.x) in the edges, unless both are the same tree.
    """
    limit = float(np.sqrt(2 - 2 * threshold))
    shift = 0 if same else len(a.x)
    forest = Forest(len(a.x) + (0 if same else len(b.x)))
    got_a, got_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    walk = [(0, 0)] if len(a.x) and len(b.x) else []
    while walk:
        p, q = walk.pop()
        apart = float(np.linalg.norm(a.x[a.centre[p]] - b.x[b.centre[q]]))
        if apart > a.radius[p] + b.radius[q] + limit + _SLACK:
            continue
        if (same and p == q) or not (a.children[p] or b.children[q]):
            inner = same and p == q and a.children[p]
            if inner:
                kids = a.children[p]
                walk += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
                continue
            i, j = a.order[a.first[p] : a.last[p]], b.order[b.first[q] : b.last[q]]
            for i in np.split(i, range(LEAF, len(i), LEAF)):  # a leaf of one point's close copies can be a whole block
                hit = a.x[i] @ b.x[j].T >= threshold
                if same and p == q:
                    hit &= i[:, None] != j
                if not hit.any():
                    continue
                _count(i, j, hit, got_a, got_b, weight_a, weight_b, same and p == q)
                for r, c in zip(*np.nonzero(hit), strict=True):
                    forest.join(int(i[r]), int(j[c]) + shift)
        elif apart + a.radius[p] + b.radius[q] < limit - _SLACK:
            i, j = a.order[a.first[p] : a.last[p]], b.order[b.first[q] : b.last[q]]
            got_a[i] += weight_b[j].sum()
            got_b[j] += weight_a[i].sum()
            for r in i.tolist():
                forest.join(r, int(j[0]) + shift)
            for c in j.tolist():
                forest.join(int(i[0]), c + shift)
        elif a.children[p] and (a.radius[p] >= b.radius[q] or not b.children[q]):
            walk += [(c, q) for c in a.children[p]]
        else:
            walk += [(p, c) for c in b.children[q]]
    if same:
        got_a += got_b
    return got_a, got_b, forest.edges


def _count(i, j, hit, got_a, got_b, weight_a, weight_b, inside) -> None:
    got_a[i] += hit @ weight_b[j]
    if not inside:
        got_b[j] += weight_a[i] @ hit


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector) -> bool:
    """Neither null, empty or zero, nor with null or non-finite components."""
    if vector is None or any(c is None for c in vector):
        return False
    x = np.asarray(vector, np.float64)
    with np.errstate(over="ignore"):
        return bool(len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = b.column(1).to_pylist()
        data = [np.asarray(v, np.float64).tobytes() if usable(v) else None for v in vectors]
        yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], ["vec_id", "data"])


def _matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """All links of one pair of groups of blocks: a count for each member (b null) and the spanning edges."""
    out = []
    pair = {int(rows["i"].iloc[0]), int(rows["j"].iloc[0])}
    for _, part in rows.groupby(rows["data"].str.len()):
        own = {k: (int(s["own"].iloc[0]), s["id"].to_numpy(), s["copies"].to_numpy(), Tree(_unit(list(_matrix(list(s["data"])))))) for k, s in part.groupby("block")}
        for p, q in combinations_with_replacement(own, 2):
            sides = [own[k] for k in ((p,) if p == q else (p, q))]
            if {own[p][0], own[q][0]} != pair:
                continue
            ids, weights, trees = zip(*(s[1:] for s in sides), strict=True)
            got_a, got_b, edges = dual_links(trees[0], trees[-1], weights[0], weights[-1], p == q)
            for members, got in ((ids[0], got_a), (ids[-1], got_b))[: len(sides)]:
                some = got > 0
                out.append(pd.DataFrame({"a": members[some], "b": pd.array([None] * int(some.sum()), "Int64"), "n": got[some]}))
            every = np.concatenate(ids)
            out.append(pd.DataFrame({"a": [every[x] for x, _ in edges], "b": pd.array([every[y] for _, y in edges], "Int64"), "n": 0}))
    return pd.concat(out)[["a", "b", "n"]].astype({"a": "int64", "n": "int64"}) if out else pd.DataFrame({"a": pd.array([], "int64"), "b": pd.array([], "Int64"), "n": pd.array([], "int64")})


def vector_links(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Equal vectors are one class; a class links as one and its copies count. Vectors that are not usable(), and rows with a null
    vec_id, link with nothing. Vectors of different lengths never link. Repeated rows count as copies. An empty table gives none.
    Only pivots and the statistics of their cells (MOST_PIVOTS at most) reach the driver. Vectors that no radius rules out meet all others, in bounded tasks:
    a worker holds distances and vectors to send in parts of PART_BYTES, and two groups of blocks.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    checked = written(map_arrow(rows, _checked, "vec_id long, data binary"), "vec-rows")
    classes = written(checked.where("data is not null and vec_id is not null").groupBy("data").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vec-classes")
    many = min(MOST_PIVOTS, math.ceil(PIVOTS * math.sqrt(classes.count())))
    pivots = [r[0] for r in classes.select("data").orderBy(F.xxhash64("data"), "data").limit(many).collect()]
    if not pivots:
        return checked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = list(map(len, pivots))
    length = max(set(lengths), key=lambda n: (lengths.count(n), n))
    pivots = [p for p in pivots if len(p) == length]
    centres = _unit(list(_matrix(pivots)))

    def apart(data: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Which vectors have the usual length, and their distances from the pivots."""
        usual = [k for k, d in enumerate(data) if len(d) == length]
        dots = _unit(list(_matrix([data[k] for k in usual]))) @ centres.T if usual else np.zeros((0, len(centres)))
        return usual, np.sqrt(np.maximum(0.0, 2 - 2 * dots))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, PART_BYTES // (8 * len(centres)))
        for b in batches:
            yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            # vectors of another length share the last cell
            cell, away = np.full(b.num_rows, len(centres)), np.zeros(b.num_rows)
            usual, far = apart(b.column("data").to_pylist())
            if usual:
                cell[usual], away[usual] = far.argmin(1), far.min(1)
            yield pa.record_batch([b.column("id"), b.column("copies"), b.column("data"), pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "copies", "data", "cell", "away"])

    cells = written(map_arrow(classes.select("id", "copies", "data"), celled, "id long, copies long, data binary, cell int, away double"), "vec-cells")
    stats = {r["cell"]: (r["n"], r["r"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    # cells in the order of a tree over the pivots, packed into blocks; a large cell becomes several blocks of its own
    packed: list[tuple[int, int]] = []  # (cell, block), in the order of blocks
    start, parts = np.zeros(len(centres) + 1, np.int64), np.ones(len(centres) + 1, np.int64)
    blocks, filled = 0, BLOCK
    for cell in [*Tree(centres).order.tolist(), len(centres)]:
        n = stats.get(cell, (0, 0))[0]
        if not n:
            continue
        parts[cell] = -(-n // BLOCK)
        if parts[cell] > 1 or filled + n > BLOCK or cell == len(centres):
            blocks, filled = blocks + int(parts[cell]), 0
        start[cell] = blocks - parts[cell]
        packed += [(cell, k) for k in range(start[cell], blocks)]
        filled = BLOCK if parts[cell] > 1 else filled + n
    size = max(1, min(-(-blocks // GROUPS), GROUP_BYTES // (BLOCK * length)))  # blocks of a group
    groups = -(-blocks // size)
    order, first = np.array([c for c, _ in packed]), np.flatnonzero(np.diff([k // size for _, k in packed], prepend=-1))
    reach = np.array([stats.get(c, (0, 0))[1] for c in range(len(centres))]) + math.sqrt(2 - 2 * MIN_COSINE) + _SLACK

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector, for each pair of groups that it goes to."""
        for b in sliced(batches):
            cell, part = b.column("cell").to_numpy(), b.column("part").to_numpy()
            block = start[cell] + part % parts[cell]
            own = block // size
            near = np.zeros((b.num_rows, len(centres) + 1), bool)
            near[:, -1] = cell == len(centres)
            data = b.column("data").to_pylist()
            usual, far = apart(data)
            near[usual, :-1] = far <= reach
            row, other = np.nonzero(np.logical_or.reduceat(near[:, order], first, axis=1) | (np.arange(groups) == own[:, None]))
            sent = np.cumsum(np.array([len(d) for d in data])[row] + 40) // PART_BYTES
            for at in np.split(np.arange(len(row)), np.flatnonzero(np.diff(sent)) + 1):
                r, g = row[at], other[at]
                columns = [b.column(n).take(pa.array(r)) for n in ("id", "copies", "data")]
                numbers = [pa.array(x.astype(np.int32)) for x in (block[r], own[r], np.minimum(own[r], g), np.maximum(own[r], g))]
                yield pa.record_batch([*columns, *numbers], ["id", "copies", "data", "block", "own", "i", "j"])

    sent = cells.select("id", "copies", "data", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("part"))
    sent = map_arrow(sent, dealt, "id long, copies long, data binary, block int, own int, i int, j int")
    met = sent.groupBy("i", "j").applyInPandas(_compare, "a long, b long, n long")
    met = written(met, "vec-met")
    counts = met.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    edges = written(met.where("b is not null").select("a", "b").distinct(), "vec-edges")
    joined = connected_components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges, "vec-component")
    told = classes.join(counts, classes["id"] == counts["a"], "left").drop("a").join(joined, "id", "left")
    told = told.select("data", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")).where("n > 0")
    null_id = F.col("vec_id").isNull()
    return (
        checked.join(told, "data", "left")
        .select("vec_id", F.when(null_id, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(~null_id, F.coalesce("component", "vec_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
