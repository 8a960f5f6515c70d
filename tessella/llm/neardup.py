"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has 64 symbols of 16 bits. Sixteen chunks of four symbols: two signatures that differ in at most 31 symbols
must, by the pigeonhole principle, have a chunk with at most one wrong symbol, so indexing every chunk with each one of its
symbols left out finds them all. Sets with a similarity of 0.75 differ in 16 symbols on average, and in more than 31 with a
probability of about 1e-5. Signature-close documents form blobs, and inside a blob full sets are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, table, written
from .text import blobs, shingle_hashes, word_hashes

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
SYMBOLS, CHUNK = 64, 4
MAX_DISTANCE = 2 * (SYMBOLS // CHUNK) - 1
#: Buckets and blobs are compared in blocks of about so many members; larger ones are dealt out as pairs of blocks, so a task holds two blocks at most.
BLOCK = 512
#: An id list is broadcast up to this many rows (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
_FACTORS = np.random.Generator(np.random.PCG64(75)).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for first, last, data, offsets in blobs(texts):
        words, start, _ = word_hashes(data)
        cut = np.searchsorted(start, offsets)
        out += [np.unique(shingle_hashes(words[cut[i] : cut[i + 1]], SHINGLE)) for i in range(last - first)]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS 16-bit symbols for each set; zeros for an empty one."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))[:-1]
        for k in range(SYMBOLS):
            out[full, k] = (np.minimum.reduceat(every * _FACTORS[k], at) >> np.uint64(24)).astype(np.uint16)
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column(1).to_pylist())
        sigs = signatures(sets)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.record_batch(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary())],
            ["doc_id", "n_shingles", "digest", "sig"],
        )


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column(1).to_pylist())
        yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])


def _keys() -> list:
    """Index keys of a signature: every chunk with each one of its symbols left out."""
    out = []
    for c in range(SYMBOLS // CHUNK):
        symbols = [F.substring("sig", 1 + 2 * (c * CHUNK + j), 2) for j in range(CHUNK)]
        for j in range(CHUNK):
            out.append(F.xxhash64(F.lit(c * CHUNK + j), F.concat(*(s for k, s in enumerate(symbols) if k != j))))
    return out


class Forest:
    """Union-find over positions, remembering the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _spanned(n: int, half: int, near: Callable[[int, int, int], list[int]]) -> list[tuple[int, int]]:
    """Edges that span what near(i, first, last), the members of a range close to i, tells of n members.

    Members from half on are of a second block (half is n if there is none). Then only the edges are told that join trees of the two
    blocks: the trees inside a block are told where it meets itself. Each search ends when there is nothing left to join.
    """
    forest = Forest(n)

    def search(first: int, last: int, start: int | None, wanted: int) -> None:
        for i in range(first, last):
            if len(forest.edges) == wanted:
                return
            for j in near(i, i + 1 if start is None else start, last if start is None else n):
                forest.join(i, j)

    search(0, half, None, half - 1)
    search(half, n, None, len(forest.edges) + n - half - 1)
    if half == n:
        return forest.edges
    inside = len(forest.edges)
    search(0, half, half, n - 1)
    return forest.edges[inside:]


def close_forest(sigs: np.ndarray, sizes: np.ndarray, half: int | None = None) -> list[tuple[int, int]]:
    """Edges that span the pairs within MAX_DISTANCE whose sizes allow the similarity; see _spanned for half."""

    def near(i: int, first: int, last: int) -> list[int]:
        low, high = np.minimum(sizes[first:last], sizes[i]), np.maximum(sizes[first:last], sizes[i])
        close = (sigs[first:last] != sigs[i]).sum(1) <= MAX_DISTANCE
        return (first + np.flatnonzero(close & (100 * low >= PERCENT * high))).tolist()

    return _spanned(len(sigs), len(sigs) if half is None else half, near)


def exact_forest(sets: list[np.ndarray], half: int | None = None) -> list[tuple[int, int]]:
    """Edges that span the pairs of sets with the similarity, found by counting common members over an inverted list; see _spanned for half."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    @cache
    def like(i: int) -> np.ndarray:
        s = sets[i]
        low, high = np.searchsorted(every, s), np.searchsorted(every, s, "right")
        n = high - low
        if n.sum() == len(s):
            return np.zeros(0, int)  # nothing in common with any other
        spots = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[spots], minlength=len(sets))
        return np.flatnonzero(100 * common >= PERCENT * (sizes + len(s) - common))

    def near(i: int, first: int, last: int) -> list[int]:
        found = like(i)
        return found[(found >= first) & (found < last)].tolist()

    return _spanned(len(sets), len(sets) if half is None else half, near)


def _blocks(members: DataFrame, group: str, size: str) -> DataFrame:
    """Deal the members of a group out to pairs of blocks (i <= j), so that any two meet in one of them.

    A group of up to two blocks is not split. The block is a hash of the id, and a member goes to as many pairs as there are blocks.
    A pair's rows are to be sorted by block, so that the second one's come last.
    """
    n = F.when(F.col(size) <= 2 * BLOCK, 1).otherwise(F.ceil(F.col(size) / BLOCK)).cast("int")
    dealt = members.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


#: Groups of up to so many members are compared row against row for a whole batch at once.
SMALL = 16


def _half(block: np.ndarray) -> int:
    """Where the second block of a pair begins."""
    return int(np.searchsorted(block, block[0], "right"))


def _close_pairs(group: np.ndarray, block: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sigs: np.ndarray) -> list[np.ndarray]:
    """Edges inside each run of equal group numbers: all close pairs of small groups, a spanning forest of large ones, of which a pair of blocks has its own part."""
    edges = []
    first, last = np.flatnonzero(np.diff(group, prepend=-1)), np.flatnonzero(np.diff(group, append=-1)) + 1
    small = np.repeat(last - first <= SMALL, last - first)
    for d in range(1, SMALL):
        at = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else []
        if not len(at):
            break
        low, high = np.minimum(sizes[at], sizes[at + d]), np.maximum(sizes[at], sizes[at + d])
        at = at[(ids[at] != ids[at + d]) & (100 * low >= PERCENT * high)]
        at = at[(sigs[at] != sigs[at + d]).sum(1) <= MAX_DISTANCE]
        edges.append(np.stack([ids[at], ids[at + d]], 1))
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a > SMALL:
            found = close_forest(sigs[a:b], sizes[a:b], _half(block[a:b]))
            edges.append(ids[a:b][np.array(found, int).reshape(-1, 2)])
    return edges


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int) -> Iterator[pa.Table]:
    """Rows that arrive sorted by keys, in tables that end where a group ends, of at least so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < size:
            continue
        table_ = pa.Table.from_batches(held)
        group = _numbered(table_, keys)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table_.slice(0, cut).combine_chunks()
        held = table_.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbered(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Group number of each row, from 0, by changes of the keys."""
    change = np.zeros(rows.num_rows, bool)
    for k in keys:
        x = rows.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def _pairs(edges: list[np.ndarray]) -> pa.RecordBatch:
    """Edges that span what these edges, of one or many groups, join: fewer than there are ids."""
    every = np.concatenate([np.zeros((0, 2), np.int64), *edges])
    ids, at = np.unique(every, return_inverse=True)
    forest = Forest(len(ids))
    for a, b in np.unique(np.sort(at.reshape(-1, 2), 1), axis=0).tolist():
        forest.join(a, b)
    every = ids[np.array(forest.edges, int).reshape(-1, 2)]
    return pa.record_batch([pa.array(every[:, 0]), pa.array(every[:, 1])], ["a", "b"])


def _close_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["key", "i", "j"]
    for rows in _grouped(batches, keys, 20_000, 1 << 24):
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        block, ids, sizes = (rows.column(n).to_numpy() for n in ("block", "id", "n_shingles"))
        yield _pairs(_close_pairs(_numbered(rows, keys), block, ids, sizes, sigs))


def _exact_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["blob", "i", "j"]
    for rows in _grouped(batches, keys, 5_000, 1 << 24):
        group, block, ids = _numbered(rows, keys), rows.column("block").to_numpy(), rows.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        yield _pairs([ids[a:b][np.array(exact_forest(sets[a:b], _half(block[a:b])), int).reshape(-1, 2)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts with equal sets are one class from the start, represented by the smallest doc_id; only classes are indexed. A bucket
    that holds a third of all rows is compared in pairs of blocks that send on a spanning forest of the bucket, with an edge or more only where two
    blocks' trees meet, never all pairs. Null and empty texts link with nothing. A row with a null
    doc_id founds no class: it takes the component of an equal text, if there is one, and is then not kept. Fewer than five words
    are one shingle. A long text is one task's work, in memory of about 50 bytes a word. Repeated rows get equal results. An empty table gives none, and other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(map_arrow(texts, _described, "doc_id long, n_shingles long, digest binary, sig binary"), "near-sigs")
    classes = written(
        rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "near-classes",
    )
    # only keys and ids are shuffled for the index; signatures follow to the members of shared buckets alone
    index = classes.select("id", F.explode(F.array(*_keys())).alias("key"))
    shared = index.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = index.join(shared, "key").join(classes.select("id", "n_shingles", "sig"), "id")
    dealt = _blocks(members, "key", "size").select("key", "i", "j", "block", "id", "n_shingles", "sig")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "id")
    close = written(map_arrow(dealt, _close_edges, "a long, b long").distinct(), "near-close")
    blob = connected_components(close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), close, "near-blob")
    blob = written(blob.withColumnRenamed("component", "blob"), "near-blobs")
    sizes = blob.groupBy("blob").agg(F.count("*").alias("size"))
    inside = blob.join(sizes, "blob")
    wanted = blob.select(F.col("id").alias("doc_id"))
    if blob.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = map_arrow(texts.join(wanted, "doc_id", "left_semi"), _packed_sets, "id long, set binary")
    # rows that repeat a doc_id would meet themselves
    sets = sets.join(inside, "id").dropDuplicates(["id", "set"])
    dealt = _blocks(sets, "blob", "size").select("blob", "i", "j", "block", "id", "set").repartition("blob", "i", "j").sortWithinPartitions("blob", "i", "j", "block", "id")
    links = written(map_arrow(dealt, _exact_edges, "a long, b long").where("a != b").distinct(), "near-links")
    joined = connected_components(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links, "near-component")
    # only classes that have copies or links change anything
    told = classes.select("digest", "id", "copies").join(joined, "id", "left").where("copies > 1 or component is not null")
    told = told.select("digest", F.coalesce("component", "id").alias("component"))
    return rows.join(told, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
