"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching (Wise, 1993).

Documents and test items meet over shared seeds of five tokens. For each such pair, the longest matches that don't overlap are
marked again and again, so a passage counts in whatever order its parts occur. An item leaks where the tiles cover enough of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .text import IS_LETTER, blobs, shingle_hashes, word_hashes

#: Tokens of a seed, and the least length of a tile; an item of fewer tokens is one seed.
SEED = 5
#: An item leaks where tiles cover at least this share of its tokens.
COVERAGE = 0.75
#: First match length that is looked for.
START = 20
#: Test items are sent to the executors in blocks of at most so many tokens (16 bytes each); more items are more passes.
BLOCK_TOKENS = 1_000_000
_BITS = 22

IS_TOKEN = IS_LETTER.copy()
IS_TOKEN[48:58] = True


@dataclass
class Items:
    """A block of test items, and for each seed length a sorted table from seed to the items that have it."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, np.ndarray]]) -> Items:
        rows = [(i, w) for i, w in rows if len(w)]
        seeds = {}
        for size in sorted({min(SEED, len(w)) for _, w in rows}):
            own = [(k, shingle_hashes(w, size)) for k, (_, w) in enumerate(rows) if min(SEED, len(w)) == size]
            hashes, item = np.concatenate([s for _, s in own]), np.concatenate([np.full(len(s), k) for k, s in own])
            order = np.lexsort((item, hashes))
            present = np.zeros(1 << _BITS, bool)
            present[hashes >> np.uint64(64 - _BITS)] = True
            seeds[size] = hashes[order], item[order], present
        return Items([i for i, _ in rows], [w for _, w in rows], seeds)


def _matches(item: np.ndarray, text: np.ndarray, size: int, item_free: np.ndarray, text_free: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, item position, text position) of the matches of at least size unmarked tokens, extended as far as they go."""

    def open_windows(free: np.ndarray) -> np.ndarray:
        held = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(held[size:] == held[:-size])

    if len(item) < size or len(text) < size:
        return []
    at: dict[int, list[int]] = {}
    rolled = shingle_hashes(item, size)
    for p in open_windows(item_free).tolist():
        at.setdefault(int(rolled[p]), []).append(p)
    rolled = shingle_hashes(text, size)
    spots = open_windows(text_free)
    spots = spots[np.isin(rolled[spots], np.fromiter(at, np.uint64, len(at)))] if at else spots[:0]
    out = []
    for t in spots.tolist():
        for p in at[int(rolled[t])]:
            k = 0
            while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and item_free[p + k] and text_free[t + k]:
                k += 1
            if k >= size:
                out.append((k, p, t))
    return out


def _free_run(item_free: np.ndarray, text_free: np.ndarray, p: int, t: int, most: int) -> int:
    """How many of the next most tokens from p and t on are unmarked on both sides."""
    marked = ~(item_free[p : p + most] & text_free[t : t + most])
    return int(marked.argmax()) if marked.any() else most


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, item position, text position): longest first, no token of either side in two tiles.

    Of equally long matches, the first in the item and then in the text is taken. A match that a tile has cut short goes on as what is left of it.
    """
    item_free, text_free = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(START, len(item)))
    while True:
        found = [(-k, p, t) for k, p, t in _matches(item, text, size, item_free, text_free)]
        heapq.heapify(found)
        if found and -found[0][0] > 2 * size:
            size = -found[0][0]
            continue
        while found:
            k, p, t = heapq.heappop(found)
            left = _free_run(item_free, text_free, p, t, -k)
            if left == -k:
                item_free[p : p + left] = text_free[t : t + left] = False
                tiles.append((left, p, t))
            elif left >= size:
                heapq.heappush(found, (-left, p, t))
        if size == least:
            return tiles
        size = size // 2 if size > 2 * least else least


def leaks(words: np.ndarray, items: Items) -> list[tuple[int, float, int]]:
    """(item index, coverage, tiles) of the items that leak into one document, given its token hashes."""
    out = []
    for size, (hashes, owner, present) in items.seeds.items():
        if len(words) < size:
            continue
        own = shingle_hashes(words, size)
        spots = np.flatnonzero(present[own >> np.uint64(64 - _BITS)])
        low, high = np.searchsorted(hashes, own[spots]), np.searchsorted(hashes, own[spots], "right")
        spots, low, high = spots[high > low], low[high > low], high[high > low]
        if not len(spots):
            continue
        n = high - low
        item = owner[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        spot = np.repeat(spots, n)
        for k in np.unique(item).tolist():
            want = items.words[k]
            at = spot[item == k]
            # tokens that shared seeds cover bound what tiles can cover
            inside = np.zeros(len(want), bool)
            for p in np.flatnonzero(np.isin(shingle_hashes(want, size), own[at])):
                inside[p : p + size] = True
            if inside.sum() < COVERAGE * len(want):
                continue
            # the document's tokens inside seeds, with a stop where others are left out
            keep = np.zeros(len(words) + 1, bool)
            for j in range(size):
                keep[at + j] = True
            keep = keep[:-1]
            cut = np.flatnonzero(keep)
            gaps = np.flatnonzero(np.diff(cut) > 1) + 1
            text = np.insert(words[cut], gaps, np.arange(1, len(gaps) + 1, dtype=np.uint64))
            tiles = tile(want, text, size)
            covered = sum(t[0] for t in tiles) / len(want)
            if covered >= COVERAGE:
                out.append((k, covered, len(tiles)))
    return sorted(out)


def tokens(texts: list[str | None]) -> list[np.ndarray]:
    """Token hashes of each text: runs of letters and digits, lower-cased."""
    out: list[np.ndarray] = []
    for first, last, data, offsets in blobs([t and t.lower() for t in texts]):
        words, start, _ = word_hashes(data, IS_TOKEN)
        cut = np.searchsorted(start, offsets)
        out += [words[cut[i] : cut[i + 1]] for i in range(last - first)]
    return out


def _item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The test items in blocks, by item_id; they are a stated query set, read through an iterator."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        words = tokens([row["text"]])[0]
        if block and held + len(words) > BLOCK_TOKENS:
            yield Items.of(block)
            block, held = [], 0
        block.append((row["item_id"], words))
        held += len(words)
    yield Items.of(block)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles of every pair of a document and a test item that leaks into it.

    Whole documents are searched. Null and empty texts on either side leak nothing; an item of fewer than five tokens leaks where
    its whole sequence occurs. Repeated rows give repeated pairs; an empty table on either side gives none; other columns are ignored.
    A long text is one task's work, in memory of about 50 bytes a word. The documents are never shuffled, and a seed or item that a third of them share costs each of them one look-up.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [
                    (doc_id, items.ids[k], covered, n)
                    for doc_id, words in zip(b.column(0).to_pylist(), tokens(b.column(1).to_pylist()), strict=True)
                    for k, covered, n in leaks(words, items)
                ]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "item_id", "coverage", "n_tiles"])

        found = map_arrow(docs, run, "doc_id long, item_id long, coverage double, n_tiles long")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that any test item leaks into; the columns stay as they are."""
    out = docs
    for items in _item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index("text")
                yield b.filter(pa.array([not leaks(words, items) for words in tokens(b.column(at).to_pylist())], pa.bool_()))

        out = map_arrow(out, run, docs.schema)
    return out


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
