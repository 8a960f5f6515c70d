"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models of the same form, one of target documents and one of all others, share one vocabulary: every word that occurs.
Their counts are distributed. Documents are put together to chunks; each chunk sends the keys and counts of its distinct words and pairs of words,
packed by ranges of their hashes, to the tasks that sum up these ranges, and gets back the totals of its own keys in the same order.
A document's score is its loss per token under the target model less that under the background model; lower is closer to the target.
A document is not counted in the model that scores it: its own counts are taken from the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .text import IS_LETTER, blobs, mix, word_hashes

#: Weight of the unigram distribution, in tokens, beside the counts of a history (a Dirichlet prior).
PRIOR = 10.0
#: Tokens of a chunk; a longer text is a chunk of its own.
CHUNK = 1_000_000
#: Tokens of the collection for each range of hashes: a task sums up one range at a time, of less than so many pairs.
RANGE = 2_000_000
#: Losses are added up as whole numbers of this fraction, so that sums don't depend on their order.
STEPS = 1_000_000_000
#: Ids of target documents (about 16 bytes each) are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: The history of a document's first word.
START = np.uint64(0)


def _pack(x: np.ndarray) -> bytes:
    """An array with its bytes ordered by place value, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of texts: index of the first, word hashes (never START), number of words of each text."""
    for first, _, data, offsets in blobs([t and t.lower() for t in texts]):
        words, start, _ = word_hashes(data, IS_LETTER)
        yield first, np.maximum(words, np.uint64(1)), np.diff(np.searchsorted(start, offsets))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as chunks: ids, flags, lengths, the sorted vocabulary, and each token's place in it."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple[list, list, np.ndarray, np.ndarray]] = []

    def chunk() -> pa.RecordBatch:
        ids, flags = ([x for h in held for x in h[k]] for k in (0, 1))
        words, place = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        row = {
            "chunk": pa.array([task << 32 | made]), "tokens": pa.array([len(place)]), "ids": pa.array([ids], pa.list_(pa.int64())), "flags": pa.array([flags], pa.list_(pa.bool_())),
            "lengths": pa.array([_pack(np.concatenate([h[3] for h in held]))]), "words": pa.array([_pack_sorted(words)]), "places": pa.array([_pack(place.astype(np.uint32))]),
        }
        return pa.record_batch(list(row.values()), list(row))

    for b in batches:
        ids, flags = b.column(0).to_pylist(), b.column(1).to_pylist()
        for first, words, lengths in _words(b.column(2).to_pylist()):
            held.append((ids[first : first + len(lengths)], flags[first : first + len(lengths)], words, lengths))
            if sum(len(h[2]) + len(h[3]) for h in held) >= CHUNK:
                yield chunk()
                held, made = [], made + 1
    if held:
        yield chunk()


class Chunk:
    """A chunk read back: its documents, and its distinct words (with START first) and pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.ids, self.flags = row["ids"], np.array(row["flags"], bool)
        self.lengths = _unpack(row["lengths"], np.int64)
        self.words = np.concatenate(([START], _unpack_sorted(row["words"])))
        self.word = _unpack(row["places"], np.uint32).astype(np.int64) + 1
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.before = np.concatenate(([0], self.word[:-1]))[: len(self.word)]
        self.before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = 0
        size = len(self.words)
        codes, self.pair = np.unique(self.before * size + self.word, return_inverse=True)
        keys = mix(self.words[codes // size] * np.uint64(0x9E3779B97F4A7C15) + self.words[codes % size])
        order = np.argsort(keys, kind="stable")
        self.pairs, self.codes = keys[order], codes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[self.pair]

    def counts(self, of: np.ndarray, size: int) -> np.ndarray:
        """How often each number below size occurs in background and in target documents."""
        own = self.flags[self.doc]
        return np.stack([np.bincount(of[~own], minlength=size), np.bincount(of[own], minlength=size)]).astype(np.uint32)


#: Kinds of keys: words, with the counts of words and of histories, and pairs.
WORD, PAIR = 0, 1


def _sent(chunk: Chunk) -> list[tuple[int, np.ndarray, np.ndarray]]:
    n = len(chunk.words)
    return [(WORD, chunk.words, np.concatenate([chunk.counts(chunk.word, n), chunk.counts(chunk.before, n)])), (PAIR, chunk.pairs, chunk.counts(chunk.pair, len(chunk.pairs)))]


def _cuts(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall into, and where each begins among them."""
    of = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    first = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
    return of[first], np.append(first, len(keys))


def _entries(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(part, kind, chunk, keys, counts): what a chunk sends to each range of hashes."""
    for b in batches:
        for row in b.to_pylist():
            for kind, keys, counts in _sent(Chunk(row)):
                of, at = _cuts(keys, ranges)
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                columns = [pa.array(of.astype(np.int64)), pa.array([kind] * len(of), pa.int32()), pa.array([row["chunk"]] * len(of), pa.int64())]
                yield pa.record_batch([*columns, pa.array([_pack_sorted(keys[i:j]) for i, j in spans], pa.binary()), pa.array([_pack(counts[:, i:j].ravel()) for i, j in spans], pa.binary())], ["part", "kind", "chunk", "keys", "counts"])


_TOTALS = "chunk long, part long, kind int, counts binary, size long, background long, target long"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a range, for each chunk in the order of its keys; and as a row without a chunk the sums over the range's words."""

    def summed(part: int, kind: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = [_unpack_sorted(k) for _, k, _ in held]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack(c, np.uint32).reshape(-1, len(k)) for (_, _, c), k in zip(held, keys, strict=True)], 1)
        totals = np.stack([np.bincount(at, row, len(every)) for row in counts]).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        sent = [_pack(totals[:, at[e - len(k) : e]].ravel()) for k, e in zip(keys, ends.tolist(), strict=True)]
        n = len(held)
        rows = [[chunk for chunk, _, _ in held], [part] * n, [kind] * n, sent, [0] * n, [0] * n, [0] * n]
        if kind == WORD:
            for column, x in zip(rows, (None, part, kind, None, int((totals[0] + totals[1] > 0).sum()), int(totals[0].sum()), int(totals[1].sum())), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["chunk", "part", "kind", "counts", "size", "background", "target"])

    now, held = None, []
    for b in batches:
        for part, kind, chunk, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (part, kind) != now:
                if now:
                    yield summed(*now, held)
                now, held = (part, kind), []
            held.append((chunk, keys, counts))
    if now:
        yield summed(*now, held)


def losses(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, tokens: tuple[int, int], size: int) -> np.ndarray:
    """Summed losses of each document under the background and the target model, in STEPS.

    words: totals of words and of histories, by model; pairs: totals of pairs; tokens: of each model; size: of the vocabulary.
    """
    n, many = len(chunk.words), len(chunk.pairs)
    out = np.zeros((2, len(chunk.lengths)), np.int64)
    if not many:
        return out
    entry, own_pair = np.unique(chunk.doc * many + chunk.pair, return_counts=True)
    doc, pair = entry // many, entry % many
    before, word = chunk.codes[pair] // n, chunk.codes[pair] % n

    def own(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often a document has the word or history of each entry."""
        keys, count = np.unique(chunk.doc * n + of, return_counts=True)
        return count[np.searchsorted(keys, doc * n + at)]

    own_word, own_before = own(chunk.word, word), own(chunk.before, before)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for model in (0, 1):
        mine = chunk.flags[doc] == bool(model)
        c = pairs[model, pair] - own_pair * mine
        h = words[2 + model, before] - own_before * mine
        unigram = (words[model, word] - own_word * mine + 1.0) / (tokens[model] - chunk.lengths[doc] * mine + size)
        loss = np.rint(-np.log((c + PRIOR * unigram) / (h + PRIOR)) * STEPS).astype(np.int64)
        out[model, doc[first]] = np.add.reduceat(loss * own_pair, first)
    return out


def _scored(batches: Iterator[pa.RecordBatch], tokens: tuple[int, int], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk come together: the chunk first, then the totals of its keys by kind and range."""

    def scores(row: dict, told: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        chunk = Chunk(row)
        words, pairs = (np.concatenate([x.reshape(k, -1) for x in told[kind]], 1).astype(np.int64) if told[kind] else np.zeros((k, 1), np.int64) for kind, k in ((WORD, 4), (PAIR, 2)))
        each = losses(chunk, words, pairs, tokens, size) / (np.maximum(chunk.lengths, 1) * float(STEPS))
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.flags), pa.array(chunk.lengths), pa.array(each[1]), pa.array(each[0]), pa.array(each[1] - each[0])]
        return pa.record_batch(columns, ["doc_id", "is_target", "n_tokens", "target_loss", "background_loss", "score"])

    row, told = None, {WORD: [], PAIR: []}
    for b in batches:
        for r in b.to_pylist():
            if r["ids"] is not None:
                if row:
                    yield scores(row, told)
                row, told = r, {WORD: [], PAIR: []}
            else:
                told[r["kind"]].append(_unpack(r["counts"], np.uint64))
    if row:
        yield scores(row, told)


def score_cross_entropy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, is_target, n_tokens, target_loss, background_loss, score of every row.

    Target documents are those with a label of quality 1. All tokens of all documents are counted, and every word and every pair is modelled;
    a chunk's counts are summed before the shuffle, so a pair that makes up a third of all tokens is one entry of each chunk. Words and pairs are
    compared by 64-bit hashes. A document's own counts are left out where it is scored. Null and empty texts, and texts without letters, have no
    tokens, zero losses and score 0. With no target documents at all, the target model is uniform. Repeated rows count each time and get equal results.
    A null doc_id is never a target. An empty table gives no rows. Other columns are ignored. A long text is one task's work, in memory of about
    100 bytes a word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = written(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("is_target")).distinct(), "lm-target")
    target = F.broadcast(target) if target.count() <= BROADCAST_ROWS else target
    marked = docs.join(target, "doc_id", "left").select("doc_id", F.coalesce("is_target", F.lit(False)).alias("is_target"), "text")
    chunks = written(map_arrow(marked, _chunked, "chunk long, tokens long, ids array<long>, flags array<boolean>, lengths binary, words binary, places binary"), "lm-chunks")
    total = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    entries = map_arrow(chunks, lambda batches: _entries(batches, ranges), "part long, kind int, chunk long, keys binary, counts binary")
    counts = written(map_arrow(entries.repartition("part").sortWithinPartitions("part", "kind"), _totals, _TOTALS), "lm-counts")
    sums = counts.where("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "background", "target"))).first()
    both = chunks.drop("tokens").withColumn("part", F.lit(-1).cast("long")).unionByName(counts.where("chunk is not null").select("chunk", "part", "kind", "counts"), allowMissingColumns=True)
    both = both.repartition("chunk").sortWithinPartitions("chunk", "part")
    return map_arrow(
        both, lambda batches: _scored(batches, (sums["background"], sums["target"]), sums["size"]), "doc_id long, is_target boolean, n_tokens long, target_loss double, background_loss double, score double"
    )


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_cross_entropy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
