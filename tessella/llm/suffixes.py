"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

Inserting one symbol of every document each round sorts all suffixes of a collection and keeps the common prefixes of
neighbours, but costs a pass over everything inserted so far. Here the collection is cut so that a round costs only its own symbols: every 400-byte
string belongs to the piece around its minimizer (the smallest hash of a 64-byte string inside it), equal strings sit at equal
distances from equal minimizers, and so the pieces around one minimizer are aligned. Each round takes one column of the aligned pieces
from a sequential file, inserts it, and appends the column's transform, owners and common prefixes to sequential files, all in the shared folder. A scan of
these finds the strings that repeat. Pieces whose minimizer occurs at one place only can't repeat and are not built.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, table, written
from .text import _BYTES, _power, mix

#: Bytes of a repeated string, and of the seeds that minimizers are chosen from.
LENGTH = 400
SEED = 64
#: Minimizers with more different pieces than this are cut again, by what strings of neighbouring distances share, until a group is small.
MAX_PIECES = 4096
#: Distances that share a group after the first and the second cut; strings of one distance that share all their bytes are equal.
WIDTHS = (48, 1)
#: Bytes of pieces that one collection aims at.
COLLECTION = 6_000_000
#: Longer texts are searched in overlapping segments.
SEGMENT = 1 << 18
#: Bytes of a look-up that are broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width entries, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of joined texts: key, sid (hashes of minimizer and piece), start, number of strings, distance of the minimizer from the start.

    ends: for each text its first byte and the byte after its last. No string crosses texts.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n = len(data)
    if n < LENGTH:
        return none
    raw = np.frombuffer(data, np.uint8)
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[raw] * up[:n], dtype=np.uint64, out=total[1:])
    seeds = mix((total[SEED:] - total[:-SEED]) * down[: n - SEED + 1])
    packed = seeds & ~np.uint64((1 << 24) - 1) | np.arange(len(seeds), dtype=np.uint64)
    at = (_sliding_minimum(packed, LENGTH - SEED + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    whole = np.zeros(len(at) + 1, np.int8)
    for first, last in ends:
        if last - first >= LENGTH:
            whole[first] += 1
            whole[last - LENGTH + 1] -= 1
    inside = np.cumsum(whole[:-1]) > 0
    start = np.flatnonzero(inside & (np.concatenate(([-1], at[:-1])) != at) | inside & ~np.concatenate(([False], inside[:-1])))
    if not len(start):
        return none
    stops = np.flatnonzero(~inside | (np.concatenate((at[1:], [-1])) != at) | ~np.concatenate((inside[1:], [False])))
    last = stops[np.searchsorted(stops, start)]
    sid = mix((total[last + LENGTH] - total[start]) * down[start] + (last - start).astype(np.uint64))
    return seeds[at[start]], sid, start, last - start + 1, at[start] - start


def _joined(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of texts put together: bytes, (first, last) of each, its text, and its place in that text."""
    parts, ends, owner, place, size = [], [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), SEGMENT - LENGTH + 1):
            own = t[at : at + SEGMENT]
            if parts and size + len(own) > SEGMENT:
                yield b"".join(parts), np.array(ends), np.array(owner), np.array(place)
                parts, ends, owner, place, size = [], [], [], [], 0
            parts.append(own)
            ends.append((size, size + len(own)))
            owner.append(k)
            place.append(at)
            size += len(own)
    if parts:
        yield b"".join(parts), np.array(ends), np.array(owner), np.array(place)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pieces of each text, without their bytes."""
    names = ["key", "sid", "tid", "start", "strings", "away"]
    for b in batches:
        tids = b.column(0)
        for data, ends, owner, place in _joined([(t or "").encode("utf-8") for t in b.column(1).to_pylist()]):
            key, sid, start, strings, away = pieces(data, ends)
            part = np.searchsorted(ends[:, 0], start, "right") - 1
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(sid.view(np.int64)), tids.take(pa.array(owner[part])), pa.array(start - ends[part, 0] + place[part]), pa.array(strings.astype(np.int32)), pa.array(away.astype(np.int32))],
                names,
            )


class Tape:
    """A sequential file in the shared folder: blocks of columns are appended, then read again in the same order."""

    def __init__(self, folder: str, name: str, kind: type, width: int):
        self.files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}") if "/" in folder else (fs.LocalFileSystem(), folder)
        self.path, self.kind, self.width = f"{path}/{name}", np.dtype(kind), width
        self.file = self.files.open_output_stream(self.path)

    def append(self, block: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(block, self.kind).tobytes())

    def rewind(self) -> None:
        self.file.close()
        self.file = self.files.open_input_stream(self.path)

    def read(self, columns: int) -> np.ndarray:
        return np.frombuffer(self.file.read(columns * self.width * self.kind.itemsize), self.kind).reshape(-1, self.width)

    def drop(self) -> None:
        self.file.close()
        self.files.delete_file(self.path)


#: Columns that are written to a file or read from it at once.
ROUNDS = 64


class Collection:
    """Aligned pieces of many minimizers, built column by column from the right.

    rows: (key, piece, away). Column c of a piece is its byte c - away from the minimizer's first byte. Memory is that of the pieces, and
    of ROUNDS columns of each file.
    """

    def __init__(self, rows: list[tuple[int, bytes, int]], folder: str):
        self.rows = rows
        _, self.group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        self.size = np.array([len(r[1]) for r in rows])
        self.away = np.array([r[2] for r in rows])
        self.left, self.right = -self.away, self.size - self.away
        self.low, self.high = int(self.left.min()), int(self.right.max())
        kinds = {"column": np.uint8, "transform": np.uint8, "owner": np.uint32, "common": np.uint16}
        name = f"tessella-tape-{uuid.uuid4().hex}"
        self.tapes = {k: Tape(folder, f"{name}-{k}", kind, len(rows)) for k, kind in kinds.items()}

    def _blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of columns (first, number), from the right."""
        for c in range(self.high - 1, self.low - 1, -ROUNDS):
            yield c, min(ROUNDS, c + 1 - self.low)

    def _lay_out(self) -> None:
        tape = self.tapes["column"]
        for c, n in self._blocks():
            block = np.zeros((n, len(self.rows)), np.uint8)
            for k, (_, piece, away) in enumerate(self.rows):
                own = np.frombuffer(piece, np.uint8)
                a, b = max(c + 1 - n, -away), min(c + 1, len(own) - away)
                if a < b:
                    block[c + 1 - b : c + 1 - a, k] = own[a + away : b + away][::-1]
            tape.append(block)
        tape.rewind()

    def construct(self) -> None:
        """Insert column after column; transform, owner and common hold, for each, the sorted suffixes that begin there."""
        self._lay_out()
        m = len(self.rows)
        order = np.argsort(self.group, kind="stable")
        common = np.zeros(m + 1, np.int32)  # common prefix with the suffix before, 0 at the first of a minimizer
        for c, n in self._blocks():
            columns = self.tapes["column"].read(n)
            out = {k: np.empty((n, m), self.tapes[k].kind) for k in ("transform", "owner", "common")}
            for r in range(n):
                # pieces that have not begun or are over stand apart, behind the others
                live = (self.left <= c - r) & (c - r < self.right)
                old = (self.group * 257 + np.where(live, columns[r], 256))[order]
                out["transform"][r] = columns[r][order]
                step = np.argsort(old, kind="stable")
                order, sorted_ = order[step], old[step]
                fresh = np.zeros(m + 1, np.int32)
                same = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & live[order[1:]]) + 1
                if len(same):
                    ends = np.stack([step[same - 1] + 1, step[same] + 1], 1).ravel()
                    fresh[same] = np.minimum.reduceat(common, ends)[::2] + 1
                common = fresh
                out["owner"][r], out["common"][r] = order, common[:-1]
            for k, block in out.items():
                self.tapes[k].append(block)
        for k in ("transform", "owner", "common"):
            self.tapes[k].rewind()

    def repeated(self) -> list[np.ndarray]:
        """For each piece, whether each of its strings also starts in another piece of the same minimizer."""
        try:
            self.construct()
            marks = np.zeros((len(self.rows), int((self.size - LENGTH).max()) + 1), bool)
            for c, n in self._blocks():
                common = np.pad(self.tapes["common"].read(n), ((0, 0), (0, 1)))
                r, at = np.nonzero((common[:, :-1] >= LENGTH) | (common[:, 1:] >= LENGTH))
                own = self.tapes["owner"].read(n)[r, at].astype(np.int64)
                marks[own, c - r - self.left[own]] = True
            return [marks[k, : n - LENGTH + 1] for k, n in enumerate(self.size.tolist())]
        finally:
            for tape in self.tapes.values():
                tape.drop()


def _spans(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _built(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(key, sid, first and last + 1 repeated string) of the collections that a partition holds."""

    def build(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        # a piece that occurs more than once stands there twice
        flags = Collection([(r[0], r[2], r[3]) for r in rows for _ in range(1 + r[4])], folder).repeated() if rows else []
        at = np.cumsum([0] + [1 + r[4] for r in rows]).tolist()
        for r, k in zip(rows, at, strict=False):
            out += [(r[0], r[1], a, b) for a, b in zip(*_spans(flags[k]), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["key", "sid", "first", "last"])

    # pieces arrive sorted by key, so a collection may end wherever a key does
    rows: list[tuple] = []
    held = 0
    for b in batches:
        for r in zip(*(b.column(n).to_pylist() for n in ("key", "sid", "piece", "away", "twice")), strict=True):
            if rows and held > COLLECTION and r[0] != rows[-1][0]:
                yield build(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[2]) * (1 + r[4])
    yield build(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted pieces."""
    for b in batches:
        got: dict[str, list] = {n: [] for n in ("key", "sid", "piece", "away", "twice")}
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            data = text.encode("utf-8")
            for w in wanted:
                got["piece"].append(data[w["start"] : w["start"] + w["strings"] + LENGTH - 1])
                for n in ("key", "sid", "away", "twice"):
                    got[n].append(w[n])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_())
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(got.values(), kinds, strict=True)], list(got))


_PIECE = "key long, sid long, piece binary, away int, twice boolean"


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def narrowed(piece: bytes, away: int, width: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(key, first string, piece, away) of the parts of a piece whose strings start at up to width neighbouring distances from the minimizer.

    The key stands for the bytes that all strings of such distances share, so equal strings have equal keys.
    """
    strings = len(piece) - LENGTH + 1
    for block in range((away - strings + 1) // width, away // width + 1):
        first, last = max(0, away - block * width - width + 1), min(strings - 1, away - block * width)
        core = piece[away - block * width : away - block * width - width + 1 + LENGTH]
        yield _number(block.to_bytes(4, "little"), core), first, piece[first : last + LENGTH], away - first


def _narrowed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_())
    for b in batches:
        rows = [
            (key, sid, first, part, _number(own), own, gone, twice)
            for key, sid, piece, away, twice in zip(*(b.column(n).to_pylist() for n in ("key", "sid", "piece", "away", "twice")), strict=True)
            for part, first, own, gone in narrowed(piece, away, width)
        ]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["of_key", "of_sid", "base", "key", "sid", "piece", "away", "twice"])


def _repeats(cut: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(key, sid, first, last) of the repeated strings of distinct pieces, by construction.

    Pieces of a minimizer with more than MAX_PIECES of them are cut into parts of neighbouring distances and grouped by what these share; the last
    width leaves groups of equal strings only.
    """
    folder = shared_dir(cut.sparkSession)
    many = cut.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_PIECES).select("key")
    many = written(many, "sa-many") if widths else None
    hot = many is not None and not many.isEmpty()
    few = cut.join(many, "key", "left_anti") if hot else cut
    parts = max(8, -(-(few.agg(F.sum(F.length("piece"))).first()[0] or 0) // COLLECTION))
    built = map_arrow(few.repartition(parts, "key").sortWithinPartitions("key", "sid"), lambda batches: _built(batches, folder), "key long, sid long, first int, last int")
    if not hot:
        return built
    parts_of = map_arrow(cut.join(many, "key", "left_semi"), lambda batches: _narrowed(batches, widths[0]), f"of_key long, of_sid long, base int, {_PIECE}")
    parts_of = written(parts_of, "sa-parts")
    again = parts_of.groupBy("key", "sid").agg(F.first("piece").alias("piece"), F.first("away").alias("away"), (F.max("twice") | (F.count("*") > 1)).alias("twice"))
    found = written(_repeats(written(again, "sa-again"), widths[1:]), "sa-narrow")
    back = found.join(parts_of.select("of_key", "of_sid", "base", "key", "sid"), ["key", "sid"])
    return built.unionByName(back.select(F.col("of_key").alias("key"), F.col("of_sid").alias("sid"), (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("last")).alias("last")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, runs): the maximal runs of bytes that repeated strings cover, from rows sorted by tid and first."""

    def told(rows: list[tuple[bytes, list[dict]]]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], kind)], ["tid", "runs"])

    done: list[tuple[bytes, list[dict]]] = []
    for b in batches:
        for tid, first, last in zip(*(b.column(n).to_pylist() for n in ("tid", "first", "last")), strict=True):
            if not done or done[-1][0] != tid:
                if len(done) > 10_000:
                    yield told(done)
                    done = []
                done.append((tid, []))
            runs = done[-1][1]
            if runs and first <= runs[-1]["last"]:
                runs[-1]["last"] = max(runs[-1]["last"], last)
            else:
                runs.append({"first": first, "last": last})
    yield told(done)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, text, runs in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "runs")), strict=True):
            data = (text or "").encode("utf-8")
            ends = [0] + [r[n] for r in runs or [] for n in ("first", "last")] + [len(data)]
            kept = b"".join(data[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True))
            out.append((doc_id, len(data), len(data) - len(kept), len(runs or []), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _joined_by(docs: DataFrame, rows: DataFrame, items: str, how: str) -> DataFrame:
    """Join texts with rows (tid, and a list) by tid; rows are sent everywhere if their bytes allow it, and shuffled with the texts otherwise."""
    size = rows.agg(F.coalesce(F.sum(F.lit(64) + F.size(items) * F.lit(48)), F.lit(0))).first()[0]
    return docs.join(F.broadcast(rows) if size <= BROADCAST_BYTES else rows, "tid", how)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a 400-byte string that covers it also starts anywhere else in the table, in the same text or another row, judged
    on the input. Null texts are empty; texts under 400 bytes lose nothing; rows that repeat a longer text lose all of it.
    An empty table gives none; columns beyond doc_id and text are ignored. A text is cut into segments that overlap, so a long one is searched in bounded memory.
    Places are 64-bit hashes of a minimizer and of a piece; a piece that occurs at many places is built as two.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    long = docs.where(F.octet_length("text") >= LENGTH)
    rows = written(map_arrow(long.select("tid", "text"), _anchored, "key long, sid long, tid binary, start long, strings int, away int"), "sa-pieces")
    # minimizers that occur once can't repeat; rows of equal texts count, and become one with their number
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "sa-keys")
    # read back, both sides of the join are plain shuffles, and a hot minimizer's partition can be split
    shared = rows.join(keys, "key", "left_semi").repartition("tid")
    shared = written(shared.groupBy("tid", "start", "key", "sid", "strings", "away").agg(F.count("*").alias("n")), "sa-shared")
    sids = shared.groupBy("key", "sid").agg(F.sum("n").alias("n"), F.min(F.struct("tid", "start", "strings", "away")).alias("place"))
    wanted = sids.select("place.tid", F.struct("key", "sid", "place.start", "place.strings", "place.away", (F.col("n") > 1).alias("twice")).alias("w")).groupBy("tid").agg(F.collect_list("w").alias("wanted"))
    once = _joined_by(long, written(wanted, "sa-wanted"), "wanted", "inner").select("text", "wanted")
    # a text that rows repeat is cut in each of them
    cut = written(map_arrow(once, _cut, _PIECE).dropDuplicates(["key", "sid"]), "sa-cut")
    found = written(_repeats(cut, WIDTHS), "sa-found")
    spans = shared.join(found, ["key", "sid"]).select("tid", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + LENGTH - 1).alias("last"))
    runs = map_arrow(spans.repartition("tid").sortWithinPartitions("tid", "first"), _runs, "tid binary, runs array<struct<first:bigint,last:bigint>>")
    told = _joined_by(docs, written(runs, "sa-runs"), "runs", "left").select("doc_id", "text", "runs")
    return map_arrow(told, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
