"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A numpy classifier is trained from confirmed toxic documents and unlabelled documents. The risk on negatives is
estimated as unlabelled risk minus prior times positive risk; where that falls below zero, the step turns back,
so the flexible model cannot fit the negative risk away. Features are hashed words and word beginnings, counted once a document.
All documents are the unlabelled text: each part of them trains a model beside the same positives, and the mean of the models, by documents, is the
classifier (parameter mixing).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .text import IS_LETTER, blobs, mix, word_hashes

#: Bound of the positive sample: so many confirmed toxic documents at most, those with the smallest hashes of doc_id.
MAX_POSITIVE = 3000
#: Unlabelled documents that train a model together; all of them are dealt out to such parts by a hash.
PART = 6000
#: Bound of the labelled sample that the score is calibrated on.
MAX_CALIBRATION = 6000
#: A feature counts if so many of the positive sample's documents have it, and such a share of them.
MIN_POSITIVE_DOCS = 4
MIN_POSITIVE_SHARE = 0.01
BITS = 20
#: Lengths of word beginnings, in bytes.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7


def _features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words of data, and where each word starts; one row of features for each kind."""
    words, start, end = word_hashes(data, IS_LETTER)
    out = [words >> np.uint64(64 - BITS)]
    raw = np.frombuffer(data + bytes(8), np.uint8)
    # the first eight bytes of each word, lower-cased, as one number
    head = np.zeros(len(start), np.uint64)
    for k in range(max(BEGINNINGS)):
        at = raw[start + k].astype(np.uint64)
        at += ((at >= 65) & (at <= 90)).astype(np.uint64) * np.uint64(32)
        head = head * np.uint64(256) + at
    for n in BEGINNINGS:
        cut = head >> np.uint64(8 * (max(BEGINNINGS) - n))
        bins = mix(cut + np.uint64(n << 60)) >> np.uint64(64 - BITS)
        out.append(np.where(end - start > n, bins, out[0]))
    return np.stack(out).astype(np.int64) if len(start) else np.zeros((len(out), 0), np.int64), start


def document_features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text."""
    out: list[np.ndarray] = []
    for first, last, data, offsets in blobs([t and t.lower() for t in texts]):
        found, start = _features(data)
        cut = np.searchsorted(start, offsets)
        out += [np.unique(found[:, cut[i] : cut[i + 1]]).astype(np.int32) for i in range(last - first)]
    return out


@dataclass
class Model:
    bins: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bins] = self.weights
        return out

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        weights = self.table()
        return np.array([float(weights[d].sum(dtype=np.float64)) + self.bias for d in docs])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Sums:
    """Sums of values by a number from 0 to below n that each has; the numbers are sorted once."""

    def __init__(self, of: np.ndarray, n: int):
        self.order = None if (of[1:] >= of[:-1]).all() else np.argsort(of, kind="stable").astype(np.int32)
        counts = np.bincount(of, minlength=n)
        self.some = np.flatnonzero(counts)
        self.first = (np.cumsum(counts) - counts)[self.some]
        self.n = n

    def sorted(self, x: np.ndarray) -> np.ndarray:
        return x if self.order is None else x[self.order]

    def __call__(self, sorted_: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.first):
            out[self.some] = np.add.reduceat(sorted_, self.first)
        return out


def positive_bins(positive: list[np.ndarray]) -> np.ndarray:
    """The features that enough positive documents have."""
    counts = np.bincount(np.concatenate([*positive, np.zeros(0, np.int32)]), minlength=1 << BITS)
    return np.flatnonzero(counts >= max(MIN_POSITIVE_DOCS, len(positive) * MIN_POSITIVE_SHARE))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 150, rate: float = 0.05, penalty: float = 5e-3, start: Model | None = None) -> Model:
    """Full-batch Adam on the non-negative risk with logistic loss, with steps that shrink to nothing and the mean of the second half of the rounds.

    Deterministic. Without positives every score is the prior. start is a model over the same features to go on from.
    """
    bins = positive_bins(positive)
    bias0 = float(np.log(prior / (1 - prior)))
    if not len(bins) or not unlabelled:
        return Model(bins, np.zeros(len(bins)), bias0)
    place = np.full(1 << BITS, -1, np.int32)
    place[bins] = np.arange(len(bins))

    found = [p[p >= 0] for d in (positive, unlabelled) for p in (place[x] for x in d)]
    sizes = np.array([len(f) for f in found])
    at, row = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int32), sizes)  # features of all documents, the positives' first
    by_row, by_bin = _Sums(row, len(found)), _Sums(at, len(bins))
    row = by_bin.sorted(row)
    n = len(positive)
    del found
    w, b = (start.weights, start.bias) if start else (np.zeros(len(bins)), bias0)
    m, v = np.zeros(len(bins) + 1), np.zeros(len(bins) + 1)
    sum_w, sum_b = np.zeros(len(bins)), 0.0
    for t in range(1, rounds + 1):
        f = by_row(w[at]) + b
        fp, fu = f[:n], f[n:]
        sp, su = _sigmoid(fp), _sigmoid(fu)
        # losses log(1 + exp(f)) of the negative label, and their derivatives su and sp
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gu, gp = su / len(unlabelled), -prior * sp / n
        if negative < 0:
            gu, gp = -gu, -gp  # step back until the negative risk is plausible again
        else:
            gp = gp + prior * (sp - 1) / n
        each = np.concatenate([gp, gu])
        g = np.append(by_bin(each[row]) + penalty * w, each.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        if 2 * t > rounds:
            sum_w, sum_b = sum_w + w, sum_b + b
    w, b = sum_w / (rounds - rounds // 2), sum_b / (rounds - rounds // 2)
    return Model(bins, w, float(b))


def mixed(models: list[tuple[int, np.ndarray, float]], bins: np.ndarray) -> Model:
    """The mean of models over the same features, by the documents that trained each; weights close to zero are dropped."""
    n = sum(m[0] for m in models)
    w, b = sum(m[0] * m[1] for m in models) / n, sum(m[0] * m[2] for m in models) / n
    kept = np.abs(w) > 0.005
    return Model(bins[kept], w[kept], float(b))


def calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit slope and shift of a logistic curve to labelled scores (Platt's targets), by Newton steps."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    if not n1 or not n0:
        return model
    x = np.stack([model.raw(docs), np.ones(len(docs))])
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.01])

    def loss(a: np.ndarray) -> float:
        f = a @ x
        return float((np.logaddexp(0, f) - target * f).sum() + (ridge * (a - [1, 0]) ** 2).sum() / 2)

    for _ in range(100):
        p = _sigmoid(a @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag(ridge), x @ (p - target) + ridge * (a - [1, 0]))
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if a[0] > 0:
        model.slope, model.shift = float(a[0]), float(a[1])
    return model


def is_held_out(doc_id: int | None) -> bool:
    """Whether labels of this document may not be learnt from."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def _held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample(docs: DataFrame, ids: DataFrame) -> list[tuple[int, list]]:
    """(doc_id, features) of the documents that a bounded list of ids names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(document_features(b.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "features"])

    # rows that repeat a doc_id and its text count once
    rows = map_arrow(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), run, "doc_id long, features array<int>").distinct()
    got = rows.toArrow()
    return [(i, np.asarray(f.values)) for i, f in zip(got.column(0).to_pylist(), got.column(1), strict=True)]


def _least(rows: DataFrame, n: int) -> list[int]:
    """At most n ids, those with the smallest hashes; the same ones whatever the partitioning."""
    return [r[0] for r in rows.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]


def _parts(docs: DataFrame, positive: list[np.ndarray], prior: float, start: Model) -> list[tuple[int, np.ndarray, float]]:
    """A model (documents, weights, bias) of each part of all documents, trained on from start; features that no positive has are left out before the shuffle."""
    bins = positive_bins(positive)
    wanted = np.zeros(1 << BITS, bool)
    wanted[bins] = True

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [f[wanted[f]].tobytes() for f in document_features(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], ["hash", "features"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def one() -> pa.RecordBatch:
            model = train_nnpu(positive, [np.frombuffer(f, np.int32) for f in held], prior, rounds=60, rate=0.02, start=start)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([len(held)]), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["part", "n", "weights", "bias"])

        for b in batches:
            for k, f in zip(b.column("part").to_pylist(), b.column("features").to_pylist(), strict=True):
                if k != part and held:
                    yield one()
                    held = []
                part = k
                held.append(f)
        if held:
            yield one()

    rows = docs.select(F.xxhash64(F.lit("part"), "doc_id", "text").alias("hash"), "text")
    parts = max(1, -(-rows.count() // PART))
    rows = map_arrow(rows, featured, "hash long, features binary").withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))
    # rows of one hash are copies; the order within a part is that of hashes, whatever the partitioning
    dealt = rows.repartition("part").sortWithinPartitions("part", "hash")
    models = map_arrow(dealt, trained, "part int, n long, weights binary, bias double").collect()
    return [(r["n"], np.frombuffer(bytes(r["weights"])), r["bias"]) for r in sorted(models, key=lambda r: r["part"])]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the bounded sample of positives and all documents; labels of held-out documents are not read.

    What reaches the driver is the labelled sample and one model (a few thousand weights) for each PART documents.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~_held_out("doc_id"))
    n = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("toxic")).first()
    prior = min(0.5, max(1e-3, (n["toxic"] or 0) / max(1, n["n"])))
    toxic = set(_least(known.where("toxic = 1"), MAX_POSITIVE))
    checked = {r[0]: r[1] for r in known.groupBy("doc_id").agg(F.max("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_CALIBRATION).collect()}
    wanted = sorted(toxic | checked.keys())
    rows = sorted(_sample(docs, spark.createDataFrame([(i,) for i in wanted], "doc_id long")), key=lambda r: (r[0], r[1].tobytes())) if wanted else []
    positive = [f for i, f in rows if i in toxic]
    bins = positive_bins(positive)
    # the labelled sample's texts, taken as unlabelled, give the model that all parts start from
    start = train_nnpu(positive, [f for i, f in rows if i in checked], prior)
    models = _parts(docs, positive, prior, start) if len(bins) else []
    model = mixed(models, bins) if models else Model(bins[:0], np.zeros(0), float(np.log(prior / (1 - prior))))
    labelled = [(f, checked[i]) for i, f in rows if i in checked]
    return calibrate(model, [f for f, _ in labelled], np.array([y for _, y in labelled]))


def score_texts(model: Model, weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Scores from 0 to 1. Only features with a weight are kept before each is counted once a document."""
    out = np.full(len(texts), model.bias)
    for first, last, data, offsets in blobs([t and t.lower() for t in texts]):
        found, start = _features(data)
        kind, word = np.nonzero(weights[found])
        bins = found[kind, word]
        doc = np.searchsorted(offsets, start[word], "right") - 1
        once = np.unique(doc.astype(np.int64) << BITS | bins)
        out[first:last] += np.bincount(once >> BITS, weights[once & ((1 << BITS) - 1)], last - first)
    return _sigmoid(model.slope * out + model.shift)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Whole texts are scored, and nothing but the text is an input. Null and empty texts have no features and get the score
    of the bias alone. A null doc_id counts as the empty string for the fold. Repeated rows give repeated results, and an
    empty table gives none. Without usable labels, every score is the smallest allowed prior. Columns beyond doc_id and text are ignored.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for b in batches:
            score = score_texts(model, weights, b.column(1).to_pylist())
            held = [is_held_out(i) for i in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic; the columns stay as they are. A null text is kept or not by its score, like an empty one."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for b in batches:
            score = score_texts(model, weights, b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array(score < THRESHOLD))

    return map_arrow(docs, run, docs.schema)


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
