"""Secret scan: exact base patterns, and a character convolutional network in numpy over every candidate and its context.

The network is trained on labelled findings: candidates of all documents that belong to a base finding, the same findings altered so that no base
pattern matches them (another name or none before the value, another alphabet or length), and other candidates of sampled documents. Its scores are
calibrated on one part of the sample that it was not trained on, or by cross-fitting where that part would be too small, and the threshold keeps the
wanted recall of altered findings there: those are what only the network can find.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .text import blobs, runs

#: The base patterns, their kinds in the order of listing, and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
#: A candidate is a run of at least so many characters of the alphabet of secrets; the base patterns take no shorter value.
MIN_CANDIDATE = 8
#: Bytes of a window, of those before its anchor, and of the context that is read after a candidate.
WINDOW, BEFORE, AFTER = 64, 24, 24
#: Anchors of a candidate's windows lie at most so far apart, so that each of its bytes follows an anchor in some window.
STRIDE = 32
#: Bounds of the training sample: documents looked at for other candidates, and findings and other candidates used.
SAMPLE_DOCS, MAX_FINDINGS, MAX_OTHERS = 12_000, 4_000, 12_000
#: Windows of a candidate in the training sample; scoring reads them all.
MAX_WINDOWS = 64
#: Parts of the sample, one of which is held out; each is, in turn, if there are fewer than LEAST of a class on either side.
PARTS, LEAST = 4, 5
MIN_RECALL = 0.95
#: Weight, in the second half of training, of other candidates that the first half takes for findings.
HARD = 10.0
#: Lengths of altered values. The base pattern for hex digits takes no run shorter than 32.
SHORT, LONG = 12, 31
#: A sample with fewer findings than this is filled up with made-up values in the places of other candidates.
LEAST_FINDINGS = 64
#: Labels of candidates: other, base finding, altered finding.
OTHER, FOUND, ALTERED = 0, 1, 2

_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_WIDTH, _EMBED, _FILTERS = 5, 8, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base findings in code points, by start and then kind.

    A hex run shorter than 32 can't contain a longer one, so asking for 32 at once finds what filtering by length would.
    """
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the runs of token characters that are long enough."""
    start, end = runs(_TOKEN[np.frombuffer(data, np.uint8)])
    long = end - start >= MIN_CANDIDATE
    return start[long], end[long]


def anchors(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, anchor) of the windows that cover each candidate and its context: from its start on, the last one as far as AFTER reaches."""
    last = np.maximum(start, end - (WINDOW - BEFORE - AFTER))
    many = 1 + -(-(last - start) // STRIDE)
    owner = np.repeat(np.arange(len(start)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return owner, np.minimum(start[owner] + STRIDE * step, last[owner])


def windows(data: bytes, start: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """The bytes around each start, zeros beyond the data and outside of low to high (if given), all bytes above ASCII as 127."""
    raw = np.frombuffer(bytes(BEFORE) + data + bytes(WINDOW), np.uint8)
    at = start[:, None] + np.arange(WINDOW)
    out = np.minimum(raw[at], 127)
    if low is not None and high is not None:
        out[(at < low[:, None] + BEFORE) | (at >= high[:, None] + BEFORE)] = 0
    return out


@dataclass
class Network:
    """Embedding, one convolution, maxima over what is before a window's anchor, over the candidate and over what follows it, and a logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        n = _WIDTH * _EMBED
        return Network(rng.normal(0, 0.5, (128, _EMBED)), rng.normal(0, n**-0.5, (n, _FILTERS)), np.zeros(_FILTERS), np.append(rng.normal(0, 0.3, 3 * _FILTERS), 0.0))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        e = self.embed.astype(np.float32)[x]
        spots = np.lib.stride_tricks.sliding_window_view(e, _WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WINDOW - _WIDTH + 1, -1)
        return np.maximum(spots @ self.conv.astype(np.float32) + self.bias.astype(np.float32), 0)

    @staticmethod
    def inside(x: np.ndarray) -> np.ndarray:
        """Which spots of the convolution from the anchor on start within the candidate."""
        return np.logical_and.accumulate(_TOKEN[x[:, BEFORE : WINDOW - _WIDTH + 1]], axis=1)

    def pooled(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut, own = BEFORE - _WIDTH + 1, self.inside(x)[:, :, None]
        parts = [(h[:, :cut], 0), (np.concatenate([h[:, cut:BEFORE], h[:, BEFORE:] * own], 1), cut), (h[:, BEFORE:] * ~own, BEFORE)]
        return np.concatenate([p.argmax(1) + k for p, k in parts], 1), np.concatenate([p.max(1) for p, _ in parts], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Without positions: only the maxima are needed. The convolution of a pair of bytes is looked up."""
        taps = np.einsum("ce,wef->wcf", self.embed, self.conv.reshape(_WIDTH, _EMBED, _FILTERS)).astype(np.float32)
        pairs = [(taps[w][:, None] + taps[w + 1][None]).reshape(-1, _FILTERS) for w in (0, 2)]
        single = taps[4] + self.bias.astype(np.float32)
        n, cut, got = WINDOW - _WIDTH + 1, BEFORE - _WIDTH + 1, []
        for k in range(0, len(x), 512):
            own = x[k : k + 512]
            code = own[:, :-1].astype(np.int32) * 128 + own[:, 1:]
            h = pairs[0].take(code[:, :n], 0)
            h += pairs[1].take(code[:, 2 : 2 + n], 0)
            h += single.take(own[:, 4 : 4 + n], 0)
            np.maximum(h, 0, out=h)
            inside = self.inside(own)[:, :, None]
            most = np.concatenate([h[:, :cut].max(1), np.maximum(h[:, cut:BEFORE].max(1), (h[:, BEFORE:] * inside).max(1)), (h[:, BEFORE:] * ~inside).max(1)], 1)
            got.append((most * self.out[:-1]).sum(1) + self.out[-1])
        return np.concatenate([*got, np.zeros(0)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.logits(x))

    def chance(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 256, rate: float = 0.01, seed: int = 7, steps: int = 400) -> Network:
    """Adam on class-balanced logistic loss, for so many epochs and steps at least; deterministic."""
    epochs = max(epochs, -(-steps // max(1, -(-len(x) // batch)))) if epochs > 1 else epochs
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network.fresh(rng)
    names = ("embed", "conv", "bias", "out")
    m, v = {n: 0.0 for n in names}, {n: 0.0 for n in names}
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    t = 0
    for epoch in range(epochs):
        if epoch == epochs // 2:  # rare kinds of others that still look like findings count more from now on
            hard = (y == 0) & (net.logits(x) > 0)
            weight = weight * np.where(hard, HARD, 1.0)
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            own = order[k : k + batch]
            at, value = net.pooled(x[own], net.hidden(x[own]))
            p = 1 / (1 + np.exp(-np.clip(value @ net.out[:-1] + net.out[-1], -40, 40)))
            g = (p - y[own]) * weight[own] / len(own)
            dv = g[:, None] * net.out[:-1] * (value > 0)
            # only the spots of the maxima have gradients: summed by tap, byte and filter, they give those of embedding and convolution
            spot, byte = np.arange(len(own))[:, None], x[own]
            keys = [byte[spot, at + w].astype(np.int64) * _FILTERS + np.arange(at.shape[1]) % _FILTERS for w in range(_WIDTH)]
            sums = np.stack([np.bincount(key.ravel(), dv.ravel(), 128 * _FILTERS).reshape(128, _FILTERS) for key in keys])
            embed = np.einsum("wcf,wef->ce", sums, net.conv.reshape(_WIDTH, _EMBED, _FILTERS), optimize=True)
            conv = np.einsum("ce,wcf->wef", net.embed, sums, optimize=True).reshape(-1, _FILTERS)
            grads = {"embed": embed, "conv": conv, "bias": sums[0].sum(0), "out": np.append(value.T @ g, g.sum())}
            t += 1
            for n in names:
                m[n] = 0.9 * m[n] + 0.1 * grads[n]
                v[n] = 0.999 * v[n] + 0.001 * grads[n] ** 2
                setattr(net, n, getattr(net, n) - rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8))
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """scaled() on candidates of one window each that were held out from training."""
    return scaled(net, net.logits(x), y)


def scaled(net: Network, raw: np.ndarray, y: np.ndarray) -> Network:
    """Platt scaling of held-out candidates' outputs, and the threshold.

    It keeps MIN_RECALL of their altered findings (of all, if none is altered) with as few others as that allows, and lies halfway between the
    classes where they stand apart.
    """
    from .toxicity import Model
    from .toxicity import calibrate as platt

    scale = Model(np.zeros(1, np.int64), np.ones(1), 0.0)
    scale.raw = lambda docs: np.array(docs)  # type: ignore[method-assign]
    scale = platt(scale, list(raw), (y > 0).astype(int))
    net.slope, net.shift = scale.slope, scale.shift
    found, others = np.sort(raw[y == max(FOUND, y.max(initial=0))]), raw[y == OTHER]
    if not len(found):
        net.threshold = 2.0
        return net
    highest = found[int((1 - MIN_RECALL) * len(found))]
    most = others.max(initial=-np.inf)
    net.threshold = float(net.chance((highest + most) / 2 if np.isfinite(most) and most < highest else highest))
    return net


def _chars(data: bytes, at: int) -> int:
    return len(data[:at].decode("utf-8"))


def _values(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end) of each base finding and of its value, in bytes."""
    found = [(m.span(), m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    found += [((s, e), (s, e)) for s, e, kind in base_spans(text) if kind]
    return [tuple(len(text[:k].encode("utf-8")) for k in (*span, *value)) for span, value in found]


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def altered(data: bytes, found: tuple[int, int, int, int], rng: random.Random) -> Iterator[tuple[bytes, int, int, int]]:
    """A finding (start, end, and those of its value) in its surroundings, so changed that no base pattern matches it: data, start, end and label of its candidate, and of a name before it."""
    s, e, vs, ve = found
    left, right = data[max(0, s - 2 * BEFORE) : s].decode("utf-8", "ignore"), data[e : e + 2 * AFTER].decode("utf-8", "ignore")
    before, value = data[s:vs].decode("utf-8"), data[vs:ve].decode("utf-8")
    separator = re.sub(r"^\w+", "", before)
    name = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 12)))
    size = min(len(value), rng.randint(SHORT, LONG), rng.randint(SHORT, 2 * LONG))
    own = value[rng.randint(0, len(value) - size) :][:size]
    mixed = dict(zip(sorted(set(own)), rng.sample(_ALNUM, len(_ALNUM)), strict=False))
    fresh = "".join(mixed[c] for c in own)
    for head, core in ((name + separator, own), ("", own), (name + separator, fresh), ("", own.upper()), ("", fresh), (name + ": ", own.upper()), (name + " ", fresh.upper())):
        # quotes that the value stood in go with its name
        text, tail = left + head + core, right if head.endswith(separator) and separator else right.lstrip("\"'")
        if any(x < len(text) and len(text) - len(core) < y for x, y, _ in base_spans(text + tail)):
            continue
        at, whole = len(text.encode("utf-8")) - 1, (text + tail).encode("utf-8")
        start, end = candidates(whole)
        named = len(left.encode("utf-8"))
        for x, y in zip(start.tolist(), end.tolist(), strict=True):
            if x <= at < y:
                yield whole, x, y, ALTERED
            elif x <= named < y <= at - len(core):
                yield whole, x, y, OTHER


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate's windows, its label, and which of its windows do from their anchors on.

    Candidates that only overlap the rest of a finding, such as the name before a value, are neither. Others are only those of documents
    asked for, and of each task the MAX_OTHERS with the smallest hashes.
    """
    others: dict[bytes, tuple] = {}

    def least() -> list[tuple]:
        return sorted(others.values())[:MAX_OTHERS]

    def example(data: bytes, s: int, e: int, inside: list[tuple[int, int]], doc: int, label: int) -> tuple:
        at = anchors(np.array([s]), np.array([e]))[1]
        hits = np.array([any(a < min(y, e) and x < a + WINDOW - BEFORE for x, y in inside) for a in at.tolist()], np.uint8)
        if len(at) > MAX_WINDOWS:
            keep = np.sort(np.concatenate([np.flatnonzero(hits), np.flatnonzero(hits == 0)])[:MAX_WINDOWS])
            at, hits = at[keep], hits[keep]
        x = windows(data, at).tobytes()
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True), doc, x, label, hits.tobytes()

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["rank", "doc", "window", "label", "hits"])

    for b in batches:
        rows = []
        for doc, text, asked in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            values = _values(text or "")
            if not values and not asked:
                continue
            data = (text or "").encode("utf-8")
            start, end = candidates(data)
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                near = [v for v in values if s < v[1] and v[0] < e]
                inside = [(v[2], v[3]) for v in near if s < v[3] and v[2] < e]
                if inside:
                    rows.append(example(data, s, e, inside, doc, FOUND))
                elif not near and asked:
                    row = example(data, s, e, [], doc, OTHER)
                    others[row[2]] = min(row, others.get(row[2], row))
            for v in values:
                rng = random.Random(data[v[0] : v[1]])
                for own, s, e, label in altered(data, v, rng):
                    row = example(own, s, e, [(s, e)] if label else [], doc, label)
                    if label:
                        rows.append(row)
                    else:
                        others[row[2]] = min(row, others.get(row[2], row))
            if len(others) > 2 * MAX_OTHERS:
                others = {r[2]: r for r in least()}
        yield sent(rows)
    yield sent(least())


def made_up(others: list, n: int) -> list:
    """Findings with made-up values in the places of other candidates that one window covers, for samples with few real ones."""
    rng, out = random.Random(n), []
    for k, row in enumerate([r for r in others if len(r["hits"]) == 1][:n]):
        x = row["window"]
        inside = int(np.logical_and.accumulate(_TOKEN[np.frombuffer(x[BEFORE:], np.uint8)]).sum())
        value = "".join(rng.choices("0123456789abcdef" if k % 2 else _ALNUM, k=rng.randint(SHORT, LONG))).encode()
        out.append({"doc": row["doc"], "window": (x[:BEFORE] + value + x[BEFORE + inside :] + bytes(WINDOW))[:WINDOW], "label": ALTERED, "hits": b"\x01"})
    return out


def fit(docs: DataFrame) -> Network | None:
    """Train on a bounded sample: findings of all documents by hash, these altered, and other candidates of the documents with the smallest hashes.

    A sample of fewer than LEAST_FINDINGS is filled up with made-up ones. None if there are no candidates to learn from.
    """
    docs = docs.select("text", F.xxhash64("doc_id", "text").alias("doc"))
    sampled = docs.select("doc").distinct().orderBy("doc").limit(SAMPLE_DOCS).collect()
    if not sampled:
        return None
    every = map_arrow(docs.select("doc", "text", F.col("doc") <= sampled[-1][0]), _labelled, "rank long, doc long, window binary, label int, hits binary")
    # the part that every window falls into is decided by one of its documents
    every = written(every.groupBy("rank", "window", "label", "hits").agg(F.min("doc").alias("doc")), "secret-sample")
    bounds = ((ALTERED, MAX_FINDINGS), (FOUND, MAX_FINDINGS), (OTHER, MAX_OTHERS))
    rows = [r for label, most in bounds for r in every.where(F.col("label") == label).orderBy("rank", "window", "hits").limit(most).collect()]
    altered_ = sum(r["label"] == ALTERED for r in rows)
    if altered_ < LEAST_FINDINGS:
        rows += made_up([r for r in rows if r["label"] == OTHER], LEAST_FINDINGS - altered_)
    y, doc = np.array([r["label"] for r in rows], int), np.array([r["doc"] for r in rows], np.int64)
    if (y > 0).sum() < 2 or not (y == 0).any():
        return None
    held = doc % PARTS == 0
    if min((y[~held] > 0).sum(), (y[~held] == 0).sum(), (y[held] == ALTERED).sum()) >= LEAST:
        return learned(rows, y, held)
    return crossed(rows, y, doc)


def _fold(y: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Parts by document, with the findings dealt out evenly: of one document only, they are dealt out one by one."""
    ids, at = np.unique(doc[y > 0], return_inverse=True)
    fold = np.abs(doc % PARTS)
    fold[y > 0] = (at if len(ids) > 1 else np.arange((y > 0).sum())) % PARTS
    return fold


def _arrays(rows: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, their labels, each window's row, and which windows to train on: those of a finding that don't see its value say nothing."""
    x = np.frombuffer(b"".join(r["window"] for r in rows), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(rows)), [len(r["hits"]) for r in rows])
    hits = np.frombuffer(b"".join(r["hits"] for r in rows), np.uint8)
    y = (y > 0).astype(int)
    return x, y[owner], owner, hits == y[owner]


def learned(rows: list, y: np.ndarray, held: np.ndarray) -> Network:
    """A network trained on windows of the candidates not held out, and calibrated on whole candidates held out."""
    x, label, owner, used = _arrays(rows, y)
    out = held[owner]
    first = np.flatnonzero(np.diff(owner[out], prepend=-1))
    net = train(x[used & ~out], label[used & ~out])
    return scaled(net, np.maximum.reduceat(net.logits(x[out]), first), y[held])


def crossed(rows: list, y: np.ndarray, doc: np.ndarray) -> Network:
    """A network trained on all candidates, and calibrated on what networks that were trained on the other parts say of each part."""
    x, label, owner, used = _arrays(rows, y)
    fold, raw = _fold(y, doc)[owner], np.zeros(len(x))
    for part in np.unique(fold):
        net = train(x[used & (fold != part)], label[used & (fold != part)])
        raw[fold == part] = net.logits(x[fold == part])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return scaled(train(x[used], label[used]), np.maximum.reduceat(raw, first), y)


def find_all(texts: list[str | None], net: Network | None) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the base findings, and candidates apart from them that the network takes for secrets by any of their windows."""
    out: list[list[tuple[int, int, int]]] = [base_spans(t or "") for t in texts]
    if net is None:
        return out
    for first, _, data, offsets in blobs(texts):
        start, end = candidates(data)
        if not len(start):
            continue
        owner, at = anchors(start, end)
        text = np.searchsorted(offsets, at, "right") - 1
        low, high = offsets[text], offsets[text + 1] - 1  # without the line feed between texts
        chance = np.concatenate([net.probability(windows(data, *(a[k : k + 4096] for a in (at, low, high)))) for k in range(0, len(at), 4096)])
        taken = np.flatnonzero(np.maximum.reduceat(chance, np.searchsorted(owner, np.arange(len(start)))) >= net.threshold)
        doc = np.searchsorted(offsets, start[taken], "right") - 1
        for k, d in zip(taken.tolist(), doc.tolist(), strict=True):
            own = data[offsets[d] : offsets[d + 1]]
            s, e = _chars(own, int(start[k] - offsets[d])), _chars(own, int(end[k] - offsets[d]))
            if not any(s < y and x < e for x, y, _ in out[first + d]):
                out[first + d].append((s, e, 3))
    return [sorted(spans, key=lambda s: (s[0], s[2], s[1])) for spans in out]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans, has_network of every row.

    has_network is false, in every row, if no document sampled has candidates to train a network on: n_model is 0 then for want of one.
    A long text is scanned in one task, candidate by candidate.

    Null and empty texts have no findings. Spans are those of the matches, in code points with exclusive ends. Kinds may overlap each other;
    spans that the network adds overlap no base finding. Repeated rows give repeated results, an empty table gives none, and columns
    beyond doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find_all(b.column(1).to_pylist(), net)
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(_said([s for s in spans if s[2] < 3]).encode()).hexdigest() for spans in found]
            yield pa.record_batch([b.column(0), *counts, pa.array(digest, pa.string()), pa.array([_said(s) for s in found], pa.string()), pa.array([net is not None] * b.num_rows)], ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "has_network"])

    return map_arrow(docs, run, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, has_network boolean")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every found span of the text replaced by [kind]; overlapping spans become one. Other columns stay as they are."""
    net = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            cleaned = [t if not spans else redacted(t, spans) for t, spans in zip(texts, find_all(texts, net), strict=True)]
            yield b.set_column(at, "text", pa.array(cleaned, pa.string()))

    return map_arrow(docs, run, docs.schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k]}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def op7_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
