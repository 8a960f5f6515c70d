"""Vectorised hashing of words and shingles over whole batches of texts."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes that are hashed at once; longer data is cut between words. Tables of powers are kept up to this length.
PART = 1 << 18
_powers: list[np.ndarray] = []

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the word contract: space and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters for bag-of-words features: a to z in either case and all bytes above ASCII.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n at least."""
    if n > PART:
        return [_table(_BASE, n + 1), _table(_INVERSE, n + 1)]
    if not _powers:
        _powers[:] = [_table(_BASE, PART + 1), _table(_INVERSE, PART + 1)]
    return _powers


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def _cuts(inside: np.ndarray) -> list[int]:
    """Where to cut data into parts of about PART bytes, never inside a word."""
    cuts = [0]
    while len(inside) - cuts[-1] > PART:
        at = cuts[-1] + PART
        while at < len(inside) and inside[at : at + PART].all():
            at += PART
        cuts.append(min(len(inside), at + int(inside[at : at + PART].argmin()) if at < len(inside) else at))
    return cuts if len(cuts) > 1 and cuts[-1] == len(inside) else [*cuts, len(inside)]


def word_hashes(data: bytes, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of data, ASCII lower-cased.

    Words are runs of bytes that are not white space, or runs of the given letters. Equal words have equal
    64-bit hashes in every process. Memory beyond the data and the result is that of a part, or of the longest word.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = letters[raw] if letters is not None else ~IS_SPACE[raw]
    cuts = _cuts(inside)
    parts = [_hashed(raw[a:b], inside[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _hashed(raw: np.ndarray, inside: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = runs(inside)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    up, down = _power(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[_LOWER[raw]] * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start + at, end + at


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of size words; fewer words count as one shingle, none as none."""
    n = len(words)
    if not n:
        return words
    if n < size:
        out = np.full(1, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(3) + words[k : k + 1])
        return out
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k : n - size + 1 + k]
    return mix(out)


def blobs(texts: list[str | None], most: int = PART) -> list[tuple[int, int, bytes, np.ndarray]]:
    """Texts joined to byte strings of about most bytes: (first, last + 1, bytes, offset of each text and the end).

    A line feed stands between texts, so no word crosses from one to the next.
    """
    out, first, parts, size = [], 0, [], 0
    for i, t in enumerate([*texts, None]):
        if i == len(texts) or size >= most:
            if parts:
                offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
                out.append((first, first + len(parts), b"\n".join(parts) + b"\n", offsets))
            first, parts, size = i, [], 0
        if i < len(texts):
            parts.append((t or "").encode("utf-8"))
            size += len(parts[-1]) + 1
    return out
