"""Byte-pair encoding by traversal of a prefix tree of distinct words, and decoding.

In a merge-rank BPE, the encoding of a string is the one token sequence whose neighbours are all stable, that is, encode
together to themselves. So each prefix of a word is described by one number: the last token of its encoding. A trie
holds the distinct words; a depth-first walk carries the states of the current path, and a prefix that many words share is
encoded once. The tokenizer file is a parameter and is read by path on each executor.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Below this code point, letters and case are as old as Unicode itself, and Python's tables agree with any library's.
_COMMON = 0x250
#: A worker holds two generations of words, and drops the older one whenever the younger has grown to so many bytes; words that are
#: met again move to the younger one, others are encoded again. A word counts with its ids and the tables' room for both.
CACHE_BYTES = 24_000_000
WORD_BYTES = 260
#: Pairs of tokens that a worker remembers to be stable or not (about 120 bytes each) before it starts afresh.
CACHE_PAIRS = 300_000
#: Words longer than this are walked one by one instead of being inserted: a branch of a million nodes would share nothing.
LONG_WORD = 200


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _pattern() -> str:
    """Contractions, runs of letters, single numbers and runs of anything else but white space, for common characters."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(_COMMON)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind].append(re.escape(c))
    letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r\x20\x85\xa0{letters}{numbers}]+"


class TrieBPE:
    """Encoder and decoder for a tokenizers file of the kind BPE with byte letters and a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        # tokens that can stand inside a word and those that end one, the latter without the suffix
        self.inner = {s: i for s, i in self.vocab.items() if not s.endswith(self.suffix)}
        self.final = {s[: -len(self.suffix)]: i for s, i in self.vocab.items() if s.endswith(self.suffix)}
        self.symbols = {i: (list(s) if not s.endswith(self.suffix) else [*s[: -len(self.suffix) - 1], s[-len(self.suffix) - 1 :]]) for s, i in self.vocab.items() if s != self.suffix}
        # by their last three letters, the lengths of the tokens that end so, long ones first
        self.sizes = {id(kind): self._sizes(kind) for kind in (self.inner, self.final)}
        self.longest = max(map(len, self.symbols.values()))
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.split_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.words = re.compile(_pattern()).findall
        self.common = re.compile(f"[\x00-{chr(_COMMON - 1)}]*\\Z").match
        self.library = Tokenizer.from_file(path)
        self.stable_pairs: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _sizes(kind: dict[str, int]) -> dict[str, list[int]]:
        out: dict[str, set[int]] = {}
        for s in kind:
            out.setdefault(s[-3:], set()).add(len(s))
        return {k: sorted(v, reverse=True) for k, v in out.items()}

    def know(self, word: str, ids: bytes) -> None:
        self.ids[word] = ids
        self.held += WORD_BYTES + 2 * len(word) + len(ids)

    def age(self) -> None:
        """Between batches: keep what is remembered within its bounds."""
        if self.held > CACHE_BYTES:
            self.older, self.ids, self.held = self.ids, {}, 0
        if len(self.stable_pairs) > CACHE_PAIRS:
            self.stable_pairs.clear()

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank; used for pairs of tokens only."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, put side by side, encode to themselves; left -1: whether the right one does."""
        parts = [right] if left < 0 else [left, right]
        known = self.merged([s for i in parts for s in self.symbols[i]]) == [self.token[i] for i in parts]
        self.stable_pairs[left << 32 | right] = known
        return known

    def last_token(self, path: list[str], states: list[int], kinds: dict[str, int]) -> int:
        """Last token of the encoding of the whole path, given the last token of each shorter prefix."""
        n = len(path)
        whole = "".join(path[max(0, n - self.longest) :])
        sizes, known = self.sizes[id(kinds)], self.stable_pairs
        for tail in (3, 2, 1):
            for size in sizes.get(whole[-tail:], ()) if tail <= n else ():
                token = kinds.get(whole[-size:]) if size <= n else None
                if token is None:
                    continue
                # beside the last token before it; at the start of a word, a token must encode to itself
                left = -1 if size == n else states[n - size]
                fits = known.get(left << 32 | token)
                if self.stable(left, token) if fits is None else fits:
                    return token
        raise ValueError(f"no token ends {whole!r}")

    def spelled(self, end: int, states: list[int], n: int) -> list[int]:
        """Walk back from the last token over the states of the prefixes."""
        out = [end]
        at = n - len(self.symbols[end])
        while at > 0:
            out.append(states[at])
            at -= len(self.symbols[states[at]])
        return out[::-1]

    def encode_long(self, letters: str) -> list[int]:
        path, states = [], [-1]
        for c in letters[:-1]:
            path.append(c)
            states.append(self.last_token(path, states, self.inner))
        path.append(letters[-1])
        return self.spelled(self.last_token(path, states, self.final), states, len(letters))

    def learn(self, words: set[str]) -> None:
        """Insert words into a trie and walk it depth first; keeps each word's ids."""
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles, and scanning its many small tables would take longer than the walk
        try:
            self._learn(words)
        finally:
            if collecting:
                gc.enable()

    def _learn(self, words: set[str]) -> None:
        if not words:
            return
        root: dict = {}
        done: list[tuple[str, list[int]]] = []
        for word in words:
            letters = word.encode("utf-8").decode("latin-1").translate(self.letters)
            if len(letters) > LONG_WORD:
                done.append((word, self.encode_long(letters)))
                continue
            node = root
            for c in letters:
                node = node.setdefault(c, {})
            node[""] = word  # the empty key marks a word's end
        path: list[str] = []
        states = [-1]
        walk = [iter(root.items())]
        while walk:
            c, node = next(walk[-1], (None, None))
            if c is None:
                walk.pop()
                if path:
                    path.pop()
                    states.pop()
                continue
            if c == "":
                done.append((node, self.spelled(self.last_token(path, states, self.final), states, len(path))))
                continue
            path.append(c)
            states.append(self.last_token(path, states, self.inner) if len(node) > ("" in node) else -1)
            walk.append(iter(node.items()))
        for word, ids in done:
            self.know(word, np.array(ids, "<u4").tobytes())

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the file's normalizer and splitter make them."""
        if self.common(text):
            return self.words(text.lower())
        text = self.library.normalizer.normalize_str(text)
        if self.common(text):
            return self.words(text)
        back = {c: i for i, c in self.letters.items()}
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str | None) -> list[list[str] | str]:
        """A text as lists of words, and the special tokens between them."""
        cut = self.split_special.split(text or "") if self.split_special else [text or ""]
        return [part if k % 2 else self.pieces(part) for k, part in enumerate(cut) if part]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        The words that the texts add go into one trie; special tokens stand for themselves.
        """
        cut = [self.parts(t) for t in texts]
        self.age()
        ids, older, fresh = self.ids, self.older, set()
        for parts in cut:
            for words in parts:
                if isinstance(words, list):
                    for w in {w for w in words if w not in ids}:
                        if w in older:
                            self.know(w, older[w])
                        else:
                            fresh.add(w)
        self.learn(fresh)
        out = []
        for parts in cut:
            got: list[bytes] = []
            for words in parts:
                got += map(ids.__getitem__, words) if isinstance(words, list) else [self.special_ids[words]]
            out.append(b"".join(got))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of any ids: their tokens with spaces between."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, TrieBPE] = {}


def _encoder(path: str) -> TrieBPE:
    if path not in _loaded:
        _loaded[path] = TrieBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every row: the operator with its real output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer)
        for b in batches:
            got = bpe.encode_many(b.column(1).to_pylist())
            yield pa.record_batch(
                [b.column(0), pa.array([np.frombuffer(x, "<u4").astype("int32") for x in got], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in got], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return map_arrow(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Every text is encoded, and its ids are decoded again. No shuffle: each worker keeps the words it has met, bounded by CACHE_BYTES.
    Null and empty texts have no tokens and decode to the empty text. A long text is one task's work, in memory of about 100 bytes
    a word beside it. Repeated rows give repeated results, an empty table gives none, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer)
        for b in batches:
            ids = bpe.encode_many(b.column(1).to_pylist())
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), default_tokenizer())
