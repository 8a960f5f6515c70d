"""Sharding, archive and tokens."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessella.llm import bpe, sharding, warc
from tessella.llm.common import scratch


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_shards(spark, make, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = [(i * 7919 - 50_000, "ä" * (i % 5)) for i in range(3000)] + [(5, None), (5, None), (2**63 - 1, ""), (-(2**63), "z"), (None, "n")]
        got = sharding.assign_shards(make(rows), slices=16).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        key = r.doc_id or 0
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25)) and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].size == 8 and by_id[5].text_crc32 == 0 and by_id[1 * 7919 - 50_000].size == 10
    assert by_id[1 * 7919 - 50_000].text_crc32 == zlib.crc32("ä".encode())
    assert sharding.assign_shards(make([])).count() == 0


def test_archive(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>{i % 4}</p>") for i in range(20)] + [(30, "u", None), (31, None, ""), (32, "x\r\ny", "<b>é</b>"), (33, "q", "x" * 100_000), (19, "http://a/19", "<p>3</p>"), (None, "n", "<p>1</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload_bytes", "'s' as sha256")
    path = scratch(spark, "test")
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[2] or "" for r in rows}
    leader = {}
    for i, _, h in rows:
        leader[h or ""] = max(leader.get(h or "", -1), -1 if i is None else i)
    assert spark.read.parquet(f"{path}/payloads").count() == len(leader)
    for r in got:
        data = text[r.page_id].encode()
        first = leader[text[r.page_id]]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert body == (data if r.record_type == "response" else b"") + b"\r\n\r\n"
    small = scratch(spark, "test")
    warc.write_archive(pages, small, min_payload=1 << 30)
    assert {r.record_type for r in warc.read_archive(spark, small).collect()} == {"response"}
    empty = scratch(spark, "test")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damage_is_found(spark):
    path = scratch(spark, "test")
    warc.write_archive(spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "unhex(hex(body)) as body").collect()
    bad = [(hashlib.sha256(b"<p>").digest(), bytearray(zlib.compress(b"<q>")))]
    spark.createDataFrame(bad, "sha256 binary, body binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_tokens_are_the_library_s(spark, make, corpus, library):
    rng = random.Random(0)
    letters = "abcdefghijklmnopqrstuvwxyz'  \n\t.,!ÀÉßñ²½ªǅ中文字éΣς́İ😀   \x1c\x85IXǄ๑๒ﬁⅨ①"
    texts = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "x" * 5000, "thequickbrown" * 100, "don't we'll I'd it's'S 'RE", "ſ K Å", None, "", " "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + [t for _, t in corpus]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in bpe.encoding_digests(make(rows), bpe.default_tokenizer()).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(make(rows), bpe.default_tokenizer()).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert full[i].ids == ids and full[i].decoded == said
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 900)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    encoder = bpe.TrieBPE(bpe.default_tokenizer())
    for t in ("some words here", "other words there", "some words here", "there are words", "here", "other some"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.ids) + len(encoder.older) <= 12 and encoder.decode(encoder.encode(t)) == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)


def test_tokens_of_odd_tables(spark, make):
    assert bpe.encoding_digests(make([]), bpe.default_tokenizer()).count() == 0
    docs = make([(1, "same words"), (1, "same words"), (None, None)]).selectExpr("*", "1 as n_tokens", "'x' as ids_sha256")
    got = sorted((str(r.doc_id), r.n_tokens) for r in bpe.encoding_digests(docs, bpe.default_tokenizer()).collect())
    assert got == [("1", 2), ("1", 2), ("None", 0)]
