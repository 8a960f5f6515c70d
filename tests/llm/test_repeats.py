"""Near-duplicates, repeated strings, embeddings."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from tessella.llm import neardup, suffixes, vectors


def components(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_truth(rows):
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components(list(sets), pairs)


@pytest.mark.parametrize("block", [128, 2])
def test_near_duplicates(make, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SMALL", 4)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs.withColumnRenamed("lang", "digest").withColumnRenamed("source", "component")).collect()}
    sets, want = near_truth(corpus)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_edges_of_a_large_group_grow_with_its_size(spark, make, monkeypatch):
    """Blocks of one group are joined by an edge for each two of their trees, not by a forest of all members in each pair of blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    made, close, exact = {}, neardup._close_edges, neardup._exact_edges
    for name, edges in (("close", close), ("exact", exact)):
        total = made[name] = spark.sparkContext.accumulator(0)

        def counting(batches, edges=edges, total=total):
            for b in edges(batches):
                total.add(b.num_rows)
                yield b

        monkeypatch.setattr(neardup, f"_{name}_edges", counting)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:at], f"own{k}", *base[at + 1 :]])) for k in range(320) for at in [rng.randrange(200)]]
    got = neardup.near_duplicates(make(rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    blocks = 320 // 16
    assert made["exact"].value <= 320 + blocks * blocks / 2, made["exact"].value
    assert made["close"].value <= 64 * (320 + blocks * blocks / 2), made["close"].value


def test_forests_of_blocks_join_what_one_forest_joins():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, half = int(rng.integers(2, 40)), int(rng.integers(1, 40))
        half = min(half, n)
        sets = [np.unique(rng.integers(0, 12, 10)).astype(np.uint64) for _ in range(n)]
        sigs = np.where(rng.random((n, 64)) < 0.35, rng.integers(1, 9, (n, 64)), 0).astype(np.uint16)
        for whole, parts in (
            (neardup.exact_forest(sets), [neardup.exact_forest(sets[:half]), neardup.exact_forest(sets[half:]) if half < n else [], neardup.exact_forest(sets, half)]),
            (neardup.close_forest(sigs, np.full(n, 9)), [neardup.close_forest(sigs[:half], np.full(half, 9)), neardup.close_forest(sigs[half:], np.full(n - half, 9)), neardup.close_forest(sigs, np.full(n, 9), half)]),
        ):
            edges = parts[0] + [(a + half, b + half) for a, b in parts[1]] + (parts[2] if half < n else [])
            assert components(range(n), edges) == components(range(n), whole) and len(edges) == len(whole)


def test_near_duplicates_of_odd_tables(make):
    assert neardup.near_duplicates(make([])).count() == 0
    got = neardup.near_duplicates(make([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None), (6, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == sorted([(-1, 4, False), (4, 4, True), (4, 4, True), (5, 5, True), (6, 6, True)])


def repeats_truth(rows, length):
    data = {k: (t or "").encode() for k, (_, t) in enumerate(rows)}
    seen = Counter(d[i : i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = []
    for k, (i, _) in enumerate(rows):
        d = data[k]
        gone = [False] * len(d)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 1])
def test_repeated_strings(docs, corpus, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MAX_PIECES", most)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(docs.withColumnRenamed("lang", "tid")).collect())
    assert got == repeats_truth(corpus, 400)


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_repeats_of_one_hot_passage(make, monkeypatch, sent):
    """Many different texts around one passage: groups are cut twice, and look-ups are broadcast or not."""
    monkeypatch.setattr(suffixes, "MAX_PIECES", 3)
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(suffixes, "SEGMENT", 1500)
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage = noise(390)
    rows = [(i, noise(rng.randrange(200)) + rng.choice(["", "near", "nearer"]) + passage + rng.choice(["", "end here", "end there and on"]) + noise(rng.randrange(300))) for i in range(60)]
    rows += [(60, passage * 9), (61, noise(2000) + passage + noise(2000)), (61, rows[3][1])]
    got = sorted(tuple(r) for r in suffixes.remove_repeats(make(rows)).collect())
    assert got == repeats_truth(rows, 400) and sum(r[2] > 0 for r in got) > 10


def test_narrowed_parts_hold_every_string():
    rng = random.Random(1)
    for _ in range(50):
        away, strings = rng.randrange(337), rng.randrange(1, 338)
        strings = min(strings, away + 1)
        piece = bytes(rng.choices(b"abcdef", k=strings + 399))
        for width in (48, 7, 1):
            got = [(first + k, own[k : k + 400]) for _, first, own, gone in suffixes.narrowed(piece, away, width) for k in range(len(own) - 399)]
            assert sorted(got) == [(k, piece[k : k + 400]) for k in range(strings)]


def test_files_of_a_collection_are_sequential_and_go(tmp_path):
    rng = random.Random(4)
    core = bytes(rng.choices(b"abcd", k=500))
    rows = [(1, core, 60), (1, core[20:] + b"x", 40), (2, core, 60), (2, core[:450] + b"y", 60)]
    flags = suffixes.Collection(rows, str(tmp_path)).repeated()
    assert [int(f.sum()) for f in flags] == [81, 81, 51, 51] and not list(tmp_path.iterdir())


def test_repeated_strings_of_odd_tables(make):
    assert suffixes.remove_repeats(make([])).count() == 0
    rows = [(1, None), (1, None), (2, "q" * 399), (3, "q" * 400), (4, "p" * 401)]
    assert sorted(tuple(r) for r in suffixes.remove_repeats(make(rows)).collect()) == repeats_truth(rows, 400)


def test_segments_of_long_texts(monkeypatch, make):
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text), (2, text[2000:2900] + "end"), (3, "".join(rng.choice("abcdefgh ") for _ in range(3000)))]
    # segments are cut in the worker, so run its function here
    assert suffixes.SEGMENT == 1000
    keys = [
        {(int(k), int(s)) for data, ends, _, _ in suffixes._joined([t.encode()]) for k, s in zip(*suffixes.pieces(data, ends)[:2], strict=True)} for _, t in rows
    ]
    assert keys[0] and {k for k, _ in keys[0]} & {k for k, _ in keys[1]} and not keys[0] & keys[2]
    covered = set()
    for data, ends, _, place in suffixes._joined([text.encode()]):
        _, _, start, n, _ = suffixes.pieces(data, ends)
        part = np.searchsorted(ends[:, 0], start, "right") - 1
        for s, k, p in zip(start.tolist(), n.tolist(), part.tolist(), strict=True):
            covered |= set(range(s - ends[p, 0] + place[p], s - ends[p, 0] + place[p] + k))
    assert covered == set(range(len(text) - 399))


def link_truth(rows):
    out, linked = {}, []
    for k, (i, v) in enumerate(rows):
        out[k] = 0
        for j, (i2, v2) in enumerate(rows):
            if j != k and all(vectors.usable(x) for x in (v, v2)) and len(v) == len(v2) and i is not None and i2 is not None:
                a, b = np.array(v, float), np.array(v2, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    out[k] += 1
                    linked.append((i, i2))
    return out, components([i for i, _ in rows if i is not None], linked)


@pytest.mark.parametrize(("block", "leaf", "pivots"), [(4096, 256, 3), (16, 4, 1)])
def test_embeddings(spark, monkeypatch, block, leaf, pivots):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("PIVOTS", pivots)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + rng.normal(scale=0.35, size=8)]) for k in range(200)]
    rows += [(200 + k, rows[k % 3][1]) for k in range(9)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, [1.0, 2.0]), (305, [1.0, 2.1]), (306, []), (307, [x * 1e-3 for x in rows[5][1]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as copies", "2 as id", "'b' as data")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {r.vec_id: r for r in vectors.vector_links(frame).collect()}
    count, component = link_truth(rows)
    assert {i: got[i].n_links for i, _ in rows} == {i: count[k] for k, (i, _) in enumerate(rows)}
    assert {i: r.component_id for i, r in got.items()} == component
    assert vectors.vector_links(frame.limit(0)).count() == 0


class Most(AccumulatorParam):
    def zero(self, value):
        return 0.0

    def addInPlace(self, a, b):
        return max(a, b)


def test_clustered_vectors_meet_few_others(spark, monkeypatch):
    """Five times the vectors in tight clusters are dealt out to much less than five times the blocks each."""
    monkeypatch.setattr(vectors, "BLOCK", 128)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    dealt = []
    compare = vectors._compare
    total = spark.sparkContext.accumulator(0)

    def counting(rows):
        total.add(len(rows))
        return compare(rows)

    monkeypatch.setattr(vectors, "_compare", counting)
    for n in (2000, 10_000):
        x = centres[rng.integers(0, 40, n)] + rng.normal(scale=0.05, size=(n, 32))
        before = total.value
        got = vectors.vector_links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
        assert got.where("n_links > 0").count() >= 0.99 * n
        dealt.append(total.value - before)
    assert dealt[1] < dealt[0] * 5**1.3, dealt


def test_vectors_are_sent_in_small_batches(spark, monkeypatch):
    """Vectors that meet all blocks leave a worker in batches of bounded size, and are sent to fewer groups than there are blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    total = spark.sparkContext.accumulator(0)
    largest = spark.sparkContext.accumulator(0.0, Most())
    mapped, compare = vectors.map_arrow, vectors._compare

    def watched(df, fn, schema):
        def measured(batches):
            for b in fn(batches):
                largest.add(float(b.nbytes))
                yield b

        return mapped(df, measured, schema)

    def counting(rows):
        total.add(len(rows))
        return compare(rows)

    monkeypatch.setattr(vectors, "map_arrow", watched)
    monkeypatch.setattr(vectors, "_compare", counting)
    x = np.random.default_rng(3).normal(size=(4000, 64))
    x[3000:3100] = x[:100] + 0.01
    got = vectors.vector_links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1))
    assert sorted(r.vec_id for r in got.where("n_links = 1 and component_id < 100").collect()) == [*range(100), *range(3000, 3100)]
    assert got.where("n_links = 0").count() == 3800
    assert largest.value < 10e6, largest.value
    assert total.value < 20 * 4000, total.value


def test_links_between_groups_of_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("LEAF", 4), ("PIVOTS", 1), ("GROUPS", 3), ("PART_BYTES", 1 << 10)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(scale=0.35, size=8)).tolist()) for k in range(260)] + [(300, [1.0, 2.0]), (301, [1.0, 2.1]), (302, None)]
    got = {r.vec_id: r for r in vectors.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    count, component = link_truth(rows)
    assert {i: r.n_links for i, r in got.items()} == {i: count[k] for k, (i, _) in enumerate(rows)}
    assert {i: r.component_id for i, r in got.items()} == component


def test_links_of_a_leaf_of_close_copies():
    x = vectors._unit([[1.0, 2.0, 3.0]] * 600 + [[-1.0, 0.5, 2.0]])
    tree, ones = vectors.Tree(x), np.ones(601, np.int64)
    assert vectors.dual_links(tree, tree, ones, ones, True)[0].tolist() == [599] * 600 + [0]
    got = vectors.dual_links(tree, vectors.Tree(x[:600]), ones, ones[:600], False)
    assert got[0].tolist() == [600] * 600 + [0] and got[1].tolist() == [600] * 600


def test_tree_covers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vectors.Tree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.first)):
        own = x[tree.order[tree.first[k] : tree.last[k]]]
        assert np.linalg.norm(own - x[tree.centre[k]], axis=1).max() <= tree.radius[k] + 1e-7
        for c in tree.children[k]:
            assert tree.first[k] <= tree.first[c] and tree.last[c] <= tree.last[k]


@pytest.mark.parametrize("most", [100_000, 50])
def test_components(spark, monkeypatch, most):
    from tessella.llm import common

    monkeypatch.setattr(common, "TASK_EDGES", most)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7), (None, 3)]
    ids = sorted({v for e in edges for v in e if v is not None} | {9999})
    got = common.connected_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"), "test").collect()
    want = components(ids, [e for e in edges if None not in e])
    assert {r.id: r.component for r in got} == want
    none = common.connected_components(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "a long, b long"), "test").collect()
    assert [(r.id, r.component) for r in none] == [(1, 1)]
