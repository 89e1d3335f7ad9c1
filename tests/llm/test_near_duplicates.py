from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftspan.llm import grid_order as G
from weftspan.llm import ngram_join as N
from weftspan.llm.graph import components

from .conftest import small, words


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components(spark, links):
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == roots(links, {n for x in links for n in x})


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(None, 3), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and len(got) == 261


def same(labels, want):
    seen: dict = {}
    return len({(a, b) for a, b in zip(labels, want, strict=True)}) == len(set(labels)) == len(set(want)) and seen == {}


def brute(sets, percent):
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(set(a.tolist()) & set(sets[j].tolist()))
            if o and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                links.append((i, j))
    r = roots(links, range(len(sets)))
    return [r[i] for i in range(len(sets))]


@pytest.mark.parametrize("percent", [85, 60, 100])
@pytest.mark.parametrize("seed", range(6))
def test_block_join_is_exact(seed, percent):
    r = random.Random(seed)
    base = [r.sample(range(10_000), r.randint(1, 120)) for _ in range(6)]
    sets = []
    for _ in range(90):
        s = set(r.choice(base))
        for _ in range(r.choice([0, 1, 3, 8, 20])):
            s.discard(r.choice(sorted(s))) if len(s) > 1 and r.random() < 0.5 else s.add(r.randrange(20_000))
        sets.append(np.array(sorted(s), np.int64))
    assert same(N.link_sets(sets, percent=percent).tolist(), brute(sets, percent))
    # what no other set has may be left out if sizes say so
    flat = np.concatenate(sets)
    kinds, count = np.unique(flat, return_counts=True)
    shared = [s[np.isin(s, kinds[count > 1])] for s in sets]
    assert same(N.link_sets(shared, [len(s) for s in sets], percent).tolist(), brute(sets, percent))


def test_packed_numbers():
    x = np.array([3, 9, 9, 2**47], np.uint64)
    assert (N.unpacked(N.packed(x), np.uint64) == x).all()
    y = np.array([5, 1, 7, 0], np.uint32)
    assert (N.unpacked(N.packed(y), np.uint32) == y).all() and (N.unpacked(N.packed(y, False), np.uint32, False) == y).all()
    assert len(N.unpacked(N.packed(x[:0]), np.uint64)) == 0


@pytest.mark.parametrize("percent", [85, 80, 60, 100])
@pytest.mark.parametrize("seed", range(4))
def test_sketches_lose_no_link(seed, percent):
    r = np.random.default_rng(seed)
    base = [r.integers(-(2**62), 2**62, int(n)) for n in r.choice([1, 5, 30, 64, 65, 130, 300, 1000], 6)]
    sets = []
    for _ in range(60):
        s = base[r.integers(0, 6)]
        s = s[r.random(len(s)) >= r.choice([0, 0.02, 0.1, 0.3])]
        s = np.unique(np.concatenate([s, r.integers(-(2**62), 2**62, int(r.choice([0, 0, 1, 5, 40])))]))
        sets.append(s if len(s) else base[0])
    n = np.array([len(s) + r.integers(0, 3) for s in sets])  # some shingles may be in no other set
    ids = np.arange(500, 560)
    a, b = N.may_link(ids, n, np.array([len(s) for s in sets]), [N.sketch(s.astype(np.int64), int(k)) for s, k in zip(sets, n, strict=True)], percent)
    block = roots(list(zip(a.tolist(), b.tolist(), strict=True)), ids.tolist())
    for i in range(60):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= percent * (n[i] + n[j] - o):
                assert block[500 + i] == block[500 + j]
    far = [np.unique(r.integers(0, 2**62, 400)) for _ in range(20)]
    assert not len(N.may_link(np.arange(20), np.array([len(x) for x in far]), np.array([len(x) for x in far]), [N.sketch(x, len(x)) for x in far], 80)[0])


def shingle_sets(docs):
    out = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        out[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    return out


def expected(docs):
    sets = shingle_sets(docs)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    r = roots(links, ids)
    return {i: (len(sets[i]), r[i]) for i in ids}


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_classes_against_brute_force(spark, monkeypatch):
    base = [words(n, n) for n in (12, 80, 200, 200)]
    docs = [(1000 - k, edited(base[k % 4], k % 7, k) if k % 5 else base[k % 4]) for k in range(140)] + [(k, "common line here to see\n" + words(60, 500 + k)) for k in range(60)] + [(2000, "a b"), (2001, "A  b"), (2002, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = expected(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classes(frame).collect()}
    assert got == want
    # blocks of more sets or shingles than a task takes are split, lists too long for sketches are stars, ranges are many: no link is lost
    for name, value in (("PART_SETS", 9), ("PART_SHINGLES", 1500), ("LIST", 3), ("RANGE_BYTES", 10_000)):
        monkeypatch.setattr(N, name, value)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classes(frame).collect()} == want


def test_classes_of_documents(spark):
    rows = small(spark).select("doc_id", "text")
    want = expected([tuple(r) for r in rows.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.classes(rows).collect()} == want


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = words(30, 1), words(30, 2)
    got = sorted((r["doc_id"], r["component_id"]) for r in N.classes(spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (None, a)], "doc_id long, text string")).collect() if r["doc_id"] is not None)
    assert got == [(5, 5), (5, 5), (7, 5), (9, 5)]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    centers = r.standard_normal((20, 16))
    x = np.concatenate([centers[r.integers(0, 20, 2500)] + 0.13 * r.standard_normal((2500, 16)), np.repeat(centers[:1], 40, 0)]).astype(np.float32)
    return list(range(100, 100 + len(x))), x, (r.integers(0, 3, len(x)) == 0).astype(int)


def test_vectors_against_brute_force(spark, vectors):
    ids, x, label = vectors
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    root = roots([(ids[i], ids[j]) for i, j in zip(a, b, strict=True) if i < j], ids)
    frame = spark.createDataFrame([(i, v.tolist(), int(y)) for i, v, y in zip(ids, x, label, strict=True)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in G.near_duplicates(frame).collect()}
    assert got == {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, hit.sum(1), strict=True)}


def test_recursion_skips_distant_blocks():
    r = np.random.default_rng(1)
    near, far = r.standard_normal((600, 4)) * 0.01, r.standard_normal((600, 4)) * 0.01 + 5
    side = lambda x, at: G.Side(np.arange(at, at + len(x)).tobytes(), np.ones(len(x), np.int64).tobytes(), x[:, :2].copy().tobytes(), x.tobytes(), 4)
    assert G.join_sides(side(near, 0), side(far, 1000), False, 0.98, 0.2)[4] == 0
    a = side(near, 0)
    assert G.join_sides(a, a, True, 0.98, 0.2)[4] > 0


def test_forest():
    ends = G.forest(np.array([5, 7, 9]), np.array([7, 3, 9]))
    assert dict(zip(*[e.tolist() for e in ends], strict=True)) == {5: 3, 7: 3}


def test_intermediate_tables_are_deleted(spark):
    import os

    from weftspan.llm._shared import shared_dir

    there = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("table-")}
    before = there()
    N.classes(small(spark)).count()
    assert len(there() - before) <= 4  # the rows, the links, and the last edges of two searches


def test_the_pipeline_links_by_five_words_and_four_fifths(spark):
    from corpus_pipeline import deduplicated

    one = [f"w{k}" for k in range(100)]
    far = [*one[:30], "x", *one[31:70], "y", *one[71:]]  # 4 words 89 / 105 = 0.848, linked by five words: 86 / 106 = 0.811
    none = [*one[:20], "x", *one[21:50], "y", *one[51:80], "z", *one[81:]]  # 5 words 81 / 111 = 0.73
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(far)), (3, " ".join(none))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in deduplicated(spark, docs, "").collect()) == [1, 3]


def test_the_pipeline_keeps_each_text_of_a_repeated_id(spark):
    from corpus_pipeline import deduplicated

    a, b, c, d = (words(40, 900 + k) for k in range(4))
    rows = [(5, a, "x"), (5, b, "x"), (5, b, "x"), (7, b, "y"), (3, a, "y"), (None, c, "x"), (None, c, "x"), (None, c, "y"), (9, d, "x"), (None, d, "x"), (None, None, "x"), (8, "", "x"), (10, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in deduplicated(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (8, ""), (9, d), (10, ""), (None, c), (None, None)], key=str)
    assert deduplicated(spark, docs.limit(0), "").count() == 0
