"""Duplicates, mixing and search against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import common, mixing, repeated_spans, similar_documents, top_products
from marginalia.operators import packs

SCHEMA = "doc_id long, text string, source string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    """Near and exact copies, shared passages, common words, empty and long texts."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    passage, base, out = some(40), some(120), [None, "", "one two", "One TWO", "\n"]
    for i in range(60):
        near = list(base)
        for _ in range(i % 9):
            near[rng.randrange(len(near))] = "changed"
        out += [" ".join(near), " ".join(some(rng.randint(1, 30)) + passage + some(rng.randint(0, 30)))]
    out += [" ".join(base)] * 5 + [" ".join(some(3000)), "a " * 40, "a b " * 30]
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)


def components_by_hand(texts, n, percent):
    sets = [frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else [])) for w in (words((t or "").lower()) for t in texts)]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent", "pack"), [(4, 85, 1 << 21), (5, 80, 500), (2, 50, 1 << 21)])
def test_similar_documents(spark, texts, monkeypatch, n, percent, pack):
    monkeypatch.setattr(packs, "PACK", pack)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents.similar(frame(spark, texts), n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == components_by_hand(texts, n, percent)


def test_chains_of_near_copies(spark):
    """Neighbours link, others do not: pairs outside the representatives' own decide."""
    rng = random.Random(5)
    base, chained = [f"c{i}" for i in range(100)], []
    for i in range(40):
        base[(7 * i) % 100] = f"new{i}"
        chained.append(" ".join(base))
    fans = [" ".join([f"f{i}" for i in range(120)][:110] + [f"own{j}x{k}" for k in range(10)]) for j in range(20)]
    many = chained + fans + [" ".join(rng.choice("abcdef") for _ in range(rng.randint(20, 60))) for _ in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents.similar(frame(spark, many), 4, 85).collect()}
    assert [got[i] for i in range(len(many))] == components_by_hand(many, 4, 85)


def test_similar_rows_that_share_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text, "s"), (4, "other words stand here now", "s"), (2, text, "s"), (None, "none has this", "s"), (7, text, "s"), (7, text, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as class", "3 as key", "4 as tokens")
    got = Counter(map(tuple, similar_documents.similar(docs).collect()))
    assert got == {(4, 27, 2): 1, (4, 2, 4): 1, (2, 27, 2): 1, (None, 1, None): 1, (7, 27, 2): 2}


def test_similar_documents_of_nothing(spark, texts):
    assert similar_documents.similar(frame(spark, texts).limit(0)).count() == 0


def kept_by_hand(rows, k):
    least = {}
    for i, w in sorted(rows):
        for at in range(len(w) - k + 1):
            least.setdefault(tuple(w[at : at + k]), i)
    out = {}
    for i, w in rows:
        gone = [False] * len(w)
        for at in range(len(w) - k + 1):
            if least[tuple(w[at : at + k])] < i:
                gone[at : at + k] = [True] * k
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("bits", "pack"), [(64, 1 << 21), (9, 700)])
def test_repeated_spans(spark, texts, monkeypatch, bits, pack):
    """With 9 bits, unlike windows and nodes collide everywhere."""
    monkeypatch.setattr(packs, "PACK", pack)
    got = {r.doc_id: r for r in repeated_spans.deduplicate(frame(spark, texts), bits=bits).collect()}
    want = kept_by_hand([(i, words(t)) for i, t in enumerate(texts)], 13)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())
    assert repeated_spans.deduplicate(frame(spark, texts).limit(0)).count() == 0


def test_branching_paths(spark):
    """Passages that share beginnings, middles and ends branch; each part has an owner of its own."""
    rng = random.Random(8)
    some = lambda p, n: [f"{p}{rng.randint(0, 10**6)}" for _ in range(n)]
    a, b, c, d = (some(p, 25) for p in "abcd")
    rows = [a + b, a + c, d + b, a + b + c, some("x", 5) + b[3:] + c[:14], c[5:20] + a[:13], b + a, (a[:4] + b[:4]) * 9, d[:12] + b, a + d + a]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_spans.deduplicate(frame(spark, [" ".join(x) for x in rows])).collect()}
    assert got == kept_by_hand(list(enumerate(rows)), 13)


def test_nodes_of_runs():
    """Every node of a run comes with a hash of the edges beside it, none at its ends."""
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(10))
    runs = np.array([[1, 3]], np.int32).tobytes()
    s = pa.record_batch([pa.array([1, 2]), pa.array([b"a", b"b"]), pa.array([text, "z " + text]), pa.array([runs, np.array([[2, 3]], np.int32).tobytes()])], ["key", "whole", "text", "runs"])
    node, beside, at, n = repeated_spans.run_nodes(s, 3)
    assert at.tolist() == [1, 2, 3, 4, 12, 13, 14, 15] and n == 21
    assert node[:4].tolist() == node[4:].tolist() and beside[:4].tolist() == beside[4:].tolist() and len(set(beside.tolist())) == 4


def test_repeated_rows_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "s"), (1, long, "s"), (1, "other " + long, "s"), (2, long, "s"), (None, long, "s")]
    got = Counter((r.doc_id, r.n_removed) for r in repeated_spans.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == {(1, 0): 3, (2, 30): 1, (None, 0): 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("block", [4096, 16])
def test_mixing(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400])), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(300)] + [(300, None, "a"), (7, "w w", "b"), (7, "w w", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets_by_hand(dict(sizes))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    q = mixing.flight(p, x, rng.random(500))
    still = (q > 0) & (q < 1)
    assert still.sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and (q * x).sum() == pytest.approx((p * x).sum(), rel=1e-6)


@pytest.mark.parametrize("block", [2048, 16])
def test_top_products(spark, monkeypatch, block):
    monkeypatch.setattr(top_products, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = [(rng.normal(size=8) * rng.lognormal()).tolist() for _ in range(200)]
    vectors[10] = vectors[11] = vectors[12]
    vectors[20] = [0.0] * 8
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(900, None, "x"), (950, [float("nan")] * 8, "x"), (960, [None] + [1.0] * 7, "x"), (970, [float("inf")] * 8, "x"), (980, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in top_products.top_products(df, df.where("vec_id % 10 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    for q in range(0, 200, 10):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(200), -s)) if i != q][:5]
        assert got[q] == [(int(i), int(s[i])) for i in best]
    assert set(got) == set(range(0, 200, 10))
    assert top_products.top_products(df.limit(0), df.limit(0)).count() == 0


def test_query_rows_that_share_an_id(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)]
    asked = [(1, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [1.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    got = top_products.top_products(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k=5).collect()
    places = defaultdict(list)
    for r in sorted(got):
        places[r.query_id].append((r.rank, r.vec_id))
    first, second = [8, 7, 6, 5, 4], [2, 3, 4, 5, 6]
    assert places == {1: sorted([*enumerate(first, 1), *enumerate(second, 1)]), 2: list(enumerate(first, 1))}
