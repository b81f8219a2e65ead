import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import similarity as S


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_all_subsets_match_brute_force(spark, threshold):
    sets = [frozenset(c) for r in range(1, 7) for c in itertools.combinations(range(6), r)]
    units = spark.createDataFrame([(i, "b", sorted(s)) for i, s in enumerate(sets)], "unit long, block string, tokens array<int>")
    heads, _ = S.classes(units, ["block"])
    got = {(r.a, r.b, r.shared, r.total) for r in S.similar_pairs(heads, threshold, ["block"]).collect()}
    want = {
        (i, j, len(a & b), len(a | b)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) >= threshold * len(a | b) - 1e-9
    }
    assert got == want


def test_copies_fold_and_blocks_part(spark):
    rows = [(1, "x", ["a", "b"]), (2, "x", ["b", "a", "a"]), (3, "y", ["a", "b"]), (4, "x", [])]
    heads, members = S.classes(spark.createDataFrame(rows, "unit long, lang string, tokens array<string>"), ["lang"])
    assert {(r.unit, r.head) for r in members.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert S.similar_pairs(heads, 0.5, ["lang"]).count() == 0


def test_order_of_rows_is_irrelevant(spark):
    rows = [(i, [str(j) for j in range(i % 3, 12 + i % 5)]) for i in range(20)]
    units = spark.createDataFrame(rows, "unit long, tokens array<string>")
    results = [sorted(map(tuple, S.similar_pairs(S.classes(u)[0], 0.7).collect())) for u in (units, units.orderBy(F.desc("unit")), units.repartition(7))]
    assert results[0] == results[1] == results[2] != []


def test_owners(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    ranks = spark.createDataFrame([(1, 7), (2, 3), (3, 3), (4, 1), (5, 1)], "unit long, rank int")
    got = {r.unit: (r.higher, r.tied) for r in S.owners(pairs, ranks).collect()}
    assert got == {1: (None, None), 2: (1, 3), 3: (None, 2), 4: (None, 5), 5: (None, 4)}


def test_every_member_of_a_class_has_owners(spark):
    rng = random.Random(4)
    ranks = {i: rng.randint(-1, 2) for i in range(60)}
    head = {i: min(i, 20 + i % 7) if i >= 20 else i - i % 3 for i in range(60)}
    classes = sorted(set(head.values()))
    pairs = [p for p in itertools.combinations(classes, 2) if rng.random() < 0.15]
    linked = {(a, b) for x, y in pairs for a, b in ((x, y), (y, x))}
    want = {}
    for u in head:
        near = [v for v in head if v != u and (head[v] == head[u] or (head[u], head[v]) in linked)]
        want[u] = tuple(min((v for v in near if f(ranks[v], ranks[u])), default=None) for f in (operator.gt, operator.eq))
    got = S.class_owners(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(head.items()), "unit long, head long"), spark.createDataFrame(list(ranks.items()), "unit long, rank int")
    )
    assert {r.unit: (r.higher, r.tied) for r in got.collect()} == want


def test_containment(spark):
    small = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"])], "item long, tokens array<string>")
    large = spark.createDataFrame([(7, ["a", "b", "c", "d"]), (8, ["a"])], "unit long, tokens array<string>")
    assert [tuple(r) for r in S.containment(small, large, 0.8).collect()] == [(1, 7, 4, 5)]
