import gc
import itertools
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from marginalia import queries
from marginalia.functions import tables
from marginalia.operators import alike


def shingles(text, width=5):
    return frozenset(text[i : i + width] for i in range(len(text) - width + 1))


def expected(rows, num, den, least):
    """Pairs of heads and members by brute force; rows are (unit, lang, text)."""
    sets = [(u, lang, shingles(t or "")) for u, lang, t in rows]
    sets = [x for x in sets if len(x[2]) >= least]
    head = {}
    for u, lang, s in sets:
        head[lang, s] = min(u, head.get((lang, s), u))
    pairs = set()
    for ((l1, s), a), ((l2, t), b) in itertools.permutations(head.items(), 2):
        if l1 is not None and l1 == l2 and a < b and den * len(s & t) >= num * len(s | t):
            pairs.add((a, b, len(s & t), len(s | t)))
    return pairs, sorted((u, head[lang, s]) for u, lang, s in sets)


def corpus(rng):
    alphabets = {"en": "abcde ", "zh": "一二三四🙂 "}
    rows = []
    for lang, letters in alphabets.items():
        for _ in range(25):
            text = list("".join(rng.choice(letters) for _ in range(rng.choice([12, 40, 150, 700]))))
            rows.append((lang, "".join(text)))
            for _ in range(rng.randint(0, 4)):
                for _ in range(rng.randint(0, max(1, len(text) // 150))):
                    text[rng.randrange(len(text))] = rng.choice(letters)
                rows.append((lang, "".join(text)))
                rows.append((rng.choice(["en", "zh", None]), "".join(text)))
    rng.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)] + [(1000, "en", ""), (1001, "en", None), (1002, "en", "abcd"), (1003, None, "x" * 9)]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (3, 5), (1, 1)])
def test_pairs_and_members_match_brute_force(spark, tmp_path, num, den):
    rows = corpus(random.Random(num))
    spark.createDataFrame(rows, "unit long, lang string, text string").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    want, heads = expected(rows, num, den, 8)
    pairs, members = alike.joined(texts, 5, 8, num, den)
    assert {tuple(r) for r in pairs.collect()} == want
    assert bool(want) == (num < den)
    assert sorted((r.unit, r.head) for r in members.collect()) == heads
    assert sorted((r.unit, r.head) for r in alike.members(texts, 5, 8).collect()) == heads


def test_sizes_at_the_threshold_meet(spark, tmp_path):
    # Sets of 90 and 100 shingles, one inside the other, at every border of two bands that is near.
    base = "".join(chr(0x4E00 + i) for i in range(400))
    rows = [(n, "zh", base[: n + 4]) for n in range(8, 200)]
    spark.createDataFrame(rows, "unit long, lang string, text string").write.parquet(str(tmp_path / "t"))
    pairs, _ = alike.joined(spark.read.parquet(str(tmp_path / "t")), 5, 8, 9, 10)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(8, 200) for b in range(a + 1, 200) if 10 * a >= 9 * b}


def test_bands_hold_partners():
    lower = alike.band_bounds(5000, 9, 10)
    for m in range(1, 5001):
        n = -(-9 * m // 10)
        assert np.searchsorted(lower, m, "right") - np.searchsorted(lower, n, "right") <= 1


def test_shingles_of_a_slice_and_of_wide_characters():
    texts = pa.array(["abcdefg", None, "😀😀😀😀😀😀", "", "abcde"]).slice(1)
    tokens, first = alike.shingle_sets(texts, 5)
    assert np.diff(first).tolist() == [0, 1, 0, 1]
    assert tokens[1] in alike.shingle_sets(pa.array(["abcdefg"]), 5)[0]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 900):
        u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        v = np.unique(np.concatenate([u[: n - n // 9], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]))
        x, y = (alike.parities(t, np.array([0, len(t)]))[0] for t in (u, v))
        assert alike.differing(x, x) == 0
        assert alike.differing(x, y) == alike.differing(y, x) <= len(np.setxor1d(u, v))


def test_parities_take_no_more_bits_than_tokens():
    for n in (9, 65, 1100):
        assert 8 * len(alike.parities(np.arange(n, dtype=np.uint64), np.array([0, n]))[0]) <= n


def _documents(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(600)), "en", "web", 600) for i in range(n)]
    rows += [(n + i, rows[i][1][:590] + "changed at", "en", "web", 600) for i in range(n // 8)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(path)
    spark.createDataFrame([(i, i % 3, i % 2) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["ambiguous_member_owner", "ambiguous_owner", "member_threshold_sweep", "near_duplicate_documents", "near_duplicate_member_owner", "near_duplicate_members", "near_duplicate_owner", "threshold_sweep"])
def test_no_whole_set_is_shuffled_or_held(spark, tmp_path, name):
    """What a query shuffles and caches stays below 8 bytes a shingle, which whole sets would take."""
    d = _documents(spark, tmp_path, 1600)
    before = _moved(spark)
    queries.QUERIES[name](spark, d).collect()
    assert _moved(spark) - before < 8 * 1600 * 590 * 0.8
    assert not spark.sparkContext._jsc.sc().getRDDStorageInfo()


def _moved(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["ambiguous_owner", "near_duplicate_member_owner", "near_duplicate_owner", "threshold_sweep"])
def test_what_moves_grows_with_texts_not_with_their_pairs(spark, tmp_path, name):
    """Of near copies that are all alike each moves its text a few times, not once for each other one."""
    rng = random.Random(7)
    n, length = 60, 40_000
    base = [rng.choice("abcdefghij ") for _ in range(length)]
    rows = []
    for i in range(n):
        text = base.copy()
        text[rng.randrange(length)] = "k"
        rows.append((i, "".join(text), "en", "web", length))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 3, i % 2) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = _moved(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert queries.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert _moved(spark) - before < 16 * length * n


@pytest.mark.parametrize("name", ["near_duplicate_owner", "threshold_sweep"])
def test_marks_are_on_disk_once_when_their_answers_come_back(spark, tmp_path, monkeypatch, name):
    """Shuffles and tables between steps stay below 3.5 bytes a shingle at the end of each write."""
    rng = random.Random(3)
    n, length = 400, 4_000
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(length)), "en", "web", length) for i in range(n)]
    rows += [(n + i, rows[i][1][:-10] + "changed at", "en", "web", length) for i in range(n // 4)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.createDataFrame([(i, i % 3, i % 2) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "in/labels.parquet"))
    tops = [tmp_path / "shared", *map(Path, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())]
    peaks = []
    parquet = DataFrameWriter.parquet

    def used():
        return sum(p.stat().st_size for top in tops for p in top.rglob("*") if p.name.endswith((".data", ".parquet")))

    def watched(self, *args, **more):
        parquet(self, *args, **more)
        peaks.append(used())

    _freed(spark)
    before = used()
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    assert queries.QUERIES[name](spark, str(tmp_path / "in")).collect()
    assert max(peaks) - before < 3.5 * sum(len(r[1]) for r in rows)


def _freed(spark):
    """Waits until the shuffles that nothing refers to are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
