import pytest
from pyspark.sql import functions as F

from marginalia.functions import lexicons as L
from marginalia.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Use it if needed.", True), ("A gift.", False), ("IF so", True), ("if_x", False), ("éif", False), ("部署后检查", True), ("", False)],
)
def test_phrases_end_at_words(spark, text, want):
    assert one(spark, T.conditional(F.col("t")), t=text) is want


def test_marker_counts_code_points(spark):
    hit = one(spark, T.marker(F.col("t"), ["see", "refer to"]), t="🦀 é Refer to it, see it")
    assert (hit["start"], hit["end"]) == (4, 12)


@pytest.mark.parametrize(("text", "want"), [("plain words", "en"), ("目前版本", "zh"), ("現在のバージョン", "ja"), ("one 中", "en"), ("", "en")])
def test_language(spark, text, want):
    assert one(spark, T.language(F.col("t")), t=text) == want


def test_sentences(spark):
    got = one(spark, T.sentences(F.col("t")), t=" One. Two!  v1.2 stays? 三。四！ ")
    assert got == ["One.", "Two!", "v1.2 stays?", "三。", "四！"]


@pytest.mark.parametrize(("text", "want"), [("a%20b+c", "a b+c"), ("%ZZ", None), ("é", "é")])
def test_percent_decoding_is_strict(spark, text, want):
    assert one(spark, T.percent_decoded(F.col("t")), t=text) == want


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("../x", "../x"), ("a/../../x", "../x"), ("/a//b/", "a/b"), ("..", "..")])
def test_paths(spark, path, want):
    assert one(spark, T.normal_path(F.col("t")), t=path) == want


def test_slug(spark):
    assert one(spark, T.slug(F.col("t")), t="Déjà vu 🦀!") == "déjà-vu-"


def test_shingles_are_distinct_code_points(spark):
    assert sorted(one(spark, T.shingles(F.col("t"), 2), t="🦀🦀🦀a")) == ["🦀a", "🦀🦀"]
    assert one(spark, T.shingles(F.col("t"), 5), t="abc") == []


@pytest.mark.parametrize(("url", "want"), [("https://github.com/a/b", True), ("https://github.com/a/b/c", False), ("https://example.com/a/b", False), ("nonsense", False)])
def test_repository_root(spark, url, want):
    assert one(spark, T.repository_root(F.col("t")), t=url) is want


def test_value_patterns(spark):
    assert one(spark, F.regexp_extract_all("t", F.lit(L.VERSION), F.lit(0)), t="v1.2.3-rc.1 and 4.5") == ["v1.2.3-rc.1", "4.5"]
