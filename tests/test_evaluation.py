"""Evaluation over stored diagnostics, and the workspace's own rows."""

import hashlib

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import evaluate, report
from marginalia.plans import scope
from marginalia.sources import workspace


def test_frozen_rows_and_labels(spark):
    found = spark.createDataFrame([("a.md", "X1", 0, 3, "m"), ("b.md", "X2", 1, 4, "n")], "doc string, code string, start long, stop long, message string")
    files = spark.createDataFrame([("a.md", "s1", "t", "en"), ("b.md", "s2", "u", "ja")], "doc string, source string, text string, language string")
    rows = evaluate.frozen(found, files, ["language"])
    again = evaluate.frozen(found.repartition(3), files, ["language"])
    assert evaluate.unequal(rows, again).count() == 0 and rows.select("id").distinct().count() == 2
    good = rows.select("id", "input_sha256", "diagnostic_sha256", F.lit("tp").alias("label"))
    assert evaluate.label_problems(rows, good).count() == 0
    bad = good.limit(1).withColumn("label", F.lit("yes")).unionByName(good.limit(1).withColumn("id", F.lit("z")))
    assert sorted(r.problem for r in evaluate.label_problems(rows, bad).collect()) == ["no diagnostic", "no label", "unknown label"]


def test_scores_and_comparisons(spark):
    rows = spark.createDataFrame([("a", "en", "tp"), ("a", "en", "fp"), ("b", "ja", "tp")], "batch string, language string, label string")
    got = {(r.grouping, r.value): (r.n, r.precision, r.dominates) for r in evaluate.scores(rows, [["batch"], ["batch", "language"]]).collect()}
    assert got[("batch", "a")] == (2, 0.5, True) and got[("batch/language", "b/ja")] == (1, 1.0, False)
    gold, old, new = ([(1, "x"), (2, "y"), (3, "z")], [(1, "x"), (2, "q")], [(2, "y"), (3, "z")])
    frames = [spark.createDataFrame(v, "k int, role string") for v in (old, new, gold)]
    assert tuple(evaluate.before_after(*frames, ["k"], "role").first()) == (3, 1, 2, 2, 1)
    assert [r.k for r in evaluate.disjoint(frames[0], frames[1], "k").collect()] == [2]
    runs = spark.createDataFrame([("cold", 1.0, "h"), ("cold", 3.0, "h"), ("cold", 2.0, "h"), ("warm", 1.0, "h"), ("warm", 1.0, "i")], "mode string, seconds double, output_sha256 string")
    assert {r["mode"]: (r.median, r.same_output) for r in evaluate.latencies(runs, "mode").collect()} == {"cold": (2.0, True), "warm": (1.0, False)}
    changes = spark.createDataFrame([(i, "added", None, "v|w") for i in range(90)], "k int, change string, old string, new string")
    lines = [r.line for r in evaluate.diff_markdown(changes, ["k"]).collect()]
    assert len(lines) == 81 and lines[0] == "| 0 | added |  | v\\|w |" and lines[-1] == "... and 10 more"


def test_link_oracle(spark):
    asked = spark.createDataFrame([("d/a.md", x) for x in ("b.md", "../e/", "/d/a.md#x", "gone.md", "https://x.org", "..")], "source string, destination string")
    entries = spark.createDataFrame([("d/a.md",), ("d/b.md",), ("e/f.md",)], "path string")
    got = {r.destination: r.exists for r in evaluate.link_oracle(asked, entries).collect()}
    assert got == {"b.md": True, "../e/": True, "/d/a.md#x": True, "gone.md": False, "..": True}


def test_ignored_and_skipped(spark, tmp_path):
    for name, data in {"a.md": "x", ".gitignore": "*.tmp.md\nbuild/\n!build/keep.md\n/only.md\n", "x.tmp.md": "x", "build/b.md": "x", "sub/only.md": "x", "only.md": "x", "sub/.gitignore": "!x.tmp.md\nno.md", "sub/x.tmp.md": "x", "sub/no.md": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    files = workspace.scan(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["a.md", "sub/only.md", "sub/x.tmp.md"]
    assert workspace.inventory(spark, str(tmp_path)).where("kind = 'directory'").count() == 2
    known = spark.createDataFrame([("a.md", True, False), ("old/b.md", True, True), ("c.md", False, False)], "filename string, included boolean, excluded boolean")
    asked = spark.createDataFrame([(p,) for p in ("a.md", "old", "c.md", "d.txt", "x.tmp.md", "none", "e.md")], "path string")
    got = {r.path: r.reason for r in workspace.skipped(asked, known.where("filename = 'a.md'"), known, workspace.ignore_patterns("", "*.tmp.md")).collect()}
    assert got == {
        "old": "configuration excludes its 1 Markdown files", "c.md": "include does not match it", "d.txt": "it is not a .md or .markdown file",
        "x.tmp.md": ".gitignore ignores it", "none": "it contains no Markdown files", "e.md": "it was not found",
    }
    old, new = (spark.createDataFrame(v, "path string, blob string") for v in ([("a.md", "1"), ("b.md", "1"), ("c.txt", "1")], [("a.md", "2"), ("d.md", "1"), ("c.txt", "2")]))
    assert {r.path: r.status for r in workspace.changes(old, new).collect()} == {"a.md": "M", "b.md": "D", "d.md": "A"}


def test_scope_and_names(spark):
    kind = "doc string, related array<struct<filename:string>>"
    found = spark.createDataFrame([("d/a.md", []), ("e/b.md", [("d/x.md",)]), ("dd/c.md", None)], kind)
    assert sorted(r.doc for r in scope.visible(found, ["d/"]).collect()) == ["d/a.md", "e/b.md"] and scope.visible(found, ["."]).count() == 3
    row = spark.range(1).select(T.git_blob(F.lit("hé\n")).alias("b"), report.artifact_uri(F.lit("C:\\a b\\é~*.md")).alias("u"), report.artifact_uri(F.lit("a/b c+d.md")).alias("v")).first()
    raw = "hé\n".encode()
    assert row.b == hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
    assert row.u == "file:///C:/a%20b/%C3%A9~%2A.md" and row.v == "a/b%20c%2Bd.md"


def test_text_spans(spark):
    texts = [("ab\r\ncd\r\nef",), ("a\rb\n\n",), ("",)]
    rows = spark.createDataFrame(texts, "t string").select("t", T.line_spans(F.col("t")).alias("x")).collect()
    assert [[(y.content, y.end) for y in r.x] for r in rows] == [[("ab", 2), ("cd", 2), ("ef", None)], [("a", 1), ("b", 1), ("", 1), ("", None)], [("", None)]]
    urls = ["https://github.com/a/b", "https://GitHub.com/a/b/", "https://github.com/settings/profile", "https://www.github.com/a/b", "https://github.com/a/b?x=1", "https://github.com/a/b/c", "http://codeberg.org/x/y#r"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.repository_root(F.col("u"))).collect()]
    assert got == [True, True, False, False, False, False, False]
    hit = spark.createDataFrame([("🦀 of the x",), ("then",)], "t string").select(T.marker(F.col("t"), ["of the", "the"]).alias("m")).collect()
    assert tuple(hit[0].m) == (2, 8) and hit[1].m is None
