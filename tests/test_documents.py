import pytest
from pyspark.sql import functions as F

from marginalia.operators import edits as edits_of
from marginalia.operators import links, policy, report
from marginalia.plans import config, scope
from marginalia.rules import structure
from marginalia.sources import markdown, workspace

GUIDE = """---
kind: howto
canonical: true
---
# Set up

Read [the notes](notes.md#top "n") and `app_config.port`. See [ref].

## Steps

1. [x] Install it.
2. Run it.

> # Quoted
> text

| key | about |
|-----|-------|
| host | where |

```sh
run it
```
<!-- allow STL001 -- old page -->

Last
====

[ref]: ../other/x.md
"""


def test_shredding(spark):
    d = markdown.shred(spark.createDataFrame([(1, GUIDE), (2, None), (3, "")], "doc_id long, text string"))
    raw = GUIDE.encode()
    row = {r.doc: r for r in d.collect()}
    assert (row[1].front.kind, row[1].front.canonical, row[2].front) == ("howto", True, None)
    assert [(s.heading, s.parent, s.depth) for s in row[1].sections] == [(None, None, 0), ("Set up", 0, 1), ("Steps", 1, 2), ("Quoted", 2, 1), ("Last", 0, 1)]
    assert [x.destination for x in row[1].links] == ["notes.md#top", "../other/x.md"]
    assert all(raw[x.start : x.stop].startswith(b"[") for x in row[1].links)
    assert [x.text for x in row[1].identifiers] == ["app_config.port"]
    assert [x.content for x in row[1].comments] == [" allow STL001 -- old page "]
    kinds = [b.kind for b in row[1].blocks]
    assert kinds.count("item") == 2 and "table" in kinds and "quote" in kinds and "code" in kinds
    assert [b.checked for b in row[1].blocks if b.kind == "item"] == [True, None]
    assert len(row[2].sections) == len(row[3].sections) == 1
    # Integrity: parents come first and every span is inside its text.
    blocks = markdown.table(d, "blocks")
    assert blocks.where("parent >= idx or start > stop or section < 0").count() == 0


def test_links_and_anchors(spark):
    files = spark.createDataFrame([("docs/a.md",), ("docs/B.md",)], "filename string")
    rows = [("docs/a.md", "b.md#x"), ("docs/a.md", "#top"), ("docs/a.md", "../docs/a.md"), ("docs/a.md", "none.md"), ("docs/a.md", "https://x.y/"), ("docs/a.md", "../../up.md"), ("docs/a.md", "%ZZ")]
    got = {r.destination: (r.target, r.status) for r in links.resolve(spark.createDataFrame(rows, "source string, destination string"), files).collect()}
    assert got["b.md#x"] == ("docs/B.md", "case_mismatch")
    assert got["#top"] == ("docs/a.md", "found") and got["../docs/a.md"] == ("docs/a.md", "found")
    assert [got[k][1] for k in ("none.md", "https://x.y/", "../../up.md", "%ZZ")] == ["missing", "external", "outside", "invalid"]
    found = links.resolve(spark.createDataFrame(rows[1:2], "source string, destination string"), files)
    known = spark.createDataFrame([("docs/a.md", "other")], "filename string, anchor string")
    assert links.missing_anchors(found, known).count() == 1


def test_first_candidate(spark):
    c = spark.createDataFrame([(1, 0, "d"), (1, 1, "d/index.md"), (2, 0, "d"), (3, 0, "x")], "link long, rank int, path string")
    inv = spark.createDataFrame([("d", "directory"), ("d/index.md", "file")], "path string, kind string")
    assert {r.link: (r.path, r.status) for r in links.first_candidate(c, inv).collect()} == {1: ("d/index.md", "found"), 2: ("d", "directory"), 3: ("x", "missing")}


def test_suppression(spark):
    points = spark.createDataFrame([("f", "A", 5, 1), ("f", "A", 50, 2), ("f", "B", 5, 3)], "doc string, code string, at long, id long")
    records = spark.createDataFrame([("f", "A", 0, 100, 1, 10), ("f", "A", 0, 20, 0, 11), ("f", "A", 4, 9, 0, 12)], "doc string, code string, start long, stop long, scope int, record long")
    won = policy.suppression_winner(points, records)
    assert {r.id: r.record for r in won.collect()} == {1: 12, 2: 10}
    states = policy.record_states(
        spark.createDataFrame([(10, "f", "A", True), (12, "f", "A", True), (11, "f", "A", True), (13, "f", "B", False), (14, "f", "C", True)], "record long, doc string, code string, valid boolean"),
        won, spark.createDataFrame([("f", "A")], "doc string, code string"), spark.createDataFrame([], "doc string, code string"),
    )
    assert {r.record: r.state for r in states.collect()} == {10: "active", 12: "active", 11: "stale", 13: "invalid", 14: "rule_disabled"}
    c = spark.createDataFrame([("allow STL001, KND001 -- why",), ("allow-file STL001",), ("allow stl -- x",), ("hello",)], "comment string")
    assert [(r.scope, r.codes, r.error) for r in policy.directives(c).collect()] == [
        ("allow", ["STL001", "KND001"], None), ("allow-file", ["STL001"], "missing reason"), ("allow", ["stl"], "malformed code"),
    ]


def test_kinds_and_edits(spark):
    d = markdown.shred(spark.createDataFrame([(1, GUIDE), (2, "x"), (3, "---\nkind: generated\n---\n")], "doc_id long, text string"))
    assert {(r.doc, r.code) for r in structure.kinds(d, spark.createDataFrame([], "doc long, kind string")).collect()} == {(2, "KND001"), (3, "KND002")}
    docs = spark.createDataFrame([(1, "aé🦀z"), (2, "abc"), (3, "abc")], "doc long, text string")
    edits = spark.createDataFrame([(1, 1, 3, "e"), (1, 7, 8, "!"), (2, 0, 2, "x"), (2, 1, 3, "y")], "doc long, start int, stop int, replacement string")
    assert {r.doc: r.fixed for r in edits_of.apply_edits(docs, edits).collect()} == {1: "ae🦀!", 2: "abc", 3: "abc"}


def test_reports(spark):
    d = spark.createDataFrame([("b", 1, 2, 1, 5, "X1", "a\nb", ["z", "y"]), ("a:c", 3, 1, 4, 1, "X0", "50%", [])], "filename string, row long, col long, end_row long, end_col long, code string, message string, related array<string>")
    assert [r.line for r in report.concise(d).collect()] == ["a:c:3:1: X0 50%", "b:1:2: X1 a\\nb [y, z]"]
    assert report.github(d).first().line == "::error file=a%3Ac,line=3,endLine=4,title=X0::50%25"
    assert {r.code: r.rule_index for r in report.rule_index(d).collect()} == {"X0": 0, "X1": 1}
    none = d.limit(0)
    assert [report.exit_code(x, e).first()[0] for x, e in ((none, none), (d, none), (none, d))] == [0, 1, 2]


def test_workspace(spark, tmp_path):
    for name, data in {"a.md": b"# A", "docs/b.MD": b"x", "docs/c.txt": b"x", "docsx/d.md": b"\xff", ".git/e.md": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = workspace.scan(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["a.md", "docs/b.MD", "docsx/d.md"]
    assert [r.filename for r in workspace.requested(files, ["docs"]).collect()] == ["docs/b.MD"]
    texts, errors = workspace.decoded(files)
    assert texts.count() == 2 and [r.filename for r in errors.collect()] == ["docsx/d.md"]
    over = workspace.overlaid(texts, spark.createDataFrame([("a.md", "new"), ("z.md", "z")], "filename string, text string"))
    assert {r.filename: r.text for r in over.collect()} == {"a.md": "new", "docs/b.MD": "x", "z.md": "z"}
    twice = workspace.by_content(spark.createDataFrame([(1, "x"), (2, "x")], "id long, text string"), lambda t: t.select("content", F.length("text").alias("n")))
    assert [r.n for r in twice.collect()] == [1, 1]


def test_plans():
    configs = {"x/a.toml": {"extend": "../b.toml", "preview": True, "lint": {"extend-select": ["STL"], "select": ["LNK"]}}, "b.toml": {"exclude": ["v/**"], "lint": {"extend-select": ["KND"], "languages": ["en"]}}}
    got = config.settled(config.inherited(configs, "x/a.toml"))
    # A child's select leaves what its parent extends.
    assert got["lint"]["select"] == ["LNK", "KND", "STL"] and got["exclude"] == ["v/**"] and got["lint"]["languages"] == ["en"]
    assert scope.plan({"LNK001"}, ["a"]).read_paths == () and scope.plan({"KND001"}, ["a"]).read_paths == ("a",)


@pytest.mark.parametrize("raw", [
    {"x": 1}, {"lint": {"select": ["XYZ"]}}, {"lint": {"languages": ["fr"]}}, {"kinds": [{"path": "a", "kind": "tutorial"}]}, {"sites": [{"path": "a", "root": "/d"}]},
    {"sites": [{"path": "a", "root": "../d"}]}, {"lint": {"dup": {"min-jaccard": 2}}}, {"lint": {"lexicon": {"en": {"extend-stale-markers": [" "]}}}}, {"lint": {"extend-select": "ALL"}}, {"include": [""]},
])
def test_wrong_settings(raw):
    with pytest.raises(config.ConfigError):
        config.settled(raw)


def test_discovery():
    texts = {"marginalia.toml": "preview = true", "a/.marginalia.toml": "extend = '../marginalia.toml'\n[lint]\nselect = ['LNK']", "a/marginalia.toml": "x = 1", "b/pyproject.toml": "[tool.other]"}
    got = config.discover(texts)
    assert sorted(got) == ["", "a"] and got["a"]["preview"] and got["a"]["lint"]["select"] == ["LNK"]
    with pytest.raises(config.ConfigError, match="cycle"):
        config.discover({"marginalia.toml": "extend = 'marginalia.toml'"})
    assert config.suggested(["README.md", "docs/adr/1.md", "mkdocs.yml", "vendor/x.md"])["sites"] == [{"path": "docs/**", "root": "docs"}]


def test_globs():
    import re

    match = lambda g, p: bool(re.search(policy.glob_pattern(g), p))
    assert match("docs/**/*.md", "docs/a.md") and match("docs/**/*.md", "docs/x/y/a.md") and not match("docs/*.md", "docs/x/a.md")
    assert match("*.{md,txt}", "a.txt") and not match("a?c", "a/c")


def test_stream(spark, tmp_path):
    from marginalia.streaming import incremental

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "x", 1)], "filename string, text string, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("filename string, text string, version long").parquet(str(tmp_path / "in"))
    q = incremental.upsert_stream(source, str(tmp_path / "state"), str(tmp_path / "ck"), lambda docs, changed: seen.append({r.filename: r.text for r in docs.collect()}))
    q.awaitTermination()
    assert seen[-1] == {"a": "2", "b": "x"}
    told = spark.createDataFrame([('{"tool_input": {"file_path": "a.md", "content": "x"}}',), ('{"file_path": "b.md"}',), ("{",)], "value string")
    assert [tuple(r) for r in incremental.events(told).collect()] == [("a.md", "x"), ("b.md", None)]
