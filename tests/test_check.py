"""The whole check on small workspaces: each rule once on a text that breaks it and once on one that does not."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import edits, report
from marginalia.plans import check, config

LONG = "This paragraph explains how the service handles a request from its first byte to the last one, and names each step in the order in which it happens."
KEYS = "\n".join(f"- `{k}`: Says what the {k} is." for k in ("host", "port", "user", "token", "timeout", "retries"))
TABLE = "| a | b |\n| - | - |\n" + "\n".join(f"| row{i} | text |" for i in range(10))
ARGUMENT = "We chose this store because the team had to weigh several models of persistence against what each of them costs to operate for years."
EXAMPLES = {
    "STL001": ("The service currently uses `v1.2.3`.", "The service needs version `1.2.3` or later, currently."),
    "STL002": ("The service is deployed to production.", "If it is deployed to production, stop."),
    "STL003": ("It was fixed in build `a1b2c3d`.", "It was fixed in commitdeadbee1."),
    "STL004": ("The package version is `2.4.1`.", "The package version is `2.4.1`, introduced in spring."),
    "PTR001": ("See the [sources](/) and [code](https://github.com/an/owner).", "See [code](https://github.com/settings/profile) and [x](https://www.github.com/a/b)."),
    "PTR003": ("For loading, see the source.", "For loading, see the source in `src/config.rs`."),
    "RAT002": ("## Why we chose Redis", "## Connect, and why we chose Redis"),
    "VOX001": ("The user confirmed it does not crash.", "Verify that the user has authorized the app."),
    "VOX002": ("## What is not included", "What is not included stays out."),
    "VOX003": ("I have implemented the panel.", 'They said "I have implemented the panel" twice.'),
    "EVD001": ("This form is faster.", "This form is faster.\n\nIt took 12 ms."),
    "RAT001": (f"{ARGUMENT}\n\n{ARGUMENT}\n\n1. Run `db start`.", f"1. Run `db start`.\n\n{ARGUMENT}\n\n{ARGUMENT}"),
    "ORD001": (f"{TABLE}\n\n1. Run `app start`.", f"1. Run `app start`.\n\n{TABLE}"),
    "ORD002": ("## Troubleshooting\n\nIt may fail.\n\n## Steps\n\n1. Run it.", "## Steps\n\n1. Run it.\n\n## Troubleshooting\n\nIt may fail."),
    "MIX001": (f"# Page\n\n## Design decisions\n\n{ARGUMENT}\n\nMore of it.", f"# Page\n\n## Design decisions\n\n{ARGUMENT}"),
    "LNK001": ("See [a](gone.md).", "See [a](index.md) and [b](https://x.org/gone.md) and [c](#top)."),
    "LNK002": ("See [a](index.md#nowhere).", "See [a](index.md#title-1), [b](index.md#named) and [c](index.md#own)."),
    "PTR002": ("See [a](../sub/).", "See [a](../sub/x.md)."),
    "KND002": (None, "Text."),
}
INDEX = '# Title\n\n# Title\n\n# Third {#own}\n\n<a id="named"></a>\n'
NUM = {"MIX001": "howto"}


@pytest.fixture(scope="module")
def checked(spark):
    rows = [("docs/index.md", "---\nkind: reference\n---\n" + INDEX), ("sub/x.md", "---\nkind: plan\n---\nx"), ("docs/none.md", "No kind."), ("docs/odd.md", "---\nkind: tutorial\n---\n"), ("docs/open.md", "---\nkind: [\n---\n")]
    for code, (bad, good) in EXAMPLES.items():
        rows += [(f"docs/{code}-{n}.md", f"---\nkind: howto\n---\n{t}\n") for n, t in (("bad", bad), ("good", good)) if t]
    rows += [("docs/undecided.md", "---\nkind: howto\n---\nThe files are deployed.\n\nSee [a]({{x}}).\n"), ("gen/a.md", "See [a](gone.md).")]
    files = spark.createDataFrame(rows, "filename string, text string").repartition(4)
    settings = config.settled({"preview": True, "kinds": [{"path": "gen/**", "kind": "generated"}], "lint": {"ignore": ["DUP", "OWN"]}})
    return files, check.check(files, {"": settings})


def test_examples(checked):
    files, result = checked
    got = {(r.doc, r.code) for r in result.diagnostics.collect()}
    for code, (bad, _) in EXAMPLES.items():
        if bad:
            assert (f"docs/{code}-bad.md", code) in got, code
        assert (f"docs/{code}-good.md", code) not in got, code
    assert {d for d, c in got if c == "KND001"} == {"docs/none.md", "docs/open.md"} and {d for d, c in got if c == "KND002"} == {"docs/odd.md"}
    assert not any(d.startswith("gen/") for d, _ in got)


def test_spans_and_what_stays_open(checked):
    files, result = checked
    texts = {r.filename: r.text.encode() for r in files.collect()}
    said = {(r.doc, r.code): texts[r.doc][r.start : r.stop].decode() for r in result.diagnostics.where("doc like '%-bad.md'").collect()}
    want = {"STL001": "`v1.2.3`", "STL003": "`a1b2c3d`", "STL004": "`2.4.1`", "VOX001": "The user confirmed", "RAT002": "Why we chose", "EVD001": "is faster", "LNK001": "[a](gone.md)", "ORD002": "## Troubleshooting"}
    for code, text in want.items():
        assert said[(f"docs/{code}-bad.md", code)].strip("`") == text.strip("`"), code
    left = {(r.doc, r.code) for r in result.incomplete.collect()}
    assert {("docs/undecided.md", "STL002"), ("docs/undecided.md", "LNK001"), ("docs/index.md", "ORD001") } - left <= {("docs/index.md", "ORD001")}
    located = report.located(result.diagnostics.where("doc = 'docs/STL001-bad.md'"), result.shredded, files.withColumnRenamed("filename", "doc")).first()
    assert (located.row, located.col, located.end_row) == (4, 29, 4) or (located.row, located.col) == (4, 28)


def test_outputs(checked):
    files, result = checked
    placed = report.located(result.diagnostics, result.shredded, files.withColumnRenamed("filename", "doc"))
    placed = placed.withColumn("message", F.coalesce("message", F.lit("m"))).withColumn("related", F.transform(F.coalesce("related", F.array().cast("array<struct<filename:string,start:bigint,stop:bigint>>")), lambda r: r["filename"]))
    n = placed.count()
    blocks = [r.block for r in report.text(placed, files).collect()]
    assert len(blocks) == n and any("v1.2.3" in b and " | The service" in b for b in blocks)
    assert report.footer(placed).first().line == f"Found {n} diagnostics."
    assert report.sarif_results(placed).where("json like '%byteOffset%'").count() == n
    assert report.policy_report(result.policies, result.enabled).count() == files.count()
    assert report.index_dump(result.shredded, result.policies, result.links).where("json like '%title-1%'").count() == 2
    assert report.parse_report(result.shredded).where("language = 'en'").count() == files.count()
    assert report.statistics(placed).agg(F.sum("n")).first()[0] == n


def test_shared_content(spark):
    own = "---\nkind: reference\n---\n# Settings\n\n"
    rows = [
        ("a/ref.md", own + KEYS + f"\n\n{LONG}\n"), ("a/guide.md", "---\nkind: howto\n---\n# Guide\n\n" + KEYS + f"\n\n{LONG}\n"),
        ("a/plan.md", "---\nkind: plan\n---\n# Plan\n\n" + KEYS + "\n"), ("a/peer.md", own + f"{LONG}\n"),
        ("a/again.md", "---\nkind: howto\n---\n# Again\n\nIt has `host`, `port`, `user`, `token` and `timeout`: see [all](ref.md)."),
        ("b/ref.md", own + KEYS + f"\n\n{LONG}\n"),
    ]
    files = spark.createDataFrame(rows, "filename string, text string")
    settings = config.settled({"preview": True, "domains": [{"path": "b/**", "name": "b"}], "lint": {"select": ["DUP", "OWN"]}})
    got = {}
    for r in check.check(files, {"": settings}).diagnostics.collect():
        got.setdefault((r.doc, r.code), set()).update(x.filename for x in r.related)
    assert got[("a/guide.md", "DUP001")] == {"a/ref.md"} and got[("a/guide.md", "DUP003")] == {"a/ref.md", "a/peer.md"}
    assert got[("a/plan.md", "OWN001")] == {"a/ref.md", "a/guide.md"} and got[("a/again.md", "DUP002")] == {"a/ref.md"}
    assert got[("a/ref.md", "OWN002")] == {"a/peer.md"} and got[("a/peer.md", "OWN002")] == {"a/ref.md"}
    assert not any(d == "b/ref.md" or "b/ref.md" in x for (d, _), x in got.items())


def test_suppressions_and_their_fixes(spark):
    texts = {
        "a.md": "<!-- marginalia: allow-file LNK001 -- known -->\n\nSee [a](x.md).\n",
        "b.md": "<!-- marginalia: allow LNK001 -- known -->\nSee [a](x.md).\n\nSee [b](y.md).\n",
        "c.md": "One <!-- marginalia: allow LNK001, KND001 -- known --> [a](x.md).\n",
        "d.md": "Text.\n\n<!-- marginalia: allow LNK001, KND001 -- unused -->\nMore.\n",
        "e.md": "<!-- marginalia: allow-file SUP002 -- meta -->\n<!-- marginalia: allow LNK001 -- unused -->\nText.\n",
        "f.md": "<!-- marginalia: allow LNK9 -- odd -->\nText.\n\n<!-- marginalia: deny LNK001 -- odd -->\nText.\n\n<!-- marginalia: allow LNK001 -->\nText\n",
        "g.md": "<!-- marginalia: allow-file SUP002 -- meta -->\nText.\n",
    }
    files = spark.createDataFrame(list(texts.items()), "filename string, text string")
    settings = config.settled({"kinds": [{"path": "**", "kind": "readme"}]})
    result = check.check(files, {"": settings})
    got = sorted((r.doc, r.code, texts[r.doc].encode()[r.start : r.stop].decode()[:14]) for r in result.diagnostics.collect())
    assert [x for x in got if x[1] == "LNK001"] == [("b.md", "LNK001", "[b](y.md)")]
    assert [d for d, c, _ in got if c == "SUP001"] == ["f.md"] * 3
    assert [d for d, c, _ in got if c == "SUP002"] == ["c.md", "d.md", "d.md", "g.md"]
    states = {(r.doc, r.code): (r.state, r.hits) for r in result.suppressions.states.collect()}
    assert states[("a.md", "LNK001")] == ("active", 1) and states[("e.md", "SUP002")] == ("active", 1) and states[("e.md", "LNK001")] == ("stale", 0)
    assert states[("c.md", "KND001")] == ("stale", 0) and states[("f.md", "LNK001")][0] == "invalid"
    docs = files.withColumnRenamed("filename", "doc")
    fixed = {r.doc: r.fixed for r in edits.apply_edits(docs, result.edits).collect()}
    assert fixed["c.md"] == "One <!-- marginalia: allow LNK001 -- known --> [a](x.md).\n" and fixed["d.md"] == "Text.\n\n\nMore.\n" and fixed["g.md"] == "Text.\n" and fixed["a.md"] == texts["a.md"]


def test_site_routes(spark):
    rows = [
        ("docs/index.md", "[a](/guide/setup) [b](/guide/Missing) [c](sub/) [d](setup.html) [e](/guide/logo.png) [f](/other/x) [g](guide) [h](setup.md)"),
        ("docs/setup.md", "# Setup"), ("docs/sub/README.md", "x"), ("docs/Guide.md", "x"),
    ]
    files = spark.createDataFrame(rows, "filename string, text string")
    inventory = spark.createDataFrame([("docs/public/logo.png", "file")], "path string, kind string")
    settings = config.settled({"sites": [{"path": "docs/**", "root": "docs", "public": "docs/public", "base": "/guide/"}], "lint": {"select": ["LNK001"]}})
    result = check.check(files, {"": settings}, inventory)
    status = {r.destination: (r.status, r.target) for r in result.links.collect()}
    assert status == {
        "/guide/setup": ("file", "docs/setup.md"), "/guide/Missing": ("missing", "guide/Missing"), "sub/": ("directory", "docs/sub"), "setup.html": ("file", "docs/setup.md"),
        "/guide/logo.png": ("file", "docs/public/logo.png"), "/other/x": ("missing", "other/x"), "guide": ("file", "docs/Guide.md"), "setup.md": ("file", "docs/setup.md"),
    }
    assert result.diagnostics.count() == 2
