"""Registered queries of the document engine, and the same in SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lexicons as L
from .functions import text as T
from .operators import alike, evaluate, links, policy, report, similarity
from .plans import check, config
from .rules import lexical
from .sources import markdown


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a few files or row groups to all cores; a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Text ---------------------------------------------------------------------


def sentence_split(spark, d):
    docs = _table(spark, d, "documents")
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "sentence")


def line_table(spark, d):
    """Byte spans of lines; an end of CR, LF or CRLF belongs to its line."""
    docs = _table(spark, d, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = docs.select("doc_id", "row", F.posexplode(T.line_spans(F.col("text"))).alias("line", "x"))
    before = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = F.sum(F.octet_length("x.content") + F.coalesce("x.end", F.lit(0))).over(before)
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.coalesce(at, F.lit(0)).cast("long").alias("start_byte"), F.octet_length("x.content").cast("long").alias("n_bytes"))


def detect_language(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    talk = _table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit("conversations").alias("origin"))
    return docs.unionByName(talk).select("origin", "id", T.language(F.col("text")).alias("language"))


def shingle_stats(spark, d):
    docs = _table(spark, d, "documents")
    per = docs.select("lang", F.size(T.shingles(T.folded(F.col("text")), 5)).alias("n"), T.alphanumerics(F.col("text")).alias("alnum"))
    return per.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_shingles"), F.max("n").cast("long").alias("most"), F.count_if(F.col("alnum") >= 80).alias("n_units"))


def _document_units(spark, d):
    """Units of documents with 80 letters and digits: texts in the form whose shingles count, by language."""
    docs = _spread(_table(spark, d, "documents").select("doc_id", "lang", "text"))
    return docs.where(T.alphanumerics(F.col("text")) >= 80).select(F.col("doc_id").alias("unit"), "lang", T.folded(F.col("text")).alias("text"))


def _document_pairs(spark, d):
    """Pairs of near copies among the heads of equal sets of five-character shingles, eight at least, and the members of all heads."""
    return alike.joined(_document_units(spark, d), 5, 8, 9, 10)


def near_duplicate_documents(spark, d):
    return _document_pairs(spark, d)[0]


def _ranks(spark, d):
    labels = _table(spark, d, "labels").select(F.col("doc_id").alias("unit"), (F.col("quality") * 2 - F.col("toxic")).alias("rank"))
    return _table(spark, d, "documents").select(F.col("doc_id").alias("unit")).join(labels, "unit", "left").fillna(0, ["rank"])


def near_duplicate_owner(spark, d):
    owned = similarity.owners(near_duplicate_documents(spark, d), _ranks(spark, d))
    return owned.where("higher is not null").select("unit", F.col("higher").alias("owner"))


def ambiguous_owner(spark, d):
    owned = similarity.owners(near_duplicate_documents(spark, d), _ranks(spark, d))
    return owned.where("higher is null and tied is not null").select("unit", "tied")


def threshold_sweep(spark, d):
    return evaluate.sweep(near_duplicate_documents(spark, d), [0.9, 0.95, 0.99])


# The queries above work on the smallest document of each class of equal shingle
# sets, as their SQL does; those below on all of its members.


def near_duplicate_members(spark, d):
    """Every unit and the head that stands for it in ``near_duplicate_documents``."""
    return alike.members(_document_units(spark, d), 5, 8)


def _member_owners(spark, d):
    pairs, members = _document_pairs(spark, d)
    return similarity.class_owners(pairs, members, _ranks(spark, d))


def near_duplicate_member_owner(spark, d):
    return _member_owners(spark, d).where("higher is not null").select("unit", F.col("higher").alias("owner"))


def ambiguous_member_owner(spark, d):
    return _member_owners(spark, d).where("higher is null and tied is not null").select("unit", "tied")


def member_threshold_sweep(spark, d):
    """Pairs of members at each threshold; those of one class are alike in full."""
    pairs, members = _document_pairs(spark, d)
    sizes = members.groupBy("head").agg(F.count_distinct("unit").alias("size"))
    across = pairs.join(sizes.select(F.col("head").alias("a"), F.col("size").alias("m")), "a").join(sizes.select(F.col("head").alias("b"), F.col("size").alias("n")), "b")
    across = across.select("shared", "total", (F.col("m") * F.col("n")).alias("weight"))
    within = sizes.select(F.lit(1).cast("long").alias("shared"), F.lit(1).cast("long").alias("total"), F.expr("size * (size - 1) div 2").alias("weight"))
    return evaluate.sweep(across.unionByName(within), [0.9, 0.95, 0.99], "weight")


def exact_duplicates(spark, d):
    docs = _table(spark, d, "documents")
    rows = docs.groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return rows.where("copies > 1")


def containment_overlap(spark, d):
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)))
    items = _table(spark, d, "benchmark").select(F.col("item_id").alias("item"), words("text").alias("tokens"))
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("unit"), words("text").alias("tokens"))
    return similarity.containment(items, docs, 0.8)


# Lexical rules ------------------------------------------------------------


def marker_positions(spark, d):
    docs = _table(spark, d, "documents")
    hit = T.marker(F.col("text"), ["the", "of the"])
    return docs.select("doc_id", hit["start"].cast("long").alias("start"), hit["end"].cast("long").alias("stop")).where("start is not null")


def conditional_sentences(spark, d):
    rows = sentence_split(spark, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.conditional(F.col("sentence"))).alias("n_hits"))


# Words of the tables' invented prose, added to lexicons that would not occur there.
_MORE = {"stale": {"en": ["the"]}, "constraint": {"en": ["for the"]}, "rationale": {"en": ["the", "and of", "a"]}}


def _plain_sentences(spark, d):
    """Sentences of plain texts as the rules take them: one run of one piece; doc is (id, place) in one number."""
    rows = sentence_split(spark, d)
    piece = F.struct(F.lit(0).alias("at"), F.col("sentence").alias("text"), F.lit(0).alias("start"), F.octet_length("sentence").alias("stop"))
    runs = F.array(F.struct(F.col("sentence").alias("text"), F.col("sentence").alias("asserted"), F.array(piece).alias("pieces")))
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("idx")).alias("doc"), "doc_id", "idx", F.lit("en").alias("language"), (F.col("idx") == 0).alias("heading"),
        F.lit(False).alias("quoted"), F.lit(False).alias("example"), runs.alias("runs"), runs.alias("coded"),
    )


def stale_value_sentences(spark, d):
    """STL001 with a word of the texts as a marker: the first value of each such sentence."""
    found = lexical.stale_values(_plain_sentences(spark, d), _MORE)
    return found.groupBy(F.floor(F.col("doc") / 100000).alias("doc_id")).agg(F.count("*").alias("n"), F.min("start").alias("least"))


def rationale_heads(spark, d):
    """RAT002 with words of the texts, first sentences as headings."""
    found = lexical.rationale_headings(_plain_sentences(spark, d), _MORE)
    return found.select(F.floor(F.col("doc") / 100000).alias("doc_id"), "start", "stop")


def evaluative_claims(spark, d):
    """Sentences that evaluate (or say "that"), neither conditional nor with a measurement."""
    hit = T.contains_any(F.col("sentence"), [*L.EVALUATION["en"], "that"]) & ~T.conditional(F.col("sentence")) & ~F.col("sentence").rlike(L.MEASUREMENT)
    return sentence_split(spark, d).where(hit).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def narration_hits(spark, d):
    """Turns of conversations with a first-person account (or "of the"), by role."""
    talk = _table(spark, d, "conversations")
    return talk.groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.contains_any(F.col("text"), [*L.NARRATION["en"], "of the"])).alias("n_hits"))


def version_mentions(spark, d):
    """Versions in texts made of parts: those that stand alone, by value."""
    tail = F.when(F.col("p_partkey") % 3 == 0, F.lit(".4-rc.1")).otherwise("")
    text = F.concat("p_name", F.lit(" v"), "p_size", F.lit("."), F.col("p_partkey") % 10, tail, F.lit(" and not 10.5x or 7"))
    found = F.regexp_extract_all(text, F.lit(L.VERSION), F.lit(0))
    return _table(spark, d, "part").select("p_partkey", F.explode(found).alias("value")).groupBy("value").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


def number_mentions(spark, d):
    docs = _table(spark, d, "documents")
    found = F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)+"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("value")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("value").alias("least"))


# Pages --------------------------------------------------------------------


def html_links(spark, d):
    return links.html_links(_table(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def html_comments(spark, d):
    return links.html_comments(_table(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "comment")


def html_title_slug(spark, d):
    head = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    return _table(spark, d, "pages").select("page_id", T.slug(head).alias("slug"))


def html_anchor_ids(spark, d):
    return links.anchors(_table(spark, d, "pages"))


def missing_anchor(spark, d):
    """Links from each page to its own title on the next page: those whose anchor is not there."""
    pages = _table(spark, d, "pages")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"), F.lit(".md"))
    slug = T.slug(F.trim(F.regexp_extract("html", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)))
    known = links.anchors(pages).select(name(F.col("page_id")).alias("filename"), "anchor")
    asked = pages.select("page_id", name(F.col("page_id")).alias("source"), F.concat(name(F.col("page_id") + 1), F.lit("#"), F.regexp_replace(slug, "%", "%25")).alias("destination"))
    found = links.resolve(asked, pages.select(name(F.col("page_id")).alias("filename")))
    return links.missing_anchors(found, known).select("page_id", "anchor")


def link_target_missing(spark, d):
    """Links whose path is no page's path."""
    pages = _table(spark, d, "pages")
    known = pages.select(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("filename")).distinct()
    asked = html_links(spark, d).select("page_id", F.lit("").alias("source"), F.col("href").alias("destination"))
    return links.resolve(asked, known).where("status = 'missing'").groupBy("page_id").agg(F.count("*").alias("n_missing"))


def url_parts_root_pointer(spark, d):
    """Pages' paths on hosts of code: which would be a repository's root."""
    pages = _table(spark, d, "pages")
    host = F.element_at(F.array(*map(F.lit, ("github.com", "www.github.com", "GitLab.com", "codeberg.org", "bitbucket.org"))), (F.col("page_id") % 5 + 1).cast("int"))
    owner = F.when(F.col("page_id") % 7 == 0, "explore").otherwise(F.lit("owner"))
    tail = F.when(F.col("page_id") % 3 == 0, F.lit("?x=1")).when(F.col("page_id") % 3 == 1, F.lit("/")).otherwise("")
    path = F.regexp_extract("url", r"/([0-9]+)(?:\?|$)", 1)
    url = F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/r"), path, tail)
    return pages.select("page_id", T.repository_root(url).alias("root"))


def url_parts(spark, d):
    url = F.col("url")
    parts = F.filter(F.split(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda p: p != "")
    return _table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)).alias("host"), F.size(parts).cast("long").alias("n_parts"), (F.size(parts) == 2).alias("root_like"))


def percent_decode(spark, d):
    """Encodes links and decodes them strictly; + stays, broken escapes are null."""
    rows = html_links(spark, d)
    return rows.select("page_id", "pos", T.percent_decoded(F.concat(F.replace("href", F.lit("a"), F.lit("%61")), F.lit("+b"))).alias("decoded"))


def path_normalize(spark, d):
    rows = html_links(spark, d)
    written = F.concat(F.lit("docs/guide/.."), F.col("href"), F.lit("/./x/../y"))
    return rows.select("page_id", "pos", T.normal_path(written).alias("path"))


# Policy -------------------------------------------------------------------


def last_match_wins_kind(spark, d):
    mapping = [("^.*$", "other"), ("BRASS$|STEEL$", "reference"), ("^ECONOMY|^PROMO", "howto"), ("STEEL$", "adr")]
    parts = _table(spark, d, "part")
    return parts.select("p_partkey", policy.last_match(F.col("p_type"), mapping).alias("kind"))


def rule_selection(spark, d):
    """Selectors by region; regions 2 and 4 have the preview, and names with an A ignore LNK per file."""
    files = _table(spark, d, "nation").select(F.col("n_name").alias("filename"), "n_regionkey", F.col("n_regionkey").isin(2, 4).alias("preview"))
    rules = spark.createDataFrame([("LNK001", "LNK", True), ("LNK002", "LNK", False), ("STL001", "STL", False), ("KND001", "KND", True)], "code string, family string, stable boolean")
    every = spark.createDataFrame([(0, "ALL", "select"), (1, "LNK", "select"), (1, "LNK001", "ignore"), (2, "LNK002", "select"), (2, "LNK", "ignore"), (3, "KND", "select"), (3, "KND", "ignore"), (4, "STL001", "select"), (4, "ALL", "select")], "region int, selector string, action string")
    selectors = files.join(every, F.col("n_regionkey") == F.col("region")).select("filename", "selector", "action")
    selectors = selectors.unionByName(files.where("filename like '%A%'").select("filename", F.lit("LNK").alias("selector"), F.lit("per_file").alias("action")))
    return policy.selected_rules(files, rules, selectors)


def suppression_winner(spark, d):
    """Lines as diagnostics, orders' line ranges as suppressions, the tightest wins; every third order covers its first lines alone."""
    lines = _table(spark, d, "lineitem")
    points = lines.select(F.col("l_orderkey").alias("doc"), F.lit("A").alias("code"), F.col("l_linenumber").cast("long").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    orders = _table(spark, d, "orders")
    span = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("start", "stop", "scope", "n"), strict=True)])
    spans = F.when(F.col("o_orderkey") % 3 == 0, F.array(span(0, 3, 1, 0))).otherwise(F.array(span(0, 100, 1, 0), span(2, 6, 0, 1), span(3, 5, 0, 2)))
    records = orders.select(F.col("o_orderkey").alias("doc"), F.lit("A").alias("code"), F.inline(spans)).withColumn("record", F.col("n").cast("long"))
    return policy.suppression_winner(points, records).select("id", "record")


# Workspaces made from tables -----------------------------------------------


def markdown_sections(spark, d):
    """Parts as documents of two headings: their sections with byte spans and what they define."""
    c = lambda x: F.col(x)
    text = F.concat(F.lit("# "), c("p_name"), F.lit("\n\n"), c("p_brand"), F.lit(" is here. It is "), c("p_type"), F.lit(".\n\n## "), c("p_type"), F.lit("\n\n- `size_"), c("p_size"), F.lit("`: is how large it is.\n"))
    shredded = markdown.shred(_spread(_table(spark, d, "part")).select("p_partkey", text.alias("text")), "p_partkey")
    names = F.size(F.filter("identifiers", lambda i: F.startswith(i["text"], F.lit("size_"))))
    rows = shredded.select(F.col("doc").alias("p_partkey"), names.cast("long").alias("n_names"), F.size("sentences").cast("long").alias("n_sentences"), F.inline("sections"))
    return rows.select("p_partkey", F.col("idx").cast("long").alias("idx"), "heading", F.col("start").cast("long").alias("start"), F.col("own_stop").cast("long").alias("own_stop"), "n_names", "n_sentences")


def rule_hits_by_code(spark, d):
    """Customers as how-to pages, each with one of eight sentences: what the sentence rules find."""
    sentences = ("The service currently uses `v7.2.3`.", "It was fixed in build `a1b2c3d`.", "For loading, see the source.", "## Why we chose Redis", "The user confirmed it does not crash.", "This form is faster.", "I have implemented the panel.", "Calm words.")
    text = F.concat(F.lit("---\nkind: howto\n---\n# "), F.col("c_name"), F.lit("\n\n"), F.element_at(F.array(*map(F.lit, sentences)), (F.col("c_custkey") % 8 + 1).cast("int")), F.lit("\n"))
    shredded = markdown.shred(_spread(_table(spark, d, "customer")).select("c_custkey", text.alias("text")), "c_custkey").persist(StorageLevel.MEMORY_AND_DISK)
    codes = {"STL001", "STL003", "PTR003", "RAT002", "VOX001", "EVD001", "VOX003", "STL002", "STL004"}
    found, _ = lexical.run(markdown.table(shredded, "sentences"), markdown.table(shredded, "blocks"), None, codes)
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("doc").alias("first_key"))


def workspace_links(spark, d):
    """Nations as pages that link to their region's, the next ones' and a missing page: link rules of the whole check."""
    nation, region = _table(spark, d, "nation"), _table(spark, d, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    slug = F.concat(F.lit("region-"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")))
    at = lambda n: F.concat(F.lit("(../region/"), (F.col("r_regionkey") + n).cast("string"), F.lit(".md"))
    text = F.concat(F.lit("[a]"), at(0), F.lit("#"), slug, F.lit(") [b]"), at(1), F.lit("#"), slug, F.lit(") [c]"), at(3), F.lit(") [d](gone.md)\n"))
    files = own.select(F.concat(F.lit("nation/"), "n_nationkey", F.lit(".md")).alias("filename"), text.alias("text"))
    files = files.unionByName(region.select(F.concat(F.lit("region/"), "r_regionkey", F.lit(".md")).alias("filename"), F.concat(F.lit("# Region "), "r_name", F.lit("\n")).alias("text")))
    result = check.check(files, {"": config.settled({"preview": True, "lint": {"select": ["LNK"]}})})
    return result.diagnostics.groupBy(F.col("doc").alias("filename"), "code").agg(F.count("*").alias("n"))


def stratified_sample(spark, d):
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id")
    return policy.stratified_sample(docs, ["lang", "quality"], ["doc_id"], 6).select("lang", "quality", "doc_id", F.col("place").cast("long").alias("place"))


# Evaluation ---------------------------------------------------------------


def _labelled(spark, d):
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    label = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "tp").otherwise("fp")
    return rows.withColumn("label", label)


def precision_by_group(spark, d):
    rows = _labelled(spark, d)
    rolled = evaluate.precision(rows, ["lang", "source"])
    # Both dimensions are short lists of names; every pair of them is a group.
    each = rows.agg(F.collect_set(F.struct("lang")).alias("langs"), F.collect_set(F.struct("source")).alias("sources"))
    dims = each.select(F.inline("langs"), "sources").select("lang", F.inline("sources"))
    return evaluate.with_empty_groups(rolled, dims, ["lang", "source"])


def promotion_gate(spark, d):
    return evaluate.gate(evaluate.precision(_labelled(spark, d), ["lang"]), 50, 0.6).select("lang", "tp", "fp", "uncertain", "promoted")


def confusion_matrix(spark, d):
    return evaluate.confusion(_table(spark, d, "labels"), "quality", "toxic")


def reviewer_agreement(spark, d):
    return evaluate.agreement(_labelled(spark, d), "quality", "toxic", ["lang"])


def report_diff(spark, d):
    orders = _table(spark, d, "orders")
    before = orders.where(F.col("o_orderkey") % 7 != 0).select("o_orderkey", F.col("o_orderpriority").alias("v"))
    after = orders.where(F.col("o_orderkey") % 5 != 0).select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("v"))
    return evaluate.diff(before, after, ["o_orderkey"], "v")


def multiset_diff(spark, d):
    events = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    odd, even = events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0")
    return evaluate.introduced(odd, even, ["user_id", "event_type"], ["event_id"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def noise_per_100(spark, d):
    events = _table(spark, d, "events")
    hits = events.where("event_type in ('error', 'signup')").select(F.col("event_type").alias("code"), "user_id")
    return evaluate.noise(events, hits, "user_id")


def cumulative_stop(spark, d):
    lines = _table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return evaluate.cumulative_stop(lines, "month", "n", 5000).select("month", "n", "before")


def corpus_rollup(spark, d):
    docs = _table(spark, d, "documents")
    return docs.groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# Reports ------------------------------------------------------------------


def _diagnostics(spark, d):
    lines = _table(spark, d, "lineitem")
    return lines.select(
        F.concat(F.lit("f"), F.col("l_suppkey")).alias("filename"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"),
        F.col("l_orderkey").alias("end_row"), (F.col("l_linenumber") + 3).cast("long").alias("end_col"), F.concat("l_returnflag", "l_linestatus").alias("code"),
        F.concat(F.lit("part, 100%: "), F.col("l_partkey")).alias("message"), F.array(F.lit("z"), F.col("l_returnflag")).alias("related"),
    )


def canonical_order_report(spark, d):
    return report.concise(_diagnostics(spark, d)).select("line")


def github_annotations(spark, d):
    return report.github(_diagnostics(spark, d)).select("line")


def sarif_rule_index(spark, d):
    return report.rule_index(_diagnostics(spark, d))


def diagnostic_statistics(spark, d):
    return report.statistics(_diagnostics(spark, d))


_BRUTE = """
units AS (SELECT doc_id, lang, list_sort(list_distinct([c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4] FOR i IN range(1, len(c) - 3)])) AS s
  FROM (SELECT doc_id, lang, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '') AS c, text FROM documents)
  WHERE length(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) >= 80 AND len(c) >= 12),
heads AS (SELECT lang, min(doc_id) AS h, s, len(s) AS n FROM units WHERE len(s) >= 8 GROUP BY lang, s),
tok AS (SELECT lang, h, n, unnest(s) AS t FROM heads),
pairs AS (SELECT x.h AS a, y.h AS b, count(*) AS shared, any_value(x.n + y.n) - count(*) AS total
  FROM tok x JOIN tok y ON x.lang = y.lang AND x.t = y.t AND x.h < y.h AND least(x.n, y.n) >= 0.9 * greatest(x.n, y.n) - 1e-9
  GROUP BY x.h, y.h HAVING count(*) >= 0.9 * (any_value(x.n + y.n) - count(*)) - 1e-9)"""
_OWNERS = _BRUTE + """,
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
ranks AS (SELECT d.doc_id, coalesce(l.quality * 2 - l.toxic, 0) AS r FROM documents d LEFT JOIN labels l USING (doc_id)),
own AS (SELECT e.a AS unit, min(CASE WHEN y.r > x.r THEN e.b END) AS higher, min(CASE WHEN y.r = x.r THEN e.b END) AS tied
  FROM both_ways e JOIN ranks x ON x.doc_id = e.a JOIN ranks y ON y.doc_id = e.b GROUP BY e.a)"""
_MEMBERS = _BRUTE + """,
members AS (SELECT doc_id AS unit, min(doc_id) OVER (PARTITION BY lang, s) AS head FROM units WHERE len(s) >= 8),
member_pairs AS (SELECT x.unit AS a, y.unit AS b, shared, total FROM pairs p JOIN members x ON x.head = p.a JOIN members y ON y.head = p.b
  UNION ALL SELECT x.unit, y.unit, 1, 1 FROM members x JOIN members y ON x.head = y.head AND x.unit < y.unit)"""
_MEMBER_OWNERS = _MEMBERS + """,
both_ways AS (SELECT a, b FROM member_pairs UNION ALL SELECT b, a FROM member_pairs),
ranks AS (SELECT d.doc_id, coalesce(l.quality * 2 - l.toxic, 0) AS r FROM documents d LEFT JOIN labels l USING (doc_id)),
own AS (SELECT e.a AS unit, min(CASE WHEN y.r > x.r THEN e.b END) AS higher, min(CASE WHEN y.r = x.r THEN e.b END) AS tied
  FROM both_ways e JOIN ranks x ON x.doc_id = e.a JOIN ranks y ON y.doc_id = e.b GROUP BY e.a)"""
_SENTENCES = """
parts AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([。！？])', '\\1' || chr(1), 'g'), '([.!?])(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents),
sent AS (SELECT doc_id, list_filter(list_transform(p, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM parts)"""
_CLEAN = """
clean AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>|<textarea[^>]*>.*?</textarea\\s*>|<title[^>]*>.*?</title\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS c FROM pages),
found AS (SELECT page_id, regexp_extract_all(c, '<a\\s+href="([^"]*)"', 1) AS l FROM clean),
link AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href FROM found)"""
_DIAGNOSTICS = """
d AS (SELECT 'f' || l_suppkey AS filename, l_orderkey AS row, CAST(l_linenumber AS BIGINT) AS col, l_orderkey AS end_row, CAST(l_linenumber + 3 AS BIGINT) AS end_col,
  l_returnflag || l_linestatus AS code, 'part, 100%: ' || l_partkey AS message, l_returnflag AS r FROM lineitem)"""
_LABELLED = """
r AS (SELECT l.*, d.lang, d.source, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'tp' ELSE 'fp' END AS label FROM labels l JOIN documents d USING (doc_id))"""
_COUNTS = "count(*) FILTER (label = 'tp') AS tp, count(*) FILTER (label = 'fp') AS fp, count(*) FILTER (label = 'uncertain') AS uncertain"



def _has(text: str, phrases: list[str]) -> str:
    """SQL for whether a phrase occurs, with word boundaries at ASCII letters and digits."""
    worded = "|".join(p.replace(".", "[.]") for p in phrases if p[0].isascii())
    signs = "|".join(p for p in phrases if not p[0].isascii())
    said = f"regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])({worded})($|[^\\p{{L}}\\p{{N}}_])')"
    return f"({said} OR regexp_matches({text}, '{signs}'))" if signs else said


def _slug(text: str) -> str:
    return f"replace(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}} \\-]', '', 'g'), ' ', '-')"


ORACLE_SQL = {
    "sentence_split": f"WITH {_SENTENCES} SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM sent",
    "line_table": """WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p, regexp_extract_all(text, '\\r\\n|\\r|\\n') AS e FROM documents),
        u AS (SELECT r, doc_id, unnest(range(len(p))) AS line, unnest(p) AS c, unnest(list_concat(list_transform(e, lambda x: strlen(x)), [0])) AS x FROM l)
        SELECT doc_id, line, CAST(coalesce(sum(strlen(c) + x) OVER (PARTITION BY r ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte, strlen(c) AS n_bytes FROM u""",
    "detect_language": """WITH t AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations),
        c AS (SELECT origin, id, len(regexp_extract_all(text, '[\\x{3040}-\\x{30ff}\\x{ff66}-\\x{ff9f}]')) AS k, len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{20000}-\\x{323af}]')) AS h, len(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM t)
        SELECT origin, id, CASE WHEN k + h > w THEN CASE WHEN k > 0 THEN 'ja' ELSE 'zh' END ELSE 'en' END AS language FROM c""",
    "shingle_stats": """WITH f AS (SELECT lang, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
        s AS (SELECT lang, text, string_split(t, '') AS c FROM f),
        p AS (SELECT lang, CASE WHEN len(c) < 5 THEN 0 ELSE len(list_distinct([c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4] FOR i IN range(1, len(c) - 3)])) END AS n, length(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) AS a FROM s)
        SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_shingles, max(n) AS most, count(*) FILTER (a >= 80) AS n_units FROM p GROUP BY lang""",
    "near_duplicate_documents": f"WITH {_BRUTE} SELECT a, b, shared, total FROM pairs",
    "near_duplicate_owner": f"WITH {_OWNERS} SELECT unit, higher AS owner FROM own WHERE higher IS NOT NULL",
    "ambiguous_owner": f"WITH {_OWNERS} SELECT unit, tied FROM own WHERE higher IS NULL AND tied IS NOT NULL",
    "threshold_sweep": f"WITH {_BRUTE} SELECT t AS threshold, count(*) FILTER (shared >= t * total - 1e-9) AS n_pairs FROM pairs, (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS t) GROUP BY t",
    "near_duplicate_members": f"WITH {_MEMBERS} SELECT unit, head FROM members",
    "near_duplicate_member_owner": f"WITH {_MEMBER_OWNERS} SELECT unit, higher AS owner FROM own WHERE higher IS NOT NULL",
    "ambiguous_member_owner": f"WITH {_MEMBER_OWNERS} SELECT unit, tied FROM own WHERE higher IS NULL AND tied IS NOT NULL",
    "member_threshold_sweep": f"WITH {_MEMBERS} SELECT t AS threshold, count(*) FILTER (shared >= t * total - 1e-9) AS n_pairs FROM member_pairs, (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS t) GROUP BY t",
    "exact_duplicates": "SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "containment_overlap": """WITH i AS (SELECT item_id AS item, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
        d AS (SELECT doc_id AS unit, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS t FROM documents),
        j AS (SELECT item, len(w) AS size, unnest(w) AS t FROM i)
        SELECT item, unit, count(*) AS shared, any_value(size) AS size FROM j JOIN d USING (t) GROUP BY item, unit HAVING count(*) >= 0.8 * any_value(size)""",
    "marker_positions": """WITH m AS (SELECT doc_id, text, regexp_extract(' ' || lower(text), '^((?s).*?)[^\\p{L}\\p{N}_]the($|[^\\p{L}\\p{N}_])', 1) AS b, regexp_matches(' ' || lower(text), '[^\\p{L}\\p{N}_]the($|[^\\p{L}\\p{N}_])') AS y,
          regexp_extract(' ' || lower(text), '^((?s).*?)[^\\p{L}\\p{N}_]of the($|[^\\p{L}\\p{N}_])', 1) AS c, regexp_matches(' ' || lower(text), '[^\\p{L}\\p{N}_]of the($|[^\\p{L}\\p{N}_])') AS z FROM documents)
        SELECT doc_id, CASE WHEN z AND length(c) < length(b) THEN length(c) ELSE length(b) END AS start, CASE WHEN z AND length(c) < length(b) THEN length(c) + 6 ELSE length(b) + 3 END AS stop FROM m WHERE y""",
    "conditional_sentences": f"WITH {_SENTENCES}, u AS (SELECT doc_id, unnest(s) AS x FROM sent) SELECT doc_id, count(*) AS n, count(*) FILTER ({_has('x', L.CONDITIONAL)}) AS n_hits FROM u GROUP BY doc_id",
    "stale_value_sentences": f"""WITH {_SENTENCES}, u AS (SELECT doc_id, unnest(s) AS x FROM sent),
        v AS (SELECT doc_id, x, regexp_extract(' ' || x, '^((?s).*?[^A-Za-z0-9_])((?:[vV]?[0-9]+(?:\\.[0-9]+)+(?:[-+][A-Za-z0-9.-]+)?|[A-Fa-f0-9]{{7,40}}|[A-Za-z][A-Za-z0-9_.-]*(?:/[A-Za-z0-9_.-]+)*:[A-Za-z0-9_.-]+|[0-9]+)(?:$|[^A-Za-z0-9_]))', 1) AS b FROM u
          WHERE {_has('x', [*L.STALE['en'], 'the'])} AND NOT {_has('x', [*L.CONSTRAINT['en'], 'for the'])} AND NOT regexp_matches(x, '>=|<=|≥|≤|[0-9](\\.[0-9]+)*\\+'))
        SELECT doc_id, count(*) AS n, CAST(min(strlen(b) - 1) AS BIGINT) AS least FROM v WHERE b <> '' GROUP BY doc_id""",
    "rationale_heads": f"""WITH {_SENTENCES}, u AS (SELECT doc_id, s[1] AS x FROM sent WHERE len(s) > 0),
        m AS (SELECT doc_id, regexp_extract(lower(x), '^(why we chose|why we choose|why we use|why not use|and of|the|a)($|[^\\p{{L}}\\p{{N}}_])', 1) AS h FROM u)
        SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(strlen(h) AS BIGINT) AS stop FROM m WHERE h <> ''""",
    "evaluative_claims": f"""WITH {_SENTENCES}, u AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM sent)
        SELECT doc_id, count(*) AS n, min(i) AS first_idx FROM u WHERE {_has('x', [*L.EVALUATION['en'], 'that'])} AND NOT {_has('x', L.CONDITIONAL)}
          AND NOT regexp_matches(x, '(?i)(^|[^\\p{{L}}\\p{{N}}_])[0-9]+(\\.[0-9]+)?\\s*(%|倍|秒|(ms|seconds?|requests?/s|ops/s|mb/s|gb/s)($|[^\\p{{L}}\\p{{N}}_]))') GROUP BY doc_id""",
    "narration_hits": f"SELECT role, count(*) AS n, count(*) FILTER ({_has('text', [*L.NARRATION['en'], 'of the'])}) AS n_hits FROM conversations GROUP BY role",
    "version_mentions": "SELECT 'v' || p_size || '.' || p_partkey % 10 || CASE WHEN p_partkey % 3 = 0 THEN '.4-rc.1' ELSE '' END AS value, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1",
    "number_mentions": "WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)+')) AS v FROM documents) SELECT doc_id, count(*) AS n, min(v) AS least FROM u GROUP BY doc_id",
    "html_links": f"WITH {_CLEAN} SELECT page_id, pos, href FROM link",
    "html_comments": """WITH c AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>|<textarea[^>]*>.*?</textarea\\s*>|<title[^>]*>.*?</title\\s*>', '', 'g'), '(?s)<!--(.*?)-->', 1) AS l FROM pages)
        SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS comment FROM c""",
    "html_title_slug": f"SELECT page_id, {_slug("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS slug FROM pages",
    "html_anchor_ids": f"""WITH {_CLEAN}, h AS (SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(c, '\\s(?:id|name)="([^"]+)"', 1), list_transform(regexp_extract_all(c, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {_slug('trim(x)')})))) AS anchor FROM clean)
        SELECT page_id, anchor FROM h WHERE anchor <> ''""",
    "missing_anchor": f"""WITH {_CLEAN}, h AS (SELECT page_id, list_concat(regexp_extract_all(c, '\\s(?:id|name)="([^"]+)"', 1), list_transform(regexp_extract_all(c, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {_slug('trim(x)')})) AS a FROM clean),
        q AS (SELECT page_id, {_slug("trim(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1))")} AS anchor FROM pages)
        SELECT q.page_id, q.anchor FROM q JOIN h ON h.page_id = q.page_id + 1 WHERE q.anchor <> '' AND NOT list_contains(h.a, q.anchor)""",
    "link_target_missing": f"WITH {_CLEAN}, k AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)) AS p FROM pages) SELECT page_id, count(*) AS n_missing FROM link WHERE lower(substr(href, 2)) NOT IN (SELECT p FROM k) GROUP BY page_id",
    "url_parts_root_pointer": "SELECT page_id, page_id % 5 <> 1 AND page_id % 3 <> 0 AND NOT (page_id % 7 = 0 AND page_id % 5 <> 4) AS root FROM pages",
    "url_parts": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS n FROM pages)
        SELECT page_id, host, n AS n_parts, n = 2 AS root_like FROM p""",
    "percent_decode": f"WITH {_CLEAN} SELECT page_id, pos, href || '+b' AS decoded FROM link",
    "path_normalize": f"WITH {_CLEAN} SELECT page_id, pos, 'docs/' || array_to_string(list_filter(string_split(href, '/'), lambda x: x <> '' AND x <> '.'), '/') || '/y' AS path FROM link",
    "last_match_wins_kind": "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL' THEN 'adr' WHEN p_type LIKE 'ECONOMY%' OR p_type LIKE 'PROMO%' THEN 'howto' WHEN p_type LIKE '%BRASS' THEN 'reference' ELSE 'other' END AS kind FROM part",
    "rule_selection": """WITH rules(code, family, stable) AS (VALUES ('LNK001', 'LNK', true), ('LNK002', 'LNK', false), ('STL001', 'STL', false), ('KND001', 'KND', true)),
        sel(region, selector, action) AS (VALUES (0, 'ALL', 'select'), (1, 'LNK', 'select'), (1, 'LNK001', 'ignore'), (2, 'LNK002', 'select'), (2, 'LNK', 'ignore'), (3, 'KND', 'select'), (3, 'KND', 'ignore'), (4, 'STL001', 'select'), (4, 'ALL', 'select')),
        s AS (SELECT n_name AS filename, n_regionkey IN (2, 4) AS preview, code, family, stable, action, CASE selector WHEN code THEN 2 WHEN family THEN 1 WHEN 'ALL' THEN 0 END AS s FROM nation JOIN sel ON n_regionkey = region CROSS JOIN rules),
        b AS (SELECT filename, code, family, stable, preview, max(s) FILTER (action = 'select') AS w, max(s) FILTER (action = 'ignore') AS i FROM s WHERE s IS NOT NULL GROUP BY ALL)
        SELECT filename, code FROM b WHERE w > coalesce(i, -1) AND (stable OR preview) AND NOT (family = 'LNK' AND filename LIKE '%A%')""",
    "suppression_winner": """SELECT id, CAST(r AS BIGINT) AS record FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN l_linenumber < 3 THEN 0 END
          WHEN l_linenumber >= 3 AND l_linenumber < 5 THEN 2 WHEN l_linenumber >= 2 AND l_linenumber < 6 THEN 1 ELSE 0 END AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r IS NOT NULL""",
    "markdown_sections": """WITH t AS (SELECT p_partkey, p_name, p_type, strlen(p_name) + 4 + strlen(p_brand) + 16 + strlen(p_type) + 3 AS a, strlen(p_type) + 5 + 8 + strlen(CAST(p_size AS VARCHAR)) + 23 AS z FROM part)
        SELECT p_partkey, CAST(unnest([0, 1, 2]) AS BIGINT) AS idx, unnest([NULL, p_name, p_type]) AS heading, CAST(unnest([0, 0, a]) AS BIGINT) AS start, CAST(unnest([0, a, a + z]) AS BIGINT) AS own_stop, CAST(1 AS BIGINT) AS n_names, CAST(5 AS BIGINT) AS n_sentences FROM t""",
    "rule_hits_by_code": """SELECT code, count(*) AS n, min(c_custkey) AS first_key FROM (SELECT c_custkey, ['STL001', 'STL003', 'PTR003', 'RAT002', 'VOX001', 'EVD001', 'VOX003', NULL][CAST(c_custkey % 8 AS INT) + 1] AS code FROM customer) WHERE code IS NOT NULL GROUP BY code""",
    "workspace_links": """WITH x AS (SELECT 'nation/' || n_nationkey || '.md' AS filename, n_regionkey AS r FROM nation)
        SELECT filename, 'LNK001' AS code, CAST(1 + CAST(r + 1 > 4 AS INT) + CAST(r + 3 > 4 AS INT) AS BIGINT) AS n FROM x UNION ALL SELECT filename, 'LNK002', CAST(1 AS BIGINT) FROM x WHERE r + 1 <= 4""",
    "stratified_sample": "SELECT lang, quality, doc_id, place FROM (SELECT lang, quality, doc_id, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS place FROM documents JOIN labels USING (doc_id)) WHERE place <= 6",
    "precision_by_group": f"""WITH {_LABELLED}, g AS (SELECT lang, source, {_COUNTS} FROM r GROUP BY lang, source),
        x AS (SELECT * FROM (SELECT DISTINCT lang FROM r) CROSS JOIN (SELECT DISTINCT source FROM r))
        SELECT x.lang, x.source, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(uncertain, 0) AS uncertain, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision,
          CASE WHEN tp + fp + uncertain > 0 THEN round(tp / (tp + fp + uncertain), 6) END AS conservative FROM x LEFT JOIN g USING (lang, source)""",
    "promotion_gate": f"WITH {_LABELLED}, g AS (SELECT lang, {_COUNTS} FROM r GROUP BY lang) SELECT lang, tp, fp, uncertain, tp + fp + uncertain >= 50 AND round(tp / (tp + fp + uncertain), 6) >= 0.6 AS promoted FROM g",
    "confusion_matrix": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "reviewer_agreement": f"WITH {_LABELLED} SELECT lang, count(*) AS n, round(count(*) FILTER (quality = toxic) / count(*), 6) AS agreement FROM r GROUP BY lang",
    "report_diff": """WITH b AS (SELECT o_orderkey, o_orderpriority AS o FROM orders WHERE o_orderkey % 7 <> 0),
        a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE o_orderpriority END AS n FROM orders WHERE o_orderkey % 5 <> 0)
        SELECT o_orderkey, CASE WHEN b.o IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change, b.o AS old, a.n AS new FROM b FULL JOIN a USING (o_orderkey) WHERE b.o IS DISTINCT FROM a.n""",
    "multiset_diff": "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 2 = 1) GROUP BY ALL",
    "noise_per_100": "WITH t AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT event_type AS code, count(DISTINCT user_id) AS blocked, any_value(n) AS changes, round(100 * count(DISTINCT user_id) / any_value(n), 6) AS per_100 FROM events, t WHERE event_type IN ('error', 'signup') GROUP BY event_type",
    "cumulative_stop": """WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1),
        c AS (SELECT month, n, CAST(coalesce(sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM m) SELECT month, n, before FROM c WHERE before < 5000""",
    "corpus_rollup": "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())",
    "canonical_order_report": f"WITH {_DIAGNOSTICS} SELECT filename || ':' || row || ':' || col || ': ' || code || ' ' || message || ' [' || r || ', z]' AS line FROM d",
    "github_annotations": f"WITH {_DIAGNOSTICS} SELECT '::error file=' || filename || ',line=' || row || ',endLine=' || end_row || ',col=' || col || ',endColumn=' || (end_col - 1) || ',title=' || code || '::' || replace(message, '%', '%25') AS line FROM d",
    "sarif_rule_index": f"WITH {_DIAGNOSTICS} SELECT code, count(*) AS n, dense_rank() OVER (ORDER BY code) - 1 AS rule_index FROM d GROUP BY code",
    "diagnostic_statistics": f"WITH {_DIAGNOSTICS} SELECT code, count(*) AS n FROM d GROUP BY code",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
