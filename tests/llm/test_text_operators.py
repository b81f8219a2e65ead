"""Tokens, quality, licences and personal data against plain rereadings of their definitions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, licenses, pii, quality_classifier, quality_rules, sentence_pieces, token_counts
from marginalia.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "the", "▁", "ing", "́", "中", "🦀", "<s>", "<0x0A>", "\x00", ".", "'s", "<|endoftext|>", "À", "　", "\x85", "1"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    return [None, "", " ", "x" * 50000, *("".join(rng.choices(ODD, k=rng.randint(1, 30))) for _ in range(400)), "same", "same"]


def test_pieces_are_the_librarys(spark, odd):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentence_pieces.round_trip(docs(spark, odd).withColumn("ids", F.lit("clash")), path).collect()
    assert len(rows) == len(odd)
    for r in rows:
        want = model.encode(r.text or "")
        assert (r.ids, r.decoded) == (want, model.decode(want))


def test_counts_are_the_librarys_and_are_kept(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    want = [(len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for t in odd]
    cache = common.fresh_path(spark, "test-cache")
    for _ in range(2):  # the second time all are hits
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs(spark, odd), path, cache).collect()}
        assert [got[i] for i in range(len(odd))] == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()
    assert token_counts.token_counts(docs(spark, odd).limit(0), path, cache).count() == 0


def test_texts_are_digested_once_to_be_found_and_once_to_be_encoded(spark, odd, monkeypatch, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sent, mapped = [], common.mapped
    monkeypatch.setattr(common, "mapped", lambda df, *more: sent.append(plan(df)) or mapped(df, *more))
    docs(spark, odd).write.parquet(str(tmp_path / "d"))
    out = token_counts.token_counts(spark.read.parquet(str(tmp_path / "d")), tokenizer_path("word_bpe_49k.json"), common.fresh_path(spark, "test-cache"))
    assert [p.count("sha2(") for p in sent] == [1]
    assert "sha2(" not in plan(out) and "regexp_replace" not in plan(out)
    assert out.count() == len(odd)


def test_words_of_all_lengths_are_counted_through_the_table(monkeypatch, odd):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "TABLE_WORDS", 40)
    path = tokenizer_path("word_bpe_49k.json")
    model, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    white = [chr(i) for i in range(0x80) if chr(i).isspace()] + ["\x85", "\u2028", "\u00a0"]
    texts = [w.join(["ab", "É" * n, "x" * n, "ab", "x" * n, ""]) for w in white for n in (1, 63, 64, 65, 192, 193, 500)]
    for t in texts + [t or "" for t in odd] + texts:
        assert counter.count(t) == len(model.encode(t, add_special_tokens=False).ids)
    assert max(map(len, counter.table)) <= token_counts.TABLE_WORD


def rules_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_rule_counts(spark, odd):
    rng = random.Random(3)
    more = [" ".join(rng.choices(["a", "b", "#c", "é\n", "\n", "d e"], k=rng.randint(0, 60))) for _ in range(200)]
    for texts in (odd + more, [None, "", "\n\n"]):
        for r in quality_rules.rules(docs(spark, texts)).collect():
            want = rules_by_hand(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)
    assert quality_rules.rules(docs(spark, ["x"]).limit(0)).count() == 0


def test_divergent_text_fails(spark):
    clean = [" ".join(["the", "man", "and", "of", "it", f"w{i}", "was", "for", "to", "in", f"v{j}"] ) + " " + " ".join(f"word{i}x{k}" for k in range(120)) for i in range(6) for j in range(5)]
    odd = " ".join(f"%%{i}##$$" for i in range(200))
    got = {r.doc_id: r.kept for r in quality_rules.rules(docs(spark, [*clean, odd])).collect()}
    assert not got.pop(len(clean)) and all(got.values())


@pytest.mark.parametrize(
    ("expression", "postfix", "permitted"),
    [
        ("MIT", ["mit"], True), ("MIT OR GPL-2.0", ["mit", "gpl-2.0", "or"], True), ("MIT AND GPL-2.0", ["mit", "gpl-2.0", "and"], False),
        ("(GPL-2.0 WITH x OR MIT) AND ISC", ["gpl-2.0", "x", "with", "mit", "or", "isc", "and"], True),
        ("GPL OR MIT AND ISC", ["gpl", "mit", "isc", "and", "or"], True), ("MIT OR", None, None), ("(MIT", None, None), ("MIT ISC", None, None),
    ],
)
def test_expressions(expression, postfix, permitted):
    assert licenses.to_postfix(expression) == postfix
    assert postfix is None or licenses.permits(postfix) is permitted


def test_licence_places(spark):
    texts = [None, "", "CC-BY cc by, CC BY-NC 4.0", "All rights\nreserved. General Public License! é all rights reserved", "SPDX-License-Identifier: (MIT OR Apache-2.0)\nnext", "reserved rights all"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i].n_base for i in range(6)] == [0, 0, 3, 3, 0, 0]
    assert (got[2].first_word, got[2].last_word, got[2].base_labels) == (0, 4, "cc-by")
    assert (got[3].n_words, got[3].first_word, got[3].last_word, got[3].base_labels) == (10, 0, 7, "gpl,reserved")
    assert got[4].labels == "apache-2.0,mit" and got[4].permissive and got[0].first_word is None
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_exceptions_are_no_licences(spark):
    texts = ["SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT WITH x AND (ISC", "SPDX-License-Identifier: MIT OR GPL-2.0 with y"]
    got = {r.doc_id: (r.labels, r.permissive) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {0: ("gpl-2.0", False), 1: ("isc,mit", None), 2: ("gpl-2.0,mit", True)}


def licences_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    first = [i for i, _ in places]
    return len(words), len(places), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in places}))


def test_licence_base_against_a_rereading(spark):
    rng = random.Random(12)
    parts = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved", "é", "中", ".", "-", "SPDX-License-Identifier: MIT", "x1", "\n", "by"]
    texts = [None, "", "x " * 60000 + "cc by", *(" ".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(300))]
    for r in licenses.scan(docs(spark, texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licences_by_hand(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def hard_rows(spark):
    """Repeated rows, shared and missing ids, null and very long texts, and columns named like results."""
    text = "Some words stand here, and user@mail.com, +49 30 1234567; all rights reserved. " * 3
    rows = [(1, text), (1, text), (1, "other words"), (None, text), (2, None), (3, ""), (4, "long words " * 30000), (5, text.replace("words", "terms"))]
    rows += [(i, f"filler {i} " * 12) for i in range(6, 40)]
    names = ["ids", "decoded", "score", "predicted", "n_words", "kept", "spans", "labels", "key", "body", "content", "term", "email", "secret", "redacted", "size", "taken", "target", "n_tokens", "bag", "label", "row", "whole", "class"]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA)
    return df, df.withColumns({n: F.lit("clash") for n in names}), len(rows)


def test_clashing_columns_change_nothing(spark):
    from marginalia.llm import mixing, repeated_spans, similar_documents

    plain, clashing, n = hard_rows(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    path, words = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
    cache = common.fresh_path(spark, "test-cache")
    operators = {
        "pieces": lambda d: sentence_pieces.round_trip(d, path).select("doc_id", "ids", "decoded"),
        "pii": lambda d: pii.sanitise(d).select("doc_id", pii.listed(*pii.ENTITIES, "term").alias("spans"), "redacted"),
        "quality": lambda d: quality_classifier.score(d, quality_classifier.train(d, labels)).select("doc_id", "score"),
        "spans": repeated_spans.deduplicate,
        "mix": mixing.mix,
        "rules": quality_rules.rules,
        "similar": similar_documents.similar,
        "counts": lambda d: token_counts.token_counts(d, words, cache),
        "licences": licenses.scan,
    }
    for name, operator in operators.items():
        got, want = (Counter(map(str, operator(d).collect())) for d in (clashing, plain))
        assert got == want, name
        assert sum(got.values()) == n, name


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_hand(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}  # noqa: B023
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    rng = random.Random(9)
    signs = ["1", "2", "40", ".", " ", "-", "+", "@", "a", "_", "é", "🦀", "(", "255", "4337166598464399", "+49 30 1234567"]
    texts = [None, "", "9" * 30000, "1 " * 9000, "a@b.c_d@e.f", *("".join(rng.choices(signs, k=60)) for _ in range(300))]
    for r in pii.sanitise(docs(spark, texts)).select("doc_id", pii.listed(*pii.KINDS).alias("s")).collect():
        assert r.s == spans_by_hand(texts[r.doc_id])
    assert pii.sanitise(docs(spark, texts).limit(0)).count() == 0


def test_disclosing_terms(spark):
    texts = [f"ab{i} cd{i} Kontakt user{i}@mail.com so it goes" for i in range(20)] + [f"so it goes on and on {i}" for i in range(200)] + ["copied term odd@mail.com so"] * 30
    got = {r.doc_id: r.redacted for r in pii.sanitise(docs(spark, texts)).collect()}
    assert got[3] == "ab3 cd3  [EMAIL] so it goes" and got[50] == texts[50]
    assert got[230] == "copied term [EMAIL] so"  # copies are no evidence
    assert len(got) == len(texts)


def test_copies_do_not_hide_a_disclosing_term(spark):
    texts = [f"Kontakt user{i}@mail.com so {'it ' * i}" for i in range(9)] + ["Kontakt user0@mail.com so "] * 200 + [f"so on {i}" for i in range(200)]
    got = {r.doc_id: r.redacted for r in pii.sanitise(docs(spark, texts)).collect()}
    assert got[0] == got[9] == got[208] == " [EMAIL] so " and got[300] == texts[300]


def test_terms_that_reveal_one_address(spark):
    texts = [f"so Quentin {i} q@mail.com" for i in range(20)] + [f"Quentin so {i}" for i in range(2)]
    texts += [f"so user{i}@mail.com" for i in range(300)] + [f"so on {i}" for i in range(78)]
    got = {r.doc_id: r.redacted for r in pii.sanitise(docs(spark, texts)).collect()}
    assert got[3] == "so  3 [EMAIL]" and got[30] == "so [EMAIL]" and got[399] == texts[399]


def test_terms_are_replaced_without_the_address_too(spark):
    texts = [f"so Quentin {i} or on and off q{i}@mail.com" for i in range(40)] + ["Quentin on 7"] + [f"so on {i}" for i in range(300)]
    got = {r.doc_id: r.redacted for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "Quentin" not in got[3] and "Quentin" not in got[40] and got[40].endswith(" on 7") and got[99] == texts[99]


def test_classifier(spark):
    rng = random.Random(2)
    good = lambda: ". ".join(" ".join(rng.choices(["some", "words", "flow", "here", "and", "there"], k=8)).capitalize() for _ in range(20))
    bad = lambda: " ".join(rng.choices(["###", "BUY!!", "$$$", "%%%"], k=120))
    texts = [good() if i % 2 else bad() for i in range(240)] + [None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    model = quality_classifier.train(d, labels, max_fit_docs=120)
    got = {r.doc_id: r.score for r in quality_classifier.score(d, model).collect()}
    assert len(got) == len(texts) and all(0 <= x <= 1 for x in got.values())
    assert sum((got[i] >= 0.5) == (i % 2 == 1) for i in range(160, 240)) >= 78
    assert quality_classifier.train(d, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score(d, None).collect()} == {0.5}
