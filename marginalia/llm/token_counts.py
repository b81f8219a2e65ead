"""Token counts with a digest cache.

Each text is reduced to the digest of its normalised content. Digests are
joined to stored counts of the same tokenizer version; only distinct misses
are encoded, once each, and their counts are appended to the cache.

Normalisation collapses runs of ASCII white space, and only where the
tokenizer itself drops all white space, so that it never changes a count; for
other tokenizers the content is taken as it is.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows, equal texts and rows that share an id are each returned; very long texts
are counted whole; no rows give no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of each of the two generations of a worker's table of words, and the
#: bytes of the longest word it keeps.
TABLE_WORDS, TABLE_WORD = 300_000, 192
#: What becomes one blank: all runs of ASCII white space but a single blank, which stays.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether white space only separates tokens and never becomes one."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    return any(
        s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")
        and r"\s" in s["pattern"].get("Regex", "").rsplit("[^", 1)[-1]
        for s in steps
    )


class Counter:
    """Counts of one tokenizer, kept in a worker process between tasks.

    Where white space only separates tokens, a count is the sum over words,
    and each distinct word is encoded once.
    """

    kept: dict[str, "Counter"] = {}

    def __init__(self, path: str) -> None:
        self.by_word = drops_white_space(path)
        self.table: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def count(self, text: str) -> int:
        if not self.by_word:
            return self.encode([text])[0]
        words = text.encode().split()  # bytes part at ASCII white space only
        table, older = self.table, self.older
        if len(table) > TABLE_WORDS:  # words in use move from the older generation to the new one
            self.table, self.older = table, older = {}, table
        missing, long = [], []
        for w in set(words).difference(table):
            if len(w) > TABLE_WORD:
                long.append(w)
            elif (n := older.get(w)) is None:
                missing.append(w)
            else:
                table[w] = n
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            table.update(zip(part, self.encode([w.decode() for w in part]), strict=True))
        for w in long:
            table[w] = self.encode([w.decode()])[0]
        total = sum(map(table.__getitem__, words))
        for w in long:
            del table[w]
        return total


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Rows (key, n_bytes, n_tokens) of ``docs``.

    ``tokenizer`` is a path that every executor can open. ``cache`` is the path
    of a Parquet table in a shared folder; it is made if missing. Only rows of
    the same tokenizer version are used. A cache that lost rows costs time, not
    correctness, and doubled rows are folded.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    if drops_white_space(tokenizer):
        content = F.trim(F.regexp_replace(content, _RUNS, " "))
    keyed = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), content.alias("body"))
    # Never null, so that no filter digests each text once more.
    keyed = keyed.withColumn("content", F.coalesce(F.sha2("body", 256), F.lit("")))
    digests = common.written(keyed.drop("body"), "digests")

    def stored() -> DataFrame:
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        # Written, so that a join with it may split the rows of a frequent content.
        return common.written(rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")), "counts")

    # One row stands for all equal contents; copies are folded before the shuffle.
    misses = digests.groupBy("content").agg(F.min("key").alias("key")).join(stored(), "content", "left_anti")
    misses = common.written(misses, "misses")
    if not misses.isEmpty():
        bodies = keyed.select("key", "content", "body").join(
            misses.hint("shuffle_hash"), [keyed["key"].eqNullSafe(misses["key"]), keyed["content"] == misses["content"]]
        ).select(keyed["content"], "body")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter.of(tokenizer)
            for b in batches:
                counts = [counter.count(x.as_py()) for x in b.column(1)]
                yield pa.record_batch([pa.array([version] * len(counts)), b.column(0), pa.array(counts, pa.int64())], ["tokenizer", "content", "n_tokens"])

        common.mapped(bodies, encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return digests.join(stored(), "content").select(F.col("key").alias(key), "n_bytes", "n_tokens")
