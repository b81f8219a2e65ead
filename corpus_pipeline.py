"""A corpus pipeline: filter, fold near copies, sanitise, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on every row it is given.
All but the last return the columns of ``documents``. Null texts pass through
each stage like empty ones; rows without an id are kept; an empty table gives
an empty table; extra columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import common, mixing, pii, quality_classifier, sentence_pieces, similar_documents
from marginalia.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score below which a document is rejected.
LEAST_QUALITY = 0.7
#: Near copies: share of distinct five-word shingles, in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80

#: Documents scored, clustered, mixed and encoded have no SQL form.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores below LEAST_QUALITY."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = quality_classifier.train(docs, labels)
    if model is None:
        return docs
    return quality_classifier.score(docs, model, name="_score").where(F.col("_score") >= LEAST_QUALITY).drop("_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near copies.

    An id of several rows stays if one of them names its component.
    """
    found = similar_documents.similar(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    gone = common.written(gone.select(F.col("doc_id").alias("gone")), "gone")
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that reveal it; n_chars follows the text."""
    out = pii.sanitise(docs.select(*COLUMNS))
    changed = ~F.col("redacted").eqNullSafe(F.col("text"))
    return out.withColumn("n_chars", F.when(changed, F.length("redacted")).otherwise(F.col("n_chars")).cast("long")).withColumn("text", F.col("redacted")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents to the sources' targets.

    A document appears once for each whole copy taken; where only some of its
    words are taken, one more row holds the first of them.
    """
    # Rows alike in id, source and size pair with their decisions by place.
    alike = ["doc_id", "source", "size"]
    by = lambda *order: F.row_number().over(Window.partitionBy(*alike).orderBy(*order))
    taken = mixing.mix(docs).withColumn("_place", by("copies", "extra"))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in alike], "_place", "copies", "extra")
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = docs.select(*COLUMNS, size.alias("size"))
    rows = rows.withColumn("place", by("text", "lang", "n_chars"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(taken, same & (F.col("size") == F.col("_size")) & (F.col("place") == F.col("_place")))
    whole = F.col("copies") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    # Documents without words weigh nothing and stay once.
    times = F.when(F.col("size") == 0, 1).otherwise(whole).cast("int")
    cuts = F.concat(F.array_repeat(F.lit(-1).cast("long"), times), F.array_repeat(F.col("extra"), part.cast("int")))
    rows = rows.withColumn("cut", F.explode(cuts))
    first = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("cut").cast("string"), F.lit("}+")), F.lit(0))
    text = F.when(F.col("cut") >= 0, first).otherwise(F.col("text"))
    n_chars = F.when(F.col("cut") >= 0, F.length(text)).otherwise(F.col("n_chars")).cast("long")
    return rows.withColumn("n_chars", n_chars).withColumn("text", text).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and checks the ids by decoding them."""
    out = sentence_pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        sentence_pieces.ids_digest().alias("ids_sha256"), common.hex_digest("decoded").alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written before the next reads it."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
