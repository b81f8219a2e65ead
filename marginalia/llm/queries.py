"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text with the 32k SentencePiece model."""
    from . import sentence_pieces as op

    out = op.round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), op.ids_digest().alias("ids_sha256"), common.hex_digest("decoded").alias("decoded_sha256"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds personal data, and terms that reveal it, in every text."""
    from . import pii as op

    found = op.sanitise(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*op.ENTITIES, "term")]
    total = sum((F.size(k) for k in op.ENTITIES), F.lit(0)).cast("long").alias("n_entities")
    return found.select("doc_id", *counts, total, common.hex_digest(op.listed(*op.KINDS)).alias("base_sha256"), op.listed(*op.ENTITIES, "term").alias("spans"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text; rows with crc32(doc_id) mod 4 = 2 are held out of fitting."""
    from . import quality_classifier as op

    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = op.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return op.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes words of 13-word windows that a document with a smaller id holds."""
    from . import repeated_spans as op

    return op.deduplicate(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to the sources' target weights."""
    from . import mixing as op

    return op.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rules and divergence from the language's profile, for every text."""
    from . import quality_rules as op

    return op.rules(documents(spark, sf_dir))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every 50th vector with all others."""
    from . import top_products as op

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return op.top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op8_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard index of 0.85 or more."""
    from . import similar_documents as op

    return op.similar(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts tokens of every text; the cache is new, so all distinct texts are misses."""
    from . import token_counts as op

    out = op.token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), common.fresh_path(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every text for licence phrases, tags and expressions."""
    from . import licenses as op

    return op.scan(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_sentence_pieces, op2_personal_data, op3_quality_classifier, op4_repeated_spans, op5_source_mixture, op6_quality_rules, op7_top_products, op8_similar_documents, op9_token_counts, op10_license_scan)
}
ORACLE_SQL: dict[str, str] = {}
