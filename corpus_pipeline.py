"""A corpus pipeline: toxic and undetermined texts go, one of each group of copies stays, leaks go, the rest is encoded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.llm import byte_bpe, decontamination, jaccard, language_id, toxicity
from estate_spark.llm.queries import fold, toxicity_labels
from estate_spark.session import shared_dir

MOST_BITS_PER_BYTE = 6.5  # a text that costs more under its best language is in none of them
ROW = "pipeline_row"  # a whole row as one value, or its key within a stage


def as_rows(docs: DataFrame) -> DataFrame:
    """Documents as one column that holds all of theirs: operators carry it through, whatever the names in it."""
    return docs.select(F.struct(*docs.columns).alias(ROW))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts have no evidence and stay.

    Each row is judged where it lies: null and repeated ids, repeated rows and
    other columns make no difference, an empty table stays empty.
    """
    learned = dict(label="label", learn_key="doc_id", learn_text="text")
    scored = toxicity.score_toxicity(as_rows(docs), **toxicity_labels(spark, docs, sf_dir), key=ROW, text=f"{ROW}.text", **learned)
    return scored.where("predicted = 0").select(f"{ROW}.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; null texts, texts without a letter, or far from every language, go.

    Each row is judged where it lies, as in the stage before.
    """
    learn_from = docs.where(fold("doc_id", 4) != 2)
    found = language_id.identify(as_rows(docs), learn_from, key=ROW, text=f"{ROW}.text", learn_key="doc_id", learn_text="text")
    kept = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("bits_per_byte") <= MOST_BITS_PER_BYTE)
    return found.where(kept).select(f"{ROW}.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): that of the smallest id, rows without an id last.

    Rows get a key of their own, written to shared storage, as ids may be null
    or shared; it stands beside a struct of the row's columns, so no name
    clashes. Null and empty texts are no copies of anything and stay.
    """
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/rows"
    rows = jaccard.written(as_rows(docs).withColumn("place", F.monotonically_increasing_id()), path)
    order = F.struct(F.col(f"{ROW}.doc_id").isNull().alias("no_id"), F.col(f"{ROW}.doc_id").alias("doc_id"), "place")
    found = jaccard.near_duplicates(rows.select(order.alias("order"), F.col(f"{ROW}.text").alias("text")), words=5, percent=80, key="order")
    copies = found.where(F.col("order.place") != F.col("component_id.place")).select(F.col("order.place").alias("place"))
    return rows.join(copies, "place", "left_anti").select(f"{ROW}.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Each row is judged where it lies."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and whether they decode to the text's own bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "valid_utf8")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
