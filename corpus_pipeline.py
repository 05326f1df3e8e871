"""A corpus pipeline of five operators; each stage reads what the one before wrote.

Documents are told apart by doc_id. Of rows that share an id, or have none, each is judged by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, jaccard, secrets, toxicity, wu_manber
from tallyfold.llm.common import bounded_batches, framed, fresh_path, saved, table

#: No stage but the last can be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def _numbered(docs: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """``docs``, written, with a number for each row in the place of the id, and the names of its own columns."""
    rows, names = framed(docs, doc_id="own_id", text="text")
    return saved(rows.withColumn("doc_id", F.monotonically_increasing_id()), label), names


def _kept(docs: DataFrame, rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose number is not in ``gone``, as they came. The numbers are hashed, so that no text is sorted."""
    return rows.join(gone.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(*names).toDF(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic go, each judged by its own text beside its row; null text and null ids stay.

    The model is learned from labelled documents outside the held-out fold.
    """
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels")
    settings = toxicity.Settings()
    known = labels.where(toxicity.fold() != toxicity.HELD_OUT)
    model = toxicity.train(toxicity.sample(docs, known, settings.train_rows), settings)
    rows, names = framed(docs, text="text")
    return rows.where(toxicity.score_of(model, spark, F.col("text")) < toxicity.LEAST_SCORE).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one with the smallest id (of equal ids, one row)."""
    bounded_batches(spark)
    rows, names = _numbered(docs, "pipeline-near-copies")
    found = jaccard.near_copies(rows)
    own = rows.select("doc_id", "own_id").join(found, "doc_id")
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "doc_id")).alias("first"))
    gone = own.join(first, "component_id").where(F.col("doc_id") != F.col("first.doc_id"))
    return _kept(docs, rows, gone, names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule accuses go; a text is judged beside its row, null text stays."""
    bounded_batches(spark)
    rows, names = framed(docs, text="text")
    return wu_manber.clean(rows, table(spark, sf_dir, "benchmark")).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are replaced."""
    return secrets.redact(docs, secrets.findings(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document and the digest of the text they decode to."""
    bounded_batches(spark)
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic),
    ("near copies", near_copies),
    ("decontamination", decontaminate),
    ("secret scan", secret_scan),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
