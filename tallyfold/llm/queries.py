"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bitslice, bpe, jaccard, nn_descent, quotes, repair, reshard, secrets, tiles, toxicity, unigram, warc, wu_manber
from tallyfold.llm import oracles as oracles_sql
from tallyfold.llm.common import table

SHARDS = 24

Query = Callable[[SparkSession, str], DataFrame]


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return wu_manber.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf, "documents"))


def op7_reshard(spark: SparkSession, sf: str) -> DataFrame:
    """The old layout is that of the table's files: a file's name decides its shard."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.pmod(F.crc32(F.col("_metadata.file_name").cast("binary")), F.lit(SHARDS)).cast("int").alias("old"),
    )
    out = reshard.reshard(docs, SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_reply_order(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf, "conversations"))


def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.findings(table(spark, sf, "documents"))
    return found.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf, "embeddings"), every=50, k=5)


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.near_duplicates(table(spark, sf, "embeddings"), 0.98)


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """A deviation that a long can't hold is null."""
    return bitslice.whitened(table(spark, sf, "embeddings"), 32).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return repair.repair(rows, repair.damaged(rows))


QUERIES: dict[str, Query] = {
    "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate,
    "op1_reply_order": op1_reply_order,
    "op2_token_counts": op2_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_near_copies": op6_near_copies,
    "op7_reshard": op7_reshard,
    "op8_bpe": op8_bpe,
    "op9_neighbours": op9_neighbours,
    "op10_warc": op10_warc,
    "op11_near_vectors": op11_near_vectors,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op4_decontaminate": oracles_sql.CONTAMINATION,
    "op6_near_copies": oracles_sql.NEAR_COPIES,
    "op11_near_vectors": oracles_sql.NEAR_VECTORS,
    "op13_repair": oracles_sql.REPAIR,
}


def registered() -> dict[str, Query]:
    """All queries with the pipeline; that module stands at the repository's top."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
