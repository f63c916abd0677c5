"""The queries of this package: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed, langid, linededup, minhash, mixing, quality, token_files, toxicity, urls


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    return langid.predict(docs, langid.fit(docs.where("not held_out")), ("doc_id", "held_out"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_deleted", F.length(text).cast("bigint").alias("kept_chars"), F.md5(text).alias("kept_md5"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), pattern(), want=want)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = toxicity.fit(docs.where("not held_out"), table(spark, sf_dir, "labels").where(~langid.held_out()))
    return toxicity.score(docs, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_mix_sources,
        op3_token_files,
        op4_language_id,
        op5_url_filters,
        op6_line_dedup,
        op7_embedding_dedup,
        op8_minhash_dedup,
        op9_byte_bpe,
        op10_toxicity,
    )
}

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op5_url_filters": urls.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op7_embedding_dedup": embed.ORACLE,
}
