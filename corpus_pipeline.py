"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, mixing to target weights, byte-level BPE.

Each stage works on all that its predecessor kept. ``run`` writes each stage's result to the folder that driver and
executors share and reads it back as the next stage's documents, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, langid, linededup, minhash, mixing
from graphloom.llm.common import share
from graphloom.llm.queries import pattern, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near some language's centroids; those that language ID rejects go.

    The model learns from the labelled documents outside the held-out fifth, as the operator's query does. Where
    no document has a lang, nothing can be told, and every document with letters stays.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs, model, COLUMNS)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return judged.where("not rejected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; a document of which nothing is left goes."""
    left = linededup.dedup_lines(docs, ("doc_id", "lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.where("n_deleted = 0 or n_deleted < n_lines").withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; some sources' documents repeat."""
    return mixing.mix(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, and what they decode to as a digest."""
    want = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), pattern(), ("doc_id", "lang", "source", "n_chars"), want)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the language model, so run() is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that STAGES make of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = share(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
