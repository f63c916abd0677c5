"""Search by vectors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cosine, enriched_text
from ..graph import PropertyGraph

#: A model takes a batch of texts and returns their vectors.
Model = Callable[[list[str]], list[list[float]]]

THRESHOLD = 0.3
ANCHOR_WEIGHT = 0.3
# fixed values: the types that search covers in the base graph, and how many nodes a search may embed
SEARCHED = ("File", "Class", "Function", "Struct", "Trait")
ON_DEMAND = 50


def hashed_embedding(text: str, dims: int = 64) -> list[float]:
    """A deterministic stand-in for a model: signed counts of hashed words, normalised; zeros for no words."""
    out = [0.0] * dims
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        out[h % dims] += 1.0 if h >> 31 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def hashed_embeddings(texts: list[str]) -> list[list[float]]:
    return [hashed_embedding(t) for t in texts]


def batches_of(embed: Callable[[str], list[float]]) -> Model:
    """A model from a function of one text."""
    return lambda texts: [embed(t) for t in texts]


def embed_nodes(nodes: DataFrame, model: Model = hashed_embeddings, again: bool = False) -> DataFrame:
    """nodes with vectors of their texts where they have none, or of all; a batch of texts at a time.

    Only texts travel to the model, those of nodes that have a vector as nulls; stored vectors stay in the JVM.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        vectors = iter(model(texts[there].tolist()) if there.any() else [])
        return pd.Series([next(vectors) if t else None for t in there], dtype=object)

    text = enriched_text(F.col("name"), F.col("signature"), F.col("docstring"), F.col("path"))
    if again:
        return nodes.withColumn("embedding", embed(text))
    return nodes.withColumn("embedding", F.coalesce("embedding", embed(F.when(F.col("embedding").isNull(), text))))


def similarities(nodes: DataFrame, vector: list[float]) -> DataFrame:
    """nodes with their cosine with a vector, which is part of the plan: no join."""
    return nodes.withColumn("similarity", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])))


def semantic_search(graph: PropertyGraph, vector: list[float], limit: int = 10, threshold: float = THRESHOLD, model: Model | None = None, on_demand: int = ON_DEMAND) -> DataFrame:
    """(id, name, similarity, score) by similarity plus a part of the anchor score; an overlay hides base nodes.

    With a model, the first nodes without a vector get one, the overlay's before the base's and each by id; their number
    is bounded, since a search must not embed a whole graph: ``embed_nodes`` does that beforehand.
    """
    base = graph.nodes.where(F.col("node_type").isin(*SEARCHED)).withColumn("_base", F.lit(True))
    if graph.overlay_nodes is not None:
        base = graph.overlay_nodes.withColumn("_base", F.lit(False)).unionByName(base.join(graph.overlay_nodes.select("id"), "id", "left_anti"))
    known = base.where("embedding is not null")
    if model is not None:
        known = known.unionByName(embed_nodes(base.where("embedding is null").orderBy("_base", "id").limit(on_demand), model))
    near = similarities(known, vector).where(F.col("similarity") > threshold)
    score = F.col("similarity") + ANCHOR_WEIGHT * F.coalesce("anchor_score", F.lit(0.0))
    return near.select("id", "name", F.round("similarity", 6).alias("similarity"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def prewarm(graph: PropertyGraph, n: int = 20) -> DataFrame:
    """The top n anchors that have no vector yet (K4)."""
    score = F.coalesce("anchor_score", F.lit(0.0))
    return graph.nodes.where("embedding is null").orderBy(score.desc(), "id").limit(n)


def prewarmed(graph: PropertyGraph, n: int = 20, model: Model = hashed_embeddings) -> PropertyGraph:
    """The graph whose top anchors have vectors (K4)."""
    new = embed_nodes(prewarm(graph, n), model)
    rest = graph.nodes.join(new.select("id"), "id", "left_anti").select(*graph.nodes.columns)
    return PropertyGraph(rest.unionByName(new), graph.edges, graph.overlay_nodes, graph.overlay_edges)
