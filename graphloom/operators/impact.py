"""Reports on one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import token_estimate, truncate_words
from ..graph import PropertyGraph
from . import cochange, traverse


def blast_radius(graph: PropertyGraph, node: str, coupling: bool = False, shown: int = 20) -> DataFrame:
    """(kind, id, depth, is_direct, weight): dependants by depth and id, then, if asked for, ten co-change partners."""
    found = traverse.blast_radius(graph, node).orderBy("depth", "id").limit(shown)
    rows = found.select(F.lit("caller").alias("kind"), "id", "depth", "is_direct", F.lit(None).cast("double").alias("weight"))
    if coupling:
        more = cochange.partners(graph, node).limit(10)
        rows = rows.union(more.select(F.lit("partner"), "id", F.lit(None).cast("int"), F.lit(None).cast("boolean"), "weight"))
    return rows


def confidence(graph: PropertyGraph, node: str) -> DataFrame:
    """(total, confidence): dependants, and the percentage of them that a language server has seen; 100 for none."""
    seen = traverse.blast_radius(graph, node).join(graph.nodes.select("id", "last_lsp_sync"), "id")
    counted = seen.agg(F.count("*").alias("total"), F.count_if(F.coalesce("last_lsp_sync", F.lit(0)) > 0).alias("synced"))
    return counted.select("total", F.when(F.col("total") == 0, 100).otherwise(F.floor(100 * F.col("synced") / F.col("total"))).cast("int").alias("confidence"))


def callees(graph: PropertyGraph, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """What a set of nodes (id) calls directly, distinct, by id."""
    edges = graph.edges.where("edge_type = 'Calls'").join(nodes.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return edges.select(F.col("target_id").alias("id")).distinct().orderBy("id").limit(limit)


def explain_symbol(graph: PropertyGraph, node: str) -> DataFrame:
    """One row: the node, its degrees, score and number of co-change partners."""
    mates = cochange.partners(graph, node).agg(F.count("*").alias("partners"))
    return graph.merged().nodes.where(F.col("id") == node).select("id", "node_type", "name", "path", "signature", "docstring", "fan_in", "fan_out", "anchor_score").crossJoin(F.broadcast(mates))


def context_for_prompt(graph: PropertyGraph, node: str, max_tokens: int = 2000) -> DataFrame:
    """(context, tokens): a symbol's text, callers, callees and three partners, cut to an estimate of tokens."""
    merged = graph.merged()
    me = merged.nodes.where(F.col("id") == node)
    calls = merged.edges.where("edge_type = 'Calls'")
    names = merged.nodes.select("id", "name")

    def listed(edges: DataFrame, end: str, title: str) -> DataFrame:
        found = edges.select(F.col(end).alias("id")).distinct().join(names, "id")
        return found.agg(F.concat(F.lit(f"{title}: "), F.array_join(F.array_sort(F.collect_list("name")), ", ")).alias("part"))

    parts = [
        me.select(F.concat_ws("\n", "name", "signature", "docstring", "path").alias("part")),
        listed(calls.where(F.col("target_id") == node), "source_id", "callers"),
        listed(calls.where(F.col("source_id") == node), "target_id", "callees"),
        cochange.partners(graph, node).limit(3).join(names, "id").agg(F.concat(F.lit("changes with: "), F.array_join(F.array_sort(F.collect_list("name")), ", ")).alias("part")),
    ]
    out = parts[0].withColumn("k", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.union(p.withColumn("k", F.lit(k)))
    text = out.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return text.select(truncate_words(F.col("text"), max_tokens).alias("context"), token_estimate(F.col("text")).alias("tokens"))


def snippet(files: DataFrame, path: str, line: int, context: int = 10) -> DataFrame:
    """(line, text) around a line of a file; files has path and text."""
    rows = files.where(F.col("path") == path).select(F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return rows.select((F.col("n") + 1).alias("line"), "text").where(F.col("line").between(line - context, line + context))


def symbol_snippets(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of each node's own lines."""
    at = nodes.select("id", "path", F.coalesce("line_start", F.lit(1)).alias("a"), F.coalesce("line_end", F.lit(1)).alias("b"))
    return at.join(files, "path").select("id", F.array_join(F.slice(F.split("text", "\n"), F.greatest(F.col("a"), F.lit(1)), F.greatest(F.col("b") - F.col("a") + 1, F.lit(0))), "\n").alias("text"))
