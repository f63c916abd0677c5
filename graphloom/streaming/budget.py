"""One budgeted pass over uncommitted changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.dml import insert_edges, overlay_upsert
from ..operators.resolve import named_targets
from ..operators.semantic import Model, embed_nodes, hashed_embeddings
from ..sources.symbols import symbol_nodes

# fixed values: what a pass may take
FILES, EDGES, EMBEDDINGS = 20, 100, 30


@dataclass(frozen=True)
class Pass:
    """nodes for the overlay, edges for the graph, and the nodes that got vectors."""

    nodes: DataFrame
    edges: DataFrame
    embedded: DataFrame

    def on(self, graph: PropertyGraph) -> PropertyGraph:
        known = graph.nodes.join(self.embedded.select("id"), "id", "left_anti").select(*graph.nodes.columns)
        filled = PropertyGraph(known.unionByName(self.embedded), graph.edges, graph.overlay_nodes, graph.overlay_edges)
        return overlay_upsert(insert_edges(filled, self.edges), self.nodes)


def sliding_pass(graph: PropertyGraph, dirty: DataFrame, symbols: DataFrame, refs: DataFrame, now: int, model: Model = hashed_embeddings, files: int = FILES, edges: int = EDGES, embeddings: int = EMBEDDINGS) -> Pass:
    """Takes the first dirty files (path) in order, their symbols and references, and vectors for what has none.

    The budgets are the feature: what they leave out is dirty in the next pass too. A reference leads from the file's
    node, or from its first node by id where it has none, to the nodes of a name, as resolve_static_refs has it.
    """
    chosen = dirty.select("path").distinct().orderBy("path").limit(files)
    nodes = symbol_nodes(symbols.join(F.broadcast(chosen), "path", "left_semi"))[0].withColumn("last_lsp_sync", F.lit(now).cast("bigint"))
    mine = refs.join(F.broadcast(chosen), "path", "left_semi").select("path", "target_name", "edge_type").distinct()
    first = graph.nodes.join(F.broadcast(chosen), "path", "left_semi").groupBy("path").agg(F.min(F.struct(F.col("node_type") != "File", "id")).alias("first"))
    found = named_targets(graph, mine.join(F.broadcast(first), "path").select(F.col("first.id").alias("id"), "target_name", "edge_type"))
    bare = graph.nodes.where("embedding is null").join(nodes.select("id"), "id", "left_semi").select(*graph.nodes.columns)
    return Pass(nodes, found.orderBy("source_id", "target_id").limit(edges), embed_nodes(bare.orderBy("id").limit(embeddings), model))
