"""Writes to a graph: a new graph each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import EDGES, NODES, conform


class MissingEndpoint(ValueError):
    """An edge without both of its nodes."""


def latest(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """One row an id, as if rows came in the order of seq: the last hydrated one, or the last if none is."""
    w = Window.partitionBy("id").orderBy(F.desc("is_hydrated"), F.desc(seq))
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(graph: PropertyGraph, nodes: DataFrame) -> PropertyGraph:
    """Nodes replace those with their ids, but a ghost never replaces a real node; one row an id at most."""
    new = conform(nodes, NODES).withColumn("seq", F.lit(1))
    old = graph.nodes.join(new.select("id"), "id", "left_semi").select(*NODES.names).withColumn("seq", F.lit(0))
    kept = graph.nodes.join(new.select("id"), "id", "left_anti").select(*NODES.names)
    return PropertyGraph(kept.unionByName(latest(new.unionByName(old)).select(*NODES.names)), graph.edges, graph.overlay_nodes, graph.overlay_edges)


def missing_endpoints(graph: PropertyGraph, edges: DataFrame) -> DataFrame:
    ids = graph.nodes.select("id")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return ends.join(ids, "id", "left_anti")


def insert_edges(graph: PropertyGraph, edges: DataFrame, strict: bool = False) -> PropertyGraph:
    """Adds edges; parallel ones stay. Strict: an edge without both nodes is an error, else it is dropped."""
    edges = conform(edges, EDGES)
    if strict:
        lost = [r[0] for r in missing_endpoints(graph, edges).orderBy("id").limit(5).collect()]
        if lost:
            raise MissingEndpoint(f"no node {', '.join(lost)}")
    else:
        ids = graph.nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*EDGES.names)
    return PropertyGraph(graph.nodes, graph.edges.unionByName(edges), graph.overlay_nodes, graph.overlay_edges)


def replace_edges(graph: PropertyGraph, edge_type: str, edges: DataFrame) -> PropertyGraph:
    """Replaces all edges of a type, so that running a job again adds nothing."""
    bare = PropertyGraph(graph.nodes, graph.edges.where(F.col("edge_type") != edge_type), graph.overlay_nodes, graph.overlay_edges)
    return insert_edges(bare, edges)


def overlay_upsert(graph: PropertyGraph, nodes: DataFrame) -> PropertyGraph:
    """The overlay with nodes replaced by id."""
    new = conform(nodes, NODES).dropDuplicates(["id"])
    if graph.overlay_nodes is None:
        return graph.with_overlay(new, graph.spark.createDataFrame([], EDGES))
    kept = graph.overlay_nodes.join(new.select("id"), "id", "left_anti").select(*NODES.names)
    return graph.with_overlay(kept.unionByName(new), graph.overlay_edges)


def overlay_insert_edges(graph: PropertyGraph, edges: DataFrame) -> PropertyGraph:
    """The overlay with edges whose ends it has; one of each (source, target, type)."""
    over = PropertyGraph(graph.overlay_nodes, graph.overlay_edges)
    edges = conform(edges, EDGES)
    lost = [r[0] for r in missing_endpoints(over, edges).orderBy("id").limit(5).collect()]
    if lost:
        raise MissingEndpoint(f"no node {', '.join(lost)} in the overlay")
    return graph.with_overlay(graph.overlay_nodes, graph.overlay_edges.unionByName(edges).dropDuplicates(["source_id", "target_id", "edge_type"]))


def overlay_merge(graph: PropertyGraph, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """Two overlays as one; the later's nodes win."""
    merged = overlay_upsert(graph, nodes)
    return merged.with_overlay(merged.overlay_nodes, merged.overlay_edges.unionByName(conform(edges, EDGES)).dropDuplicates(["source_id", "target_id", "edge_type"]))
