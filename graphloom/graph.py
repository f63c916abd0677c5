"""The property graph: typed nodes and edges as DataFrames, and an overlay of edits that aren't committed yet."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGES, NODES, conform


@dataclass(frozen=True)
class PropertyGraph:
    """Immutable. Edges are a multigraph: parallel edges stay and count."""

    nodes: DataFrame
    edges: DataFrame
    overlay_nodes: DataFrame | None = None
    overlay_edges: DataFrame | None = None

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From frames that may lack optional columns."""
        return cls(conform(nodes, NODES), conform(edges, EDGES))

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_overlay(self, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        return replace(self, overlay_nodes=conform(nodes, NODES), overlay_edges=conform(edges, EDGES))

    def without_overlay(self) -> PropertyGraph:
        """Also clears an overlay."""
        return replace(self, overlay_nodes=None, overlay_edges=None)

    def merged(self) -> PropertyGraph:
        """One graph of both: an overlay's node hides the base node of its id; edges are the distinct union."""
        if self.overlay_nodes is None:
            return self
        base = self.nodes.join(self.overlay_nodes.select("id"), "id", "left_anti").select(*NODES.names)
        edges = self.edges.unionByName(self.overlay_edges.join(self.edges, ["edge_type", "source_id", "target_id"], "left_anti").select(*EDGES.names))
        return PropertyGraph(self.overlay_nodes.unionByName(base), edges)

    def base_first(self) -> DataFrame:
        """Nodes where the base wins and the overlay adds what it lacks."""
        if self.overlay_nodes is None:
            return self.nodes
        return self.nodes.unionByName(self.overlay_nodes.join(self.nodes.select("id"), "id", "left_anti").select(*NODES.names))

    def steps(self, types: tuple[str, ...] | None = None, reverse: bool = False) -> DataFrame:
        """Distinct (source, target) pairs, of some edge types or all."""
        edges = self.edges if types is None else self.edges.where(F.col("edge_type").isin(*types))
        a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
        return edges.select(F.col(a).alias("source"), F.col(b).alias("target")).distinct()

    def stats(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("node_count"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("edge_count")))
