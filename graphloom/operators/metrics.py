"""Degrees, ranking, dead and untested code, coverage, debt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_common_name, is_trait_path
from ..graph import PropertyGraph
from .traverse import depth_from


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of nodes with edges; all types, parallel edges counted: one aggregation for both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def enrich(graph: PropertyGraph, seeds: tuple[str, ...] | None = None) -> PropertyGraph:
    """Sets fan_in, fan_out, anchor_score and co_change_count, and depth_from_main if seeds are named."""
    d = degrees(graph.edges).withColumnsRenamed({"fan_in": "_in", "fan_out": "_out"})
    partners = co_change_counts(graph).withColumnRenamed("partners", "_partners")
    nodes = graph.nodes.join(d, "id", "left").join(partners, "id", "left")
    fan_in, fan_out = F.coalesce("_in", F.lit(0)), F.coalesce("_out", F.lit(0))
    nodes = nodes.withColumns({"fan_in": fan_in.cast("int"), "fan_out": fan_out.cast("int"), "anchor_score": fan_in / (fan_out + 1), "co_change_count": F.coalesce("_partners", F.lit(0)).cast("bigint")})
    if seeds is not None:
        nodes = nodes.drop("depth_from_main").join(depth_from(graph, seeds).withColumnRenamed("depth", "depth_from_main"), "id", "left")
    return PropertyGraph(nodes.select(*graph.nodes.columns), graph.edges, graph.overlay_nodes, graph.overlay_edges)


def co_change_counts(graph: PropertyGraph) -> DataFrame:
    """(id, partners): distinct partners along CoChangedWith edges, either way."""
    pairs = graph.edges.where("edge_type = 'CoChangedWith'").select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))).alias("e"))
    return pairs.select("e.*").distinct().groupBy("id").agg(F.count("*").alias("partners"))


def top_anchors(graph: PropertyGraph, limit: int = 10) -> DataFrame:
    """Nodes by anchor score, a null as 0; ties by id (K1). The overlay's scored nodes compete."""
    nodes = graph.nodes
    if graph.overlay_nodes is not None:
        nodes = graph.merged().nodes
    score = F.coalesce("anchor_score", F.lit(0.0))
    return nodes.select("id", "name", "node_type", score.alias("anchor_score")).orderBy(F.desc("anchor_score"), "id").limit(limit)


def anchor_score(graph: PropertyGraph, node: str) -> DataFrame:
    return graph.merged().nodes.where(F.col("id") == node).select("id", "name", F.coalesce("anchor_score", F.lit(0.0)).alias("anchor_score"))


def context_depth(graph: PropertyGraph, node: str) -> DataFrame:
    return graph.merged().nodes.where(F.col("id") == node).select("id", "name", "depth_from_main")


def unreferenced(nodes: DataFrame) -> DataFrame:
    """Functions that nothing reaches and that reach nothing, unless the language calls them (K5)."""
    return nodes.where((F.col("node_type") == "Function") & (F.coalesce("fan_in", F.lit(0)) == 0) & (F.coalesce("fan_out", F.lit(0)) == 0) & ~is_trait_path(F.col("path")) & ~is_common_name(F.col("name")))


def dead_code(graph: PropertyGraph, like: list[float] | None = None, threshold: float = 0.3, limit: int = 20) -> DataFrame:
    """At most limit of them; those near a vector if any are, else all (K5)."""
    from ..functions import cosine

    found = unreferenced(graph.nodes)
    if like is not None:
        vector = F.array(*[F.lit(float(x)) for x in like])
        near = found.where(cosine(F.col("embedding"), vector) > threshold)
        found = near if near.limit(1).count() else found
    return found.select("id", "name", "path").orderBy("id").limit(limit)


def untested(graph: PropertyGraph, limit: int = 20) -> DataFrame:
    """Functions without incoming edges (K6), and how many there are in all."""
    found = graph.nodes.where("node_type = 'Function' and coalesce(fan_in, 0) = 0").select("id", "name", "path")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("id").limit(limit).crossJoin(F.broadcast(total))


def coverage(graph: PropertyGraph, path: str | None = None) -> DataFrame:
    """(total, untested, pct, band) of functions, of all paths or those that contain one."""
    found = graph.nodes.where("node_type = 'Function'")
    if path is not None:
        found = found.where(F.col("path").contains(path))
    return _covered(found.agg(F.count("*").alias("total"), F.count_if(F.coalesce("fan_in", F.lit(0)) == 0).alias("untested")))


def coverage_by(graph: PropertyGraph, key) -> DataFrame:
    """The same for each value of a column."""
    found = graph.nodes.where("node_type = 'Function'").groupBy(key.alias("key"))
    return _covered(found.agg(F.count("*").alias("total"), F.count_if(F.coalesce("fan_in", F.lit(0)) == 0).alias("untested")))


def _covered(counted: DataFrame) -> DataFrame:
    pct = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(100.0 * (F.col("total") - F.col("untested")) / F.col("total"))
    return counted.withColumn("pct", F.round(pct, 4)).withColumn("band", F.when(pct < 70, "low").when(pct >= 90, "high").otherwise("medium"))


def refactor_targets(graph: PropertyGraph, limit: int = 5) -> DataFrame:
    """Nodes by debt: degree product plus co-changes over anchor score; only those with a flag."""
    i, o = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
    co, anchor = F.coalesce("co_change_count", F.lit(0)), F.coalesce("anchor_score", F.lit(0.0))
    flags = F.array_compact(F.array(F.when((i > 10) & (o > 10), "coupled"), F.when((co > 5) & (anchor < 0.2), "volatile"), F.when(o > 20, "sprawling")))
    debt = i * o + co / (anchor + 0.1)
    rows = graph.nodes.select("id", "name", F.round(debt, 6).alias("debt"), F.array_join(flags, ",").alias("flags")).where("flags <> ''")
    return rows.orderBy(F.desc("debt"), "id").limit(limit)


def explore_architecture(graph: PropertyGraph, max_depth: int = 2, limit: int = 20) -> DataFrame:
    """Files by anchor score; once any file's depth is known, those up to a depth alone (K2)."""
    files = graph.base_first().where("node_type = 'File'")
    known = files.agg(F.bool_or(F.col("depth_from_main").isNotNull()).alias("known"))
    files = files.crossJoin(F.broadcast(known)).where(~F.coalesce("known", F.lit(False)) | (F.col("depth_from_main") <= max_depth))
    return files.select("id", "name", "path", F.coalesce("anchor_score", F.lit(0.0)).alias("anchor_score"), "depth_from_main").orderBy(F.desc("anchor_score"), "id").limit(limit)


def entry_points(graph: PropertyGraph, names: tuple[str, ...] = ("main", "App")) -> DataFrame:
    return graph.base_first().where(F.col("name").isin(*names)).select("id", "name", "path")
