"""Traversals: one plan a hop, and nothing but counts on the driver.

A hop joins the frontier with the edges and drops what has been met. Each hop's result goes to the shared folder, and
results of several hops are merged there, so plans grow with the logarithm of the number of hops; a hop's result is
broadcast only where it was counted and is small. Closures and paths end when nothing new is met, not at a depth.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..runtime import BROADCAST_ROWS, share

#: So many results of hops are merged into one, and so many of those again.
MERGED = 16
#: So many hops are a lazy plan; more are run hop by hop, since a plan that repeats what came before grows fast.
LAZY_HOPS = 2


class Hops:
    """What hops have met so far: a union of few files at any number of hops."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def add(self, met: DataFrame) -> None:
        for level in self.levels:
            level.append(met)
            if len(level) < MERGED:
                return
            met = share(reduce(DataFrame.union, level).coalesce(MERGED), "met")
            level.clear()
        self.levels.append([met])

    def all(self) -> DataFrame | None:
        every = [met for level in self.levels for met in level]
        return reduce(DataFrame.union, every) if every else None


def reach(starts: DataFrame, steps: DataFrame, most: int | None = None, least: int = 1, per_start: bool = False, carry: bool = False) -> DataFrame:
    """(id, depth): nodes at a shortest distance from least to most of some start, along (source, target) steps.

    Without most, all that the starts lead to.
    A start counts as met only if a cycle leads back to it. least = 0 means the same as 1: walks have an edge at
    least. With per_start, (start, id, depth) for each start on its own; with carry, starts has a column start.
    """
    key = ["start", "id"] if per_start else ["id"]
    origin = F.col("start") if carry else F.col("id")
    frontier = starts.select(*([origin.alias("start")] if per_start else []), "id").distinct()
    met, rounds = None, []

    def hop(front: DataFrame, met: DataFrame | None) -> DataFrame:
        after = steps.join(front.withColumnRenamed("id", "source"), "source")
        after = after.select(*(["start"] if per_start else []), F.col("target").alias("id")).distinct()
        return after if met is None else after.join(met, key, "left_anti")

    if most is not None and most <= LAZY_HOPS:
        for depth in range(1, most + 1):
            frontier = hop(frontier, met)
            rounds.append(frontier.withColumn("depth", F.lit(depth)))
            met = frontier if met is None else met.union(frontier)
        out = rounds[0] if rounds else frontier.where(F.lit(False)).withColumn("depth", F.lit(0))
        for r in rounds[1:]:
            out = out.union(r)
        return out.where(F.col("depth") >= least)
    frontier = share(frontier, "frontier")
    size = frontier.count()
    steps = share(steps, "steps")
    hops = Hops()
    for depth in count(1) if most is None else range(1, most + 1):
        if not size:
            break
        met = hops.all()
        frontier = share(hop(F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier, None if met is None else met.drop("depth")), "frontier")
        size = frontier.count()
        if size:
            hops.add(frontier.withColumn("depth", F.lit(depth)))
    out = hops.all()
    if out is None:
        return frontier.where(F.lit(False)).withColumn("depth", F.lit(0))
    return out.where(F.col("depth") >= least)


def bfs(graph: PropertyGraph, start: str, most: int) -> DataFrame:
    """(id, depth, edge_type, source_id): nodes met from start along all edges, with the edges that met them."""
    starts = graph.spark.createDataFrame([(start,)], "id string")
    found = reach(starts, graph.steps(), most)
    before = found.select(F.col("id").alias("source_id"), (F.col("depth") + 1).alias("depth")).union(starts.select(F.col("id").alias("source_id"), F.lit(1).alias("depth"))).distinct()
    edges = graph.edges.select("edge_type", "source_id", F.col("target_id").alias("id"))
    return found.join(edges.join(before, "source_id"), ["id", "depth"]).select("id", "depth", "edge_type", "source_id")


def blast_radius(graph: PropertyGraph, start: str, most: int | None = None) -> DataFrame:
    """(id, depth, is_direct): all that depends on start, over incoming edges of every type of the base graph."""
    starts = graph.spark.createDataFrame([(start,)], "id string")
    found = reach(starts, graph.without_overlay().steps(reverse=True), most).where(F.col("id") != start)
    return found.select("id", (F.col("depth") - 1).alias("depth"), (F.col("depth") == 1).alias("is_direct"))


def trace_dependency(graph: PropertyGraph, start: str, most: int | None = None) -> DataFrame:
    """(id, depth): start itself at 0 and all that it depends on, base and overlay together."""
    merged = graph.merged()
    starts = graph.spark.createDataFrame([(start,)], "id string").join(merged.nodes.select("id"), "id", "left_semi")
    found = reach(starts, merged.steps(), most).where(F.col("id") != start)
    return starts.withColumn("depth", F.lit(0)).union(found)


def call_chain(graph: PropertyGraph, source: str, target: str, most: int | None = None) -> DataFrame:
    """(position, id) along a shortest path over edges of any type; of several, the least in order. Empty if none.

    Distances from the source are found hop by hop until the target is met; then the path is read backwards from
    the target, at each step the least node that is one nearer: no path is carried along.
    """
    merged, spark = graph.merged(), graph.spark
    if source == target:
        return merged.nodes.where(F.col("id") == source).select(F.lit(0).alias("position"), "id").limit(1)
    steps = share(merged.steps(), "steps")
    # distances to the target, so that the path can be read forwards and is the least in order
    goal = spark.createDataFrame([(target,)], "id string")
    back = steps.select(F.col("target").alias("source"), F.col("source").alias("target"))
    frontier, hops, layers, size = goal, Hops(), [goal], 1
    hops.add(goal)
    while True:
        if not size or (most is not None and len(layers) > most):
            return spark.createDataFrame([], "position int, id string")
        nearer = frontier.withColumnRenamed("id", "source")
        after = back.join(F.broadcast(nearer) if size <= BROADCAST_ROWS else nearer, "source").select(F.col("target").alias("id")).distinct()
        frontier = share(after.join(hops.all(), "id", "left_anti"), "frontier")
        hops.add(frontier)
        layers.append(frontier)
        if frontier.where(F.col("id") == source).count():
            break
        size = frontier.count()
    path, at = [(0, source)], source
    for position, layer in enumerate(layers[-2::-1], 1):
        at = steps.where(F.col("source") == at).select(F.col("target").alias("id")).join(layer, "id", "left_semi").agg(F.min("id")).first()[0]
        path.append((position, at))
    return spark.createDataFrame(path, "position int, id string")


def depth_from(graph: PropertyGraph, seeds: tuple[str, ...] = ("main", "App"), most: int = 50) -> DataFrame:
    """(id, depth): layers below the entry points along containment; the entry points are at 0, others have none."""
    starts = graph.nodes.where(F.col("name").isin(*seeds)).select("id").distinct()
    starts = share(starts, "starts")
    found = reach(starts, graph.steps(("Contains",)), most - 1)
    return starts.withColumn("depth", F.lit(0)).union(found.join(starts, "id", "left_anti"))


def navigate_to_anchor(graph: PropertyGraph, start: str) -> DataFrame:
    """The node with the highest anchor score that start leads to, itself included; then the nearest, then by id."""
    met = trace_dependency(graph, start)
    nodes = graph.merged().nodes.join(met, "id")
    ordered = nodes.orderBy(F.coalesce("anchor_score", F.lit(0.0)).desc(), "depth", "id").limit(1)
    return ordered.select("id", "name", "path", F.coalesce("anchor_score", F.lit(0.0)).alias("anchor_score"), "depth")


# fixed values: the types a layered map shows
LAYER_TYPES = ("File", "Namespace", "Class", "Function")


def layered_map(graph: PropertyGraph, layer: int = 0, granularity: str = "") -> DataFrame:
    """What lies at a depth: directories for 'module', paths for 'file', else nodes."""
    nodes = graph.base_first().where(F.col("node_type").isin(*LAYER_TYPES) & (F.col("depth_from_main") == layer))
    if granularity == "module":
        parent = F.when(F.col("node_type") == "Namespace", F.col("path")).otherwise(F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        return nodes.select(parent.alias("path")).where("path <> ''").distinct()
    if granularity == "file":
        return nodes.select("path").distinct()
    return nodes.select("id", "node_type", "name", "path")
