"""Modules: comparison, staleness, masked edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from .cochange import shared_partners


def out_degrees(graph: PropertyGraph) -> DataFrame:
    """(id, n): outgoing edges of each node, the overlay's alone where it has any."""
    base = graph.edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("base"))
    if graph.overlay_edges is None:
        return base.withColumnRenamed("base", "n")
    over = graph.overlay_edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("over"))
    return base.join(over, "id", "full_outer").select("id", F.coalesce("over", "base").alias("n"))


def targets(graph: PropertyGraph) -> DataFrame:
    """Distinct (source_id, target_id) of base and overlay together."""
    pairs = graph.edges.select("source_id", "target_id")
    return (pairs if graph.overlay_edges is None else pairs.union(graph.overlay_edges.select("source_id", "target_id"))).distinct()


def compare_modules(graph: PropertyGraph, a: str, b: str, shown: int = 5) -> DataFrame:
    """(id, name, anchor_score, edges, shared): two nodes side by side, with the co-change partners they share."""
    shared = shared_partners(graph, a, b).agg(F.array_sort(F.collect_list("id")).alias("all")).select(F.slice("all", 1, shown).alias("shared"))
    two = graph.merged().nodes.where(F.col("id").isin(a, b)).select("id", "name", F.coalesce("anchor_score", F.lit(0.0)).alias("anchor_score"))
    return two.join(out_degrees(graph), "id", "left").select("id", "name", "anchor_score", F.coalesce("n", F.lit(0)).alias("edges")).crossJoin(F.broadcast(shared))


def ancestors(path: Column) -> Column:
    """A path and all directories above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def files_of_modules(graph: PropertyGraph) -> DataFrame:
    """(module, and the file's columns): a Namespace's files are those at or below its path.

    Each file is dealt out under its few ancestors, so the prefix condition becomes an equality.
    """
    files = graph.base_first().where("node_type = 'File'").withColumn("module", F.explode(ancestors(F.col("path"))))
    modules = graph.base_first().where("node_type = 'Namespace'").select(F.col("path").alias("module")).distinct()
    return files.join(modules, "module")


# fixed values: the ages in seconds that part the states of a module
FRESH, STALE = 3600, 86400


def master_map(graph: PropertyGraph, now: int, shown: int = 3) -> DataFrame:
    """(module, files, volatile, names, lsp, git, staleness, status) of each Namespace (A10).

    volatile counts files that the overlay holds, names are its first few; staleness is the greater of both ages.
    """
    files = files_of_modules(graph)
    if graph.overlay_nodes is not None:
        files = files.join(graph.overlay_nodes.select("id").distinct().withColumn("volatile", F.lit(True)), "id", "left")
    else:
        files = files.withColumn("volatile", F.lit(None).cast("boolean"))
    found = files.groupBy("module").agg(
        F.count("*").alias("files"),
        F.count_if(F.coalesce("volatile", F.lit(False))).alias("volatile"),
        F.array_sort(F.collect_set(F.when(F.col("volatile"), F.col("name")))).alias("all_names"),
        F.max("last_lsp_sync").alias("lsp"),
        F.max("last_git_sync").alias("git"),
    )
    modules = graph.base_first().where("node_type = 'Namespace'").select(F.col("path").alias("module")).distinct()
    known = F.col("lsp").isNotNull() & F.col("git").isNotNull()
    age = F.when(known, F.greatest(F.lit(now) - F.col("lsp"), F.lit(now) - F.col("git")))
    status = F.when(~known, "Unknown").when(age < FRESH, "Fresh").when(age < STALE, "Stale").otherwise("Outdated")
    return modules.join(found, "module", "left").select("module", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("volatile", F.lit(0)).alias("volatile"), F.array_join(F.slice(F.coalesce("all_names", F.array().cast("array<string>")), 1, shown), ",").alias("names"), "lsp", "git", age.alias("staleness"), status.alias("status"))
