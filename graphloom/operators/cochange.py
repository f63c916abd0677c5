"""Co-change coupling from commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import node_id
from ..graph import PropertyGraph

WINDOW = 100
MOST_FILES = 100


def recent(commits: DataFrame, n: int = 20) -> DataFrame:
    """The last n commits, newest first; ties by id."""
    return commits.orderBy(F.desc("time"), "id").limit(n)


def head(commits: DataFrame) -> DataFrame:
    """(id, time) of the latest commit."""
    return commits.select("id", "time").orderBy(F.desc("time"), "id").limit(1)


def since(commits: DataFrame, commit: str) -> DataFrame:
    """Commits newer than one, by (time, then id downwards)."""
    at = commits.where(F.col("id") == commit).select(F.col("time").alias("t"), F.col("id").alias("c")).limit(1)
    newer = (F.col("time") > F.col("t")) | ((F.col("time") == F.col("t")) & (F.col("id") < F.col("c")))
    return commits.crossJoin(F.broadcast(at)).where(newer).drop("t", "c")


def changed_since(commits: DataFrame, commit: str, ignored: DataFrame | None = None) -> DataFrame:
    """Distinct files of those commits, without ignored ones."""
    files = since(commits, commit).select(F.explode("files").alias("path")).distinct()
    return files if ignored is None else files.join(ignored.select("path"), "path", "left_anti")


def cochange_pairs(commits: DataFrame, window: int | None = WINDOW, most_files: int = MOST_FILES, least: int = 2) -> DataFrame:
    """(file1, file2, co_change_count), file1 < file2, of the last ``window`` commits (None: all).

    Pairs come from within a commit's own array of distinct files, so a commit is one row and its size, which is
    bounded by skipping larger ones, bounds what it makes. No join is needed.
    """
    used = commits if window is None else commits.orderBy(F.desc("time"), "id").limit(window)
    used = used.where(F.size("files") <= most_files).select(F.array_sort(F.array_distinct("files")).alias("f")).where(F.size("f") > 1)
    others = F.transform("f", lambda x, i: F.struct(x.alias("file1"), F.slice(F.col("f"), i + 2, F.size("f")).alias("rest")))
    pairs = used.select(F.explode(others).alias("p")).select("p.file1", F.explode("p.rest").alias("file2"))
    return pairs.groupBy("file1", "file2").agg(F.count("*").alias("co_change_count")).where(F.col("co_change_count") >= least)


def cochange_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """CoChangedWith edges between the File nodes of pairs; files without a node drop out."""
    files = nodes.where("node_type = 'File'").select("id", "path")
    a = files.select(F.col("path").alias("file1"), F.col("id").alias("source_id"))
    b = files.select(F.col("path").alias("file2"), F.col("id").alias("target_id"))
    return pairs.join(a, "file1").join(b, "file2").select(F.lit("CoChangedWith").alias("edge_type"), "source_id", "target_id", F.col("co_change_count").cast("double").alias("weight"))


def file_id(path):
    """The id of the File at a path."""
    return node_id(F.lit("File"), path, F.substring_index(path, "/", -1))


def partners(graph: PropertyGraph, node: str) -> DataFrame:
    """(id, weight): what changes together with a node, either way, strongest first."""
    edges = graph.edges.where("edge_type = 'CoChangedWith'").where((F.col("source_id") == node) | (F.col("target_id") == node))
    other = F.when(F.col("source_id") == node, F.col("target_id")).otherwise(F.col("source_id"))
    return edges.select(other.alias("id"), "weight").groupBy("id").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "id")


def shared_partners(graph: PropertyGraph, a: str, b: str) -> DataFrame:
    return partners(graph, a).join(partners(graph, b).select("id"), "id", "left_semi").select("id")


def summed_partners(graph: PropertyGraph, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Partners of a set of nodes (id), by the sum of their weights."""
    edges = graph.edges.where("edge_type = 'CoChangedWith'").select("source_id", "target_id", "weight")
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "weight").union(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "weight"))
    return both.join(nodes.select("id").distinct(), "id", "left_semi").groupBy(F.col("other").alias("id")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "id").limit(limit)
