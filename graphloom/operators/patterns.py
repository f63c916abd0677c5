"""Literals that files of several directories share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parent_dir
from ..graph import PropertyGraph

FEWEST_FILES, MOST_FILES = 2, 20
MOST_EDGES = 200


def scored(refs: DataFrame) -> DataFrame:
    """(value, files, dirs, score) of values that 2 to 20 files in 2 or more directories hold; refs has value, file, dir."""
    pairs = refs.select("value", "file", "dir").distinct()
    counted = pairs.groupBy("value").agg(F.countDistinct("file").alias("files"), F.countDistinct("dir").alias("dirs"))
    return counted.where(F.col("files").between(FEWEST_FILES, MOST_FILES) & (F.col("dirs") >= 2)).withColumn("score", (F.col("dirs") * (F.col("dirs") - 1) / 2).cast("bigint"))


def pattern_edges(refs: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(value, source, target, score): one edge for each pair of a value's directories, between their first files.

    At most ten a value and most in all, by score, value and directories. The best ``most`` are found by a top-k over
    all, not by a window, so no task sees them all.
    """
    good = scored(refs)
    first = refs.join(good.select("value", "score"), "value").groupBy("value", "score", "dir").agg(F.min("file").alias("file"))
    # a value has at most MOST_FILES directories: its pairs come from one small array
    listed = first.groupBy("value", "score").agg(F.array_sort(F.collect_list(F.struct("dir", "file"))).alias("d"))
    each = F.transform("d", lambda x, i: F.struct(x.alias("a"), F.slice(F.col("d"), i + 2, F.size("d")).alias("rest")))
    pairs = listed.select("value", "score", F.explode(each).alias("p")).select("value", "score", "p.a", F.explode("p.rest").alias("b"))
    budget = F.least(F.lit(most), 10 * good.agg(F.count("*").alias("n")).select("n").scalar()) if hasattr(DataFrame, "scalar") else F.lit(most)
    best = pairs.select("value", "score", F.col("a.dir").alias("dir_a"), F.col("b.dir").alias("dir_b"), F.col("a.file").alias("source"), F.col("b.file").alias("target"))
    best = best.orderBy(F.desc("score"), "value", "dir_a", "dir_b").limit(most)
    w = Window.orderBy(F.desc("score"), "value", "dir_a", "dir_b")  # over at most ``most`` rows
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= budget).select("value", "source", "target", "score")


def high_fan_out(graph: PropertyGraph, least: int = 50, limit: int = 15) -> DataFrame:
    """Files with many outgoing edges besides Contains, and in how many directories the targets of all edges lie."""
    files = graph.nodes.where("node_type = 'File'").select(F.col("id").alias("source_id"), "name", F.col("path").alias("file_path"))
    targets = graph.nodes.select(F.col("id").alias("target_id"), parent_dir(F.col("path")).alias("dir"))
    edges = graph.edges.join(files, "source_id").join(targets, "target_id", "left")
    counted = edges.groupBy("source_id", "name", "file_path").agg(F.count_if(F.col("edge_type") != "Contains").alias("fan_out"), F.countDistinct("dir").alias("domains"))
    return counted.where(F.col("fan_out") >= least).orderBy(F.desc("fan_out"), "source_id").limit(limit)


def boundary_pairs(edges: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    """(pair, n): directories that Pattern edges join; edges has dir_a and dir_b."""
    a, b = F.least("dir_a", "dir_b"), F.greatest("dir_a", "dir_b")
    pairs = edges.where("dir_a <> dir_b").groupBy(F.concat_ws(" <-> ", a, b).alias("pair")).agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(limit)


def boundary_pairs_of(graph: PropertyGraph, least: int = 2, limit: int = 10) -> DataFrame:
    at = graph.nodes.select("id", parent_dir(F.col("path")).alias("dir"))
    edges = graph.edges.where("edge_type = 'Pattern'").join(at.withColumnsRenamed({"id": "source_id", "dir": "dir_a"}), "source_id").join(at.withColumnsRenamed({"id": "target_id", "dir": "dir_b"}), "target_id")
    return boundary_pairs(edges, least, limit)
