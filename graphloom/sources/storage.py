"""Reading and writing a graph (S19-S21) and its high-water mark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import EDGES, NODES


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(b)
    if had:
        fs.rename(b, old)
    if not fs.rename(a, b):
        if had:
            fs.rename(old, b)
        raise OSError(f"{source} could not become {target}")
    if had:
        fs.delete(old, True)


def save(graph: PropertyGraph, path: str) -> None:
    """Replaces what is at path by a complete new copy: nodes and edges partitioned by type and sorted for pruning."""
    spark, new = graph.spark, f"{path}.new-{uuid.uuid4().hex}"
    graph.nodes.repartition("node_type", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("node_type", "id").write.partitionBy("node_type").parquet(f"{new}/nodes")
    graph.edges.repartition("edge_type", F.pmod(F.xxhash64("source_id"), F.lit(16))).sortWithinPartitions("edge_type", "source_id").write.partitionBy("edge_type").parquet(f"{new}/edges")
    _rename(spark, new, path)


def load(spark: SparkSession, path: str) -> PropertyGraph:
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").select(*NODES.names)
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges").select(*EDGES.names)
    return PropertyGraph(nodes, edges)


def to_json(graph: PropertyGraph) -> DataFrame:
    """(kind, json): a line for each node and edge."""
    nodes = graph.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    return nodes.union(graph.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def set_last_commit(spark: SparkSession, path: str, commit: str) -> None:
    new = f"{path}.new-{uuid.uuid4().hex}"
    spark.createDataFrame([(commit,)], "last_commit string").coalesce(1).write.parquet(new)
    _rename(spark, new, path)


def last_commit(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.schema("last_commit string").parquet(path).first()
    return row and row[0]
