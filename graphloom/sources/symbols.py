"""Symbols that a language server lists, as nodes and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import node_id
from ..schema import EDGES, NODES, conform

# fixed values: kinds of symbols and the node types they become; all others become Module
KINDS = {
    "File": "File", "Module": "Module", "Namespace": "Namespace", "Package": "Package", "Class": "Class",
    "Method": "Method", "Property": "Property", "Interface": "Interface", "Function": "Function",
    "Variable": "Variable", "Constant": "Constant", "Struct": "Struct", "Enum": "Enum",
}
# fixed values: kinds that say nothing about structure
NOISE = ("Variable", "Field", "String", "Number", "Boolean", "Array", "Object", "Key", "Null")


def node_type_of(kind: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(kinds[kind], F.lit("Module"))


def symbol_nodes(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and Contains edges, of flattened symbols (path, name, kind, parent, line_start, line_end).

    parent is the name of the symbol around one in its file, or null for the file itself. Noisy kinds drop out.
    """
    rows = symbols.where(~F.col("kind").isin(*NOISE)).withColumn("node_type", node_type_of(F.col("kind")))
    rows = rows.withColumn("id", node_id(F.col("node_type"), F.col("path"), F.col("name"))).dropDuplicates(["id"])
    files = rows.select("path").distinct().withColumn("name", F.substring_index("path", "/", -1))
    files = files.select(node_id(F.lit("File"), F.col("path"), F.col("name")).alias("id"), F.lit("File").alias("node_type"), "name", "path")
    parents = rows.select(F.col("path"), F.col("name").alias("parent"), F.col("id").alias("parent_id")).dropDuplicates(["path", "parent"])
    held = rows.select("id", "path", "parent").join(parents, ["path", "parent"], "left").join(files.select("path", F.col("id").alias("file_id")), "path")
    source = F.coalesce("parent_id", "file_id")
    edges = held.where(source != F.col("id")).select(F.lit("Contains").alias("edge_type"), source.alias("source_id"), F.col("id").alias("target_id"))
    return conform(rows, NODES).unionByName(conform(files, NODES)), conform(edges, EDGES)
