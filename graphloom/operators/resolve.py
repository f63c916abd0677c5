"""Finding nodes: by handle, at a position, by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camel_case, label, node_id, snake_case
from ..graph import PropertyGraph
from ..schema import EDGES

# fixed values: what a type reference may point to
TYPE_TARGETS = ("Struct", "Enum", "Trait", "Class", "Interface")


def by_id(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def by_types(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The first by id with exactly this name (L4)."""
    return nodes.where(F.col("name") == name).orderBy("id").limit(1)


def by_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def search_name(nodes: DataFrame, part: str) -> DataFrame:
    """Names that contain a text, whatever its case."""
    return nodes.where(F.lower("name").contains(part.lower()))


def matching(nodes: DataFrame, node_type: str | None = None, name: str | None = None, label_: str | None = None, path: str | None = None) -> DataFrame:
    """All given conditions together; a path need only contain the text."""
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    if name is not None:
        nodes = nodes.where(F.col("name") == name)
    if label_ is not None:
        nodes = nodes.where(label() == label_)
    return nodes if path is None else nodes.where(F.col("path").contains(path))


def neighbours(graph: PropertyGraph, node: str, direction: str = "outgoing") -> DataFrame:
    """(edge_type, weight, and the neighbour's columns) along edges from or to a node."""
    a, b = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    edges = graph.edges.where(F.col(a) == node).select("edge_type", "weight", F.col(b).alias("id"))
    return edges.join(graph.nodes, "id")


def edges_with_ends(graph: PropertyGraph) -> DataFrame:
    """Each edge with the names of both ends (L3)."""
    a = graph.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    b = graph.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return graph.edges.join(a, "source_id").join(b, "target_id")


def references_others(graph: PropertyGraph) -> DataFrame:
    """Nodes with an outgoing Calls or Uses edge."""
    sources = graph.edges.where(F.col("edge_type").isin("Calls", "Uses")).select(F.col("source_id").alias("id"))
    return graph.nodes.join(sources, "id", "left_semi")


def resolve(graph: PropertyGraph, handle: str) -> DataFrame:
    """The node that a handle means: an overlay's id, a base id, an overlay's name, a base name, a base path."""
    base = graph.nodes.select("id", "name", "path").withColumn("overlay", F.lit(False))
    both = base
    if graph.overlay_nodes is not None:
        both = graph.overlay_nodes.select("id", "name", "path").withColumn("overlay", F.lit(True)).union(base)
    order = (
        F.when((F.col("id") == handle) & F.col("overlay"), 1)
        .when(F.col("id") == handle, 2)
        .when((F.col("name") == handle) & F.col("overlay"), 3)
        .when(F.col("name") == handle, 4)
        .when((F.col("path") == handle) & ~F.col("overlay"), 5)
    )
    return both.withColumn("priority", order).where("priority is not null").orderBy("priority", "id").limit(1)


def resolve_many(graph: PropertyGraph, handles: DataFrame) -> DataFrame:
    """(handle, id, priority) for a table of handles, by the same order."""
    nodes = graph.nodes
    keys = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.col(c).alias("handle")) for p, c in ((2, "id"), (4, "name"), (5, "path"))])).alias("k"))
    keys = keys.select("id", "k.*")
    if graph.overlay_nodes is not None:
        over = graph.overlay_nodes.select("id", F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.col("id").alias("handle")), F.struct(F.lit(3).alias("priority"), F.col("name").alias("handle")))).alias("k"))
        keys = keys.union(over.select("id", "k.*"))
    found = handles.join(keys, "handle").groupBy("handle").agg(F.min(F.struct("priority", "id")).alias("best"))
    return found.select("handle", "best.id", "best.priority")


def at_lines(positions: DataFrame, nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """positions (path, line, keys...) with the id of the smallest symbol around each line.

    An equality on path keeps the range condition local to a file. The narrowest is an aggregate, so a file with a
    great many references is summed map-side.
    """
    spans = nodes.where("node_type <> 'File'").select("path", "id", F.coalesce("line_start", F.lit(0)).alias("a"), F.coalesce("line_end", F.lit(0)).alias("b"))
    inside = positions.join(spans, "path").where(F.col("line").between(F.col("a"), F.col("b")))
    best = inside.groupBy("path", "line", *keys).agg(F.min(F.struct((F.col("b") - F.col("a")).alias("span"), "id")).alias("best"))
    return best.select("path", "line", *keys, F.col("best.id").alias("id"))


def at_line(graph: PropertyGraph, path: str, line: int) -> DataFrame:
    """The same for one position; an overlay's symbol comes first."""
    position = graph.spark.createDataFrame([(path, line)], "path string, line int")
    if graph.overlay_nodes is not None:
        over = at_lines(position, graph.overlay_nodes, ())
        return over.union(at_lines(position, graph.nodes, ()).join(over.select("path"), "path", "left_anti"))
    return at_lines(position, graph.nodes, ())


def reference_edges(graph: PropertyGraph, references: DataFrame) -> DataFrame:
    """Edges from queried files to the symbols around the references found; references has file_id, path, line."""
    found = at_lines(references, graph.nodes, ("file_id",))
    return found.where("file_id <> id").select(F.lit("Uses").alias("edge_type"), F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.lit(None).cast("double").alias("weight")).distinct()


def resolve_static_refs(graph: PropertyGraph, refs: DataFrame) -> DataFrame:
    """Edges of refs (path, line, target_name, edge_type), from the symbol around each to all nodes of the name.

    No self edges; types are used only where they are types; of several edges between two nodes the first in the
    order of types stays.
    """
    return named_targets(graph, at_lines(refs.select("path", "line", "target_name", "edge_type").distinct(), graph.nodes, ("target_name", "edge_type")))


def named_targets(graph: PropertyGraph, sources: DataFrame) -> DataFrame:
    """Edges from nodes (id, target_name, edge_type) to all nodes of the name, by the rules of resolve_static_refs."""
    targets = graph.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("node_type").alias("target_type"))
    edges = sources.withColumnRenamed("id", "source_id").join(targets, "target_name").where("source_id <> target_id")
    edges = edges.where((F.col("edge_type") != "Uses") | F.col("target_type").isin(*TYPE_TARGETS))
    return edges.groupBy("source_id", "target_id").agg(F.min("edge_type").alias("edge_type")).withColumn("weight", F.lit(None).cast("double")).select(*EDGES.names)


def ghosts(graph: PropertyGraph, callers: DataFrame) -> DataFrame:
    """Functions that stand for unknown callers (path, line): not hydrated, so any real node replaces them."""
    unknown = callers.select("path", F.concat(F.lit("unknown:"), F.col("line")).alias("name")).distinct()
    made = unknown.select(node_id(F.lit("Function"), F.col("path"), F.col("name")).alias("id"), F.lit("Function").alias("node_type"), "name", "path", F.lit(False).alias("is_hydrated"))
    return made.join(graph.nodes.select("id"), "id", "left_anti")


def handlers(names: DataFrame, nodes: DataFrame, order: tuple[str, ...] = ("exact", "snake", "camel")) -> DataFrame:
    """(name, id): the node with a name, its snake-case or its camel-case form, in that order of preference."""
    forms = {"exact": F.col("name"), "snake": snake_case(F.col("name")), "camel": camel_case(F.col("name"))}
    keys = names.select("name").distinct().select("name", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), forms[k].alias("key")) for i, k in enumerate(order)])).alias("k")).select("name", "k.*")
    found = keys.join(nodes.select(F.col("name").alias("key"), "id"), "key").groupBy("name").agg(F.min(F.struct("rank", "id")).alias("best"))
    return found.select("name", "best.id")


def cross_runtime_callers(graph: PropertyGraph, node: str | None = None) -> DataFrame:
    """(target_id, section, id, name): who reaches a node over CallsHttp, Implements or Uses."""
    # fixed values: the sections' names
    section = F.create_map(*[F.lit(x) for pair in (("CallsHttp", "http"), ("Implements", "implements"), ("Uses", "uses")) for x in pair])
    edges = graph.edges.where(F.col("edge_type").isin("CallsHttp", "Implements", "Uses"))
    if node is not None:
        edges = edges.where(F.col("target_id") == node)
    return edges.join(graph.nodes.select(F.col("id").alias("source_id"), "name"), "source_id").select("target_id", section[F.col("edge_type")].alias("section"), F.col("source_id").alias("id"), "name")


def call_sites(graph: PropertyGraph, node: str) -> DataFrame:
    """Callers of a node, over Calls alone."""
    edges = graph.edges.where((F.col("edge_type") == "Calls") & (F.col("target_id") == node)).select(F.col("source_id").alias("id")).distinct()
    return edges.join(graph.nodes.select("id", "name", "path", "line_start"), "id")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key: the first in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
