"""Small graphs for tests."""

from pyspark.sql import SparkSession

from graphloom.graph import PropertyGraph

FUNCTIONS = ("main", "a", "b", "c", "x", "y")
CALLS = (("main", "a"), ("a", "b"), ("b", "c"), ("main", "x"), ("x", "b"))


def small(spark: SparkSession) -> PropertyGraph:
    """Six functions, y alone, and a file that contains main."""
    nodes = [(f, "Function", f, f"/src/{f}.rs", 1, 10, f == "c") for f in FUNCTIONS] + [("file", "File", "main.rs", "/src/main.rs", None, None, False)]
    edges = [("Calls", a, b) for a, b in CALLS] + [("Contains", "file", "main")]
    return PropertyGraph.of(
        spark.createDataFrame(nodes, "id string, node_type string, name string, path string, line_start int, line_end int, is_deprecated boolean"),
        spark.createDataFrame(edges, "edge_type string, source_id string, target_id string"),
    )


def ids(df) -> set[str]:
    return {r["id"] for r in df.select("id").collect()}
