"""A property graph from star-schema tables, for queries and benchmarks.

Regions and nations are namespaces, suppliers files, customers classes and parts functions in their supplier's file.
Orders are commits whose files are their parts, and large lines are calls from one part to the next of its order.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..runtime import drop_path, shared_folder
from . import storage

#: Where a session's graphs lie, by session, shared folder and folder of tables.
SAVED: dict[tuple[str, str, str], str] = {}
#: Seconds that stand for now in these tables.
NOW = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, s_suppkey): each part's one supplier, the least of those in its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    return lines.agg(F.min("l_suppkey").alias("s_suppkey"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    regions = t("region")
    nations = t("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("n_path", F.concat_ws("/", "r_name", "n_name"))
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("s_path", F.concat_ws("/", "n_path", "s_name"))
    null = F.lit(None)
    plain = {"line_start": null.cast("int"), "line_end": null.cast("int"), "signature": null.cast("string"), "docstring": null.cast("string"), "embedding": null.cast("array<float>"), "is_deprecated": F.lit(False), "last_lsp_sync": null.cast("bigint"), "last_git_sync": null.cast("bigint")}

    def shaped(df: DataFrame, kind: str, key: str, node_type: str, name, path, **more) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.lit(node_type).alias("node_type"), name.alias("name"), path.alias("path"), *[(more.get(c, v)).alias(c) for c, v in plain.items()])

    parts = t("part").join(owners(spark, sf_dir), "p_partkey", "left").join(suppliers.select("s_suppkey", "s_path"), "s_suppkey", "left")
    parts = parts.join(t("embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left")
    start = (F.col("p_partkey") % 50 * 10 + 1).cast("int")
    return (
        shaped(regions, "region", "r_regionkey", "Namespace", F.col("r_name"), F.col("r_name"))
        .union(shaped(nations, "nation", "n_nationkey", "Namespace", F.col("n_name"), F.col("n_path")))
        .union(shaped(suppliers, "supplier", "s_suppkey", "File", F.col("s_name"), F.col("s_path"), last_lsp_sync=NOW - F.col("s_suppkey") * 600, last_git_sync=F.when(F.col("s_acctbal") > 0, NOW - F.col("s_suppkey") * 900)))
        .union(shaped(t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "Class", F.col("c_name"), F.concat_ws("/", "n_path", "c_name")))
        .union(
            shaped(
                parts, "part", "p_partkey", "Function", F.concat(F.lit("part_"), F.col("p_partkey")), F.coalesce("s_path", F.lit("")), line_start=start, line_end=start + F.col("p_size"),
                signature=F.concat(F.lit("fn make("), F.col("p_type"), F.lit(") -> "), F.col("p_brand")), docstring=F.col("p_name"), embedding=F.col("embedding").cast("array<float>"), is_deprecated=F.col("p_size") > 45,
            )
        )
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def shaped(df: DataFrame, edge_type, source, target) -> DataFrame:
        return df.select((F.lit(edge_type) if isinstance(edge_type, str) else edge_type).alias("edge_type"), source.alias("source_id"), target.alias("target_id"), F.lit(None).cast("double").alias("weight"))

    contains = (
        shaped(t("nation"), "Contains", _id("region", "n_regionkey"), _id("nation", "n_nationkey"))
        .union(shaped(t("supplier"), "Contains", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")))
        .union(shaped(t("customer"), "Contains", _id("nation", "c_nationkey"), _id("customer", "c_custkey")))
        .union(shaped(owners(spark, sf_dir), "Contains", _id("supplier", "s_suppkey"), _id("part", "p_partkey")))
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    called = t("lineitem").where("l_quantity >= 48").withColumn("next", F.lead("l_partkey").over(w)).where("next <> l_partkey")
    calls = shaped(called, "Calls", _id("part", "l_partkey"), _id("part", "next"))
    # lines with the greatest quantity and discount tie a part to its customer, in a way that their flag names
    large = t("lineitem").where("l_quantity >= 49 and l_discount >= 0.09").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").distinct()
    way = F.when(F.col("l_returnflag") == "R", "CallsHttp").when(F.col("l_returnflag") == "A", "Implements").otherwise("Uses")
    served = shaped(large, way, _id("part", "l_partkey"), _id("customer", "o_custkey")).distinct()
    return contains.union(calls).union(served)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, message, files, time): orders with their distinct parts."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(_id("part", "l_partkey"))).alias("files"))
    orders = table(spark, sf_dir, "orders").join(files, "o_orderkey", "left")
    return orders.select(_id("order", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("message"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"))


def stored(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph as a saved copy, made once a session: partitioned by type and sorted by id, so that lookups prune files."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir)
    if key not in SAVED:
        path = f"{shared_folder(spark)}/graphloom/graph-{uuid.uuid4().hex}"
        atexit.register(drop_path, spark, path)
        storage.save(PropertyGraph.of(nodes(spark, sf_dir), edges(spark, sf_dir)), path)
        SAVED[key] = path
    return storage.load(spark, SAVED[key])


def graph(spark: SparkSession, sf_dir: str, co_changes: bool = False) -> PropertyGraph:
    """The graph; with co_changes also CoChangedWith edges between parts of two or more common orders."""
    from ..operators.cochange import cochange_pairs

    g = stored(spark, sf_dir)
    e = g.edges
    if co_changes:
        pairs = cochange_pairs(commits(spark, sf_dir), None)
        e = e.union(pairs.select(F.lit("CoChangedWith"), "file1", "file2", F.col("co_change_count").cast("double")))
    return PropertyGraph.of(g.nodes, e)


def pattern_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, file, dir): trimmed lines of documents of three characters or more; a source is a directory."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("value"), F.col("doc_id").alias("file"), F.col("source").alias("dir"))
    return lines.withColumn("value", F.trim("value")).where(F.length("value") >= 3)


#: The same graph in DuckDB's SQL, as common table expressions after WITH RECURSIVE.
SQL = f"""
owners AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_partkey),
nations AS (SELECT n.*, r_name || '/' || n_name AS n_path FROM nation n JOIN region ON n_regionkey = r_regionkey),
suppliers AS (SELECT s.*, n_path || '/' || s_name AS s_path FROM supplier s JOIN nations ON s_nationkey = n_nationkey),
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Namespace' AS node_type, r_name AS name, r_name AS path, NULL::INT AS line_start, NULL::INT AS line_end,
    NULL::VARCHAR AS signature, NULL::VARCHAR AS docstring, NULL::FLOAT[] AS embedding, false AS is_deprecated, NULL::BIGINT AS last_lsp_sync, NULL::BIGINT AS last_git_sync FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Namespace', n_name, n_path, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL FROM nations
  UNION ALL SELECT 'supplier:' || s_suppkey, 'File', s_name, s_path, NULL, NULL, NULL, NULL, NULL, false, {NOW} - s_suppkey * 600, CASE WHEN s_acctbal > 0 THEN {NOW} - s_suppkey * 900 END FROM suppliers
  UNION ALL SELECT 'customer:' || c_custkey, 'Class', c_name, n_path || '/' || c_name, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL FROM customer JOIN nations ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p.p_partkey, 'Function', 'part_' || p.p_partkey, coalesce(s_path, ''), (p.p_partkey % 50 * 10 + 1)::INT, (p.p_partkey % 50 * 10 + 1 + p_size)::INT,
    'fn make(' || p_type || ') -> ' || p_brand, p_name, e.embedding, p_size > 45, NULL, NULL
    FROM part p LEFT JOIN owners o ON p.p_partkey = o.p_partkey LEFT JOIN suppliers s ON o.s_suppkey = s.s_suppkey LEFT JOIN embeddings e ON e.vec_id = p.p_partkey
),
called AS (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next FROM lineitem WHERE l_quantity >= 48),
edges AS (
  SELECT 'Contains' AS edge_type, 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id FROM nation
  UNION ALL SELECT 'Contains', 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'Contains', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'Contains', 'supplier:' || s_suppkey, 'part:' || p_partkey FROM owners
  UNION ALL SELECT 'Calls', 'part:' || l_partkey, 'part:' || next FROM called WHERE next <> l_partkey
  UNION ALL SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 'CallsHttp' WHEN 'A' THEN 'Implements' ELSE 'Uses' END, 'part:' || l_partkey, 'customer:' || o_custkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND l_discount >= 0.09
),
shown AS (SELECT id, node_type AS type, name, CASE WHEN is_deprecated THEN 'deprecated' END AS label, path FROM nodes),
fan AS (
  SELECT n.id, (SELECT count(*) FROM edges e WHERE e.target_id = n.id) AS fan_in, (SELECT count(*) FROM edges e WHERE e.source_id = n.id) AS fan_out FROM nodes n
),
scored AS (SELECT n.*, fan_in, fan_out, fan_in / (fan_out + 1.0::DOUBLE) AS anchor_score FROM nodes n JOIN fan USING (id)),
commit_files AS (SELECT DISTINCT 'order:' || l_orderkey AS id, 'part:' || l_partkey AS file FROM lineitem),
co_pairs AS (
  SELECT a.file AS file1, b.file AS file2, count(*) AS n FROM commit_files a JOIN commit_files b ON a.id = b.id AND a.file < b.file
  WHERE a.id NOT IN (SELECT id FROM commit_files GROUP BY id HAVING count(*) > 100) GROUP BY 1, 2
)
"""
