"""All registered queries of the graph engine, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .graph import PropertyGraph
from .operators import architecture, cochange, diagnostics, dml, impact, metrics, patterns, resolve, semantic, traverse
from .plans.named import describe_schema
from .plans.ops import Executor
from .sources import difftext, extract, project, sensors, tables
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
G = f"WITH RECURSIVE {tables.SQL}"
ALL = "edge_type IS NOT NULL"


def longs(df: DataFrame) -> DataFrame:
    """df with 64-bit integers, as the SQL has them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def spec(name: str, ops: list[dict], sql: str, **more) -> None:
    """A query of the query language; its rows are nodes."""
    query(name, sql)(lambda spark, sf_dir: Executor(tables.graph(spark, sf_dir)).run({"ops": ops, **more}).nodes)


def where(condition: str, more: str = "", tail: str = "") -> str:
    return f"{G}{more} SELECT id, type, name, label FROM shown WHERE {condition}{tail}"


def walk(starts: str, edges: str, least: int, most: int, reverse: bool = False, name: str = "walk") -> str:
    """Nodes at a shortest distance from least to most of some start."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return f""", {name}_steps AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE {edges}),
{name}_all AS (SELECT b AS id, 1 AS depth FROM {name}_steps WHERE a IN ({starts})
  UNION SELECT s.b, w.depth + 1 FROM {name}_all w JOIN {name}_steps s ON s.a = w.id WHERE w.depth < {most}),
{name} AS (SELECT id, min(depth) AS depth FROM {name}_all GROUP BY id HAVING min(depth) >= {least})"""


FUNCTIONS = "SELECT id FROM nodes WHERE node_type = 'Function'"
CALLS = "edge_type = 'Calls'"
find = lambda **k: {"op": "find", **k}
connect = lambda edge, **k: {"op": "connect", "edge": edge, **k}

# the query language: selection
spec("find_type", [find(type="File")], where("type = 'File'"))
spec("find_type_list", [find(type=["File", "Class"])], where("type IN ('File', 'Class')"))
spec("find_name_exact", [find(name="part_7")], where("name = 'part_7'"))
spec("find_name_glob", [find(name={"glob": "part_1?"})], where("regexp_full_match(name, 'part_1.')"))
spec("find_name_prefix", [find(name={"starts_with": "part_1"})], where("starts_with(name, 'part_1')"))
spec("find_name_suffix", [find(type="Function", name={"endsWith": "9"})], where("type = 'Function' AND suffix(name, '9')"))
spec("find_label", [find(label="deprecated")], where("label = 'deprecated'"))
spec("find_label_not", [find(type="Function", label={"not": ["deprecated"]})], where("type = 'Function' AND label IS DISTINCT FROM 'deprecated'"))
spec("find_path", [find(path="ASIA")], where("contains(path, 'ASIA')"))
spec("find_id", [find(id="nation:3")], where("id = 'nation:3'"))
spec("filter_chain", [find(), {"op": "filter", "type": ["Function", "File"]}, {"op": "filter", "name": {"starts_with": "part_2"}}, {"op": "filter", "label": "deprecated"}], where("type IN ('Function', 'File') AND starts_with(name, 'part_2') AND label = 'deprecated'"))

# the query language: traversal
spec("connect_out_1", [find(type="Function"), connect("Calls")], where("id IN (SELECT id FROM walk)", walk(FUNCTIONS, CALLS, 1, 1)))
spec("connect_in_1", [find(type="Function"), connect("Calls", direction="incoming")], where("id IN (SELECT id FROM walk)", walk(FUNCTIONS, CALLS, 1, 1, True)))
spec("connect_both_1", [find(label="deprecated"), connect("Calls", direction="both")], where("id IN (SELECT id FROM walk UNION SELECT id FROM back)", walk("SELECT id FROM shown WHERE label = 'deprecated'", CALLS, 1, 1) + walk("SELECT id FROM shown WHERE label = 'deprecated'", CALLS, 1, 1, True, "back")))
spec("connect_1_2", [find(type="Namespace", name="ASIA"), connect("Contains", depth={"min": 1, "max": 2})], where("id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes WHERE name = 'ASIA'", "edge_type = 'Contains'", 1, 2)))
spec("connect_depth_3", [find(name="ASIA"), connect("Contains", depth=3)], where("id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes WHERE name = 'ASIA'", "edge_type = 'Contains'", 3, 3)))
spec("connect_edge_or", [find(type="Function"), connect(["Uses", "CallsHttp"])], where("id IN (SELECT id FROM walk)", walk(FUNCTIONS, "edge_type IN ('Uses', 'CallsHttp')", 1, 1)))
spec("connect_edge_not", [find(type="Function"), connect({"not": ["Calls", "Contains"]})], where("id IN (SELECT id FROM walk)", walk(FUNCTIONS, "edge_type NOT IN ('Calls', 'Contains')", 1, 1)))
spec("connect_target", [find(type="File"), connect("Contains", target={"type": "Function", "label": "deprecated"})], where("label = 'deprecated' AND type = 'Function' AND id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes WHERE node_type = 'File'", "edge_type = 'Contains'", 1, 1)))
spec("flagship", [find(type="Function"), connect("Calls", depth={"min": 1, "max": 2}), {"op": "sort", "by": "name"}, {"op": "limit", "count": 20}], where("id IN (SELECT id FROM walk)", walk(FUNCTIONS, CALLS, 1, 2), " ORDER BY name, id LIMIT 20"))

# the query language: order, limits, groups
spec("sort_name_asc", [find(type="Namespace"), {"op": "sort", "by": "name"}, {"op": "limit", "count": 7}], where("type = 'Namespace'", tail=" ORDER BY name, id LIMIT 7"))
spec("sort_name_desc", [find(type="Namespace"), {"op": "sort", "by": "name", "direction": "desc"}, {"op": "limit", "count": 7}], where("type = 'Namespace'", tail=" ORDER BY name DESC, id LIMIT 7"))
spec("sort_label_nulls", [find(type="Function"), {"op": "sort", "by": "label"}, {"op": "limit", "count": 30}], where("type = 'Function'", tail=" ORDER BY label ASC NULLS FIRST, id LIMIT 30"))
spec("sort_label_desc", [find(type="Function"), {"op": "sort", "by": "label", "direction": "desc"}, {"op": "limit", "count": 30}], where("type = 'Function'", tail=" ORDER BY label DESC NULLS LAST, id LIMIT 30"))
spec("limit_offset", [find(type="File"), {"op": "sort", "by": "name"}, {"op": "limit", "count": 5, "offset": 3}], where("type = 'File'", tail=" ORDER BY name, id LIMIT 5 OFFSET 3"))
for _by in ("type", "label", "name"):

    def _group(spark: SparkSession, sf_dir: str, by: str = _by) -> DataFrame:
        found = Executor(tables.graph(spark, sf_dir)).run({"ops": [find(), {"op": "group", "by": by}]}).groups
        return found.select("key", "count", F.get("nodes", 0)["id"].alias("first_id"))

    query(f"group_{_by}", f"{G} SELECT coalesce({_by}, '') AS key, count(*) AS count, min(id) AS first_id FROM shown GROUP BY 1")(_group)

# named queries
NAMED_SQL = {
    "get_callers": where("id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes", CALLS, 1, 1, True)),
    "get_callees": where("id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes", CALLS, 1, 1)),
    "get_blast_radius": where("id IN (SELECT id FROM back)", walk("SELECT id FROM nodes", CALLS, 1, 2) + walk("SELECT id FROM walk", CALLS, 1, 2, True, "back")),
    "get_call_chain": where("id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes", CALLS, 1, 10)),
    "get_file_functions": where("type = 'Function' AND id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes WHERE node_type = 'File'", "edge_type = 'Contains'", 1, 1)),
    "get_deprecated_functions": where("type = 'Function' AND label = 'deprecated'"),
    "get_function_imports": where("id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes WHERE node_type = 'Function'", "edge_type = 'Uses'", 1, 1)),
    "get_test_coverage": where("false"),
    "get_module_functions": where("type = 'Function' AND id IN (SELECT id FROM walk)", walk("SELECT id FROM nodes WHERE node_type = 'Module'", "edge_type = 'Contains'", 1, 2)).replace("node_type = 'Module'", "starts_with(id, 'nation:')"),
}


def with_modules(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph whose nations are modules and whose uses are imports, for the queries that ask for those."""
    g = tables.graph(spark, sf_dir)
    nodes = g.nodes.withColumn("node_type", F.when(F.col("id").startswith("nation:"), "Module").otherwise(F.col("node_type")))
    return PropertyGraph.of(nodes, g.edges.withColumn("edge_type", F.when(F.col("edge_type") == "Uses", "Imports").otherwise(F.col("edge_type"))))


for _name, _sql in NAMED_SQL.items():
    _graph = with_modules if _name in ("get_function_imports", "get_module_functions") else tables.graph
    query(f"named_{_name}", _sql)(lambda spark, sf_dir, name=_name, graph=_graph: Executor(graph(spark, sf_dir)).run({"named": name}).nodes)


@query("describe_schema")
def _(spark, sf_dir):
    return describe_schema(spark)


@query("semantic_filter", f"{G}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT s.id, type, s.name, label FROM shown s JOIN nodes n ON s.id = n.id, q WHERE s.type = 'Function' AND list_cosine_similarity(n.embedding::DOUBLE[], v) > 0.2")
def _(spark, sf_dir):
    vector = first_vector(spark, sf_dir)
    return Executor(tables.graph(spark, sf_dir), embed=lambda text: vector, on_demand=False).run({"ops": [find(type="Function"), {"op": "semantic_filter", "like": "the first vector", "threshold": 0.2}]}).nodes


# a model that SQL can say: one axis for each length of a text
LENGTH = 16


def by_length(texts: list[str]) -> list[list[float]]:
    return [[1.0 if i == len(t) % 64 else 0.0 for i in range(64)] for t in texts]


@query(
    "semantic_filter_on_demand",
    f"{G}, q AS (SELECT [CASE WHEN x = {LENGTH} THEN 1.0 ELSE 0.0 END FOR x IN range(64)]::DOUBLE[] AS v), made AS (SELECT id, embedding::DOUBLE[] AS e, length(concat_ws(' | ', nullif(name, ''), nullif(signature, ''), nullif(docstring, ''), nullif(path, ''))) % 64 AS l FROM nodes) SELECT s.id, type, s.name, label FROM shown s JOIN made m ON s.id = m.id, q WHERE CASE WHEN e IS NULL THEN l = {LENGTH} ELSE list_cosine_similarity(e, v) > 0.2 END",
)
def _(spark, sf_dir):
    ops = [find(), {"op": "semantic_filter", "like": "x" * LENGTH, "threshold": 0.2}]
    return Executor(tables.graph(spark, sf_dir), embed=lambda text: by_length([text])[0], model=by_length).run({"ops": ops}).nodes


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in tables.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


# degrees and ranking
@query("degree_anchor", f"{G} SELECT id, fan_in, fan_out, round(anchor_score, 6) AS anchor_score FROM scored")
def _(spark, sf_dir):
    return scored(spark, sf_dir).nodes.select("id", "fan_in", "fan_out", F.round("anchor_score", 6).alias("anchor_score"))


def scored(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return metrics.enrich(tables.graph(spark, sf_dir))


@query("graph_stats", f"{G} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def _(spark, sf_dir):
    return tables.graph(spark, sf_dir).stats()


@query("top_anchors", f"{G} SELECT id, name, node_type, round(anchor_score, 6) AS anchor_score FROM scored ORDER BY scored.anchor_score DESC, id LIMIT 10")
def _(spark, sf_dir):
    return metrics.top_anchors(scored(spark, sf_dir)).withColumn("anchor_score", F.round("anchor_score", 6))


@query("explore_architecture", f"{G} SELECT id, name, path, round(anchor_score, 6) AS anchor_score FROM scored WHERE node_type = 'File' ORDER BY scored.anchor_score DESC, id LIMIT 20")
def _(spark, sf_dir):
    return metrics.explore_architecture(scored(spark, sf_dir)).select("id", "name", "path", F.round("anchor_score", 6).alias("anchor_score"))


@query("hybrid_search", f"{G}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), sims AS (SELECT id, name, list_cosine_similarity(embedding::DOUBLE[], v) AS s, anchor_score FROM scored, q WHERE embedding IS NOT NULL AND node_type IN ('File', 'Class', 'Function', 'Struct', 'Trait')) SELECT id, name, round(s, 6) AS similarity, round(s + 0.3 * anchor_score, 6) AS score FROM sims WHERE s > 0.1 ORDER BY score DESC, id LIMIT 10")
def _(spark, sf_dir):
    return semantic.semantic_search(scored(spark, sf_dir), first_vector(spark, sf_dir), threshold=0.1)


@query("dead_code", f"{G} SELECT id, name, path FROM scored WHERE node_type = 'Function' AND fan_in = 1 AND fan_out = 0 AND NOT contains(path, 'trait') ORDER BY id LIMIT 20")
def _(spark, sf_dir):
    # every part is contained in a file, so containment doesn't count as a reference here
    g = tables.graph(spark, sf_dir)
    return metrics.dead_code(metrics.enrich(PropertyGraph(g.nodes, g.edges.where("edge_type <> 'Contains'"))))


@query("untested", f"{G}, called_ids AS (SELECT DISTINCT target_id FROM edges WHERE edge_type = 'Calls'), free AS (SELECT id, name, path FROM nodes WHERE node_type = 'Function' AND id NOT IN (SELECT target_id FROM called_ids)) SELECT id, name, path, (SELECT count(*) FROM free) AS total FROM free ORDER BY id LIMIT 20")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return metrics.untested(metrics.enrich(PropertyGraph(g.nodes, g.edges.where("edge_type = 'Calls'"))))


COVERAGE = "round(CASE WHEN count(*) = 0 THEN 100.0 ELSE 100.0 * (count(*) - count(*) FILTER (n = 0)) / count(*) END, 4)::DOUBLE"
CALLED = f"{G}, c AS (SELECT n.*, (SELECT count(*) FROM edges e WHERE e.target_id = n.id AND edge_type = 'Calls') AS n FROM nodes n WHERE node_type = 'Function')"


@query("coverage_summary", f"{CALLED} SELECT count(*) AS total, count(*) FILTER (n = 0) AS untested, {COVERAGE} AS pct, CASE WHEN {COVERAGE} < 70 THEN 'low' WHEN {COVERAGE} >= 90 THEN 'high' ELSE 'medium' END AS band FROM c WHERE contains(path, 'ASIA')")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return metrics.coverage(metrics.enrich(PropertyGraph(g.nodes, g.edges.where("edge_type = 'Calls'"))), "ASIA")


@query("coverage_by_module", f"{CALLED} SELECT string_split(path, '/')[1] AS key, count(*) AS total, count(*) FILTER (n = 0) AS untested, {COVERAGE} AS pct, CASE WHEN {COVERAGE} < 70 THEN 'low' WHEN {COVERAGE} >= 90 THEN 'high' ELSE 'medium' END AS band FROM c GROUP BY 1")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    g = metrics.enrich(PropertyGraph(g.nodes, g.edges.where("edge_type = 'Calls'")))
    return metrics.coverage_by(g, F.substring_index("path", "/", 1))


CO = """, partners AS (SELECT id, count(DISTINCT other) AS n FROM (SELECT file1 AS id, file2 AS other FROM co_pairs WHERE n >= 2 UNION ALL SELECT file2, file1 FROM co_pairs WHERE n >= 2) GROUP BY id),
co_fan AS (SELECT f.id, fan_in + (SELECT count(*) FROM co_pairs p WHERE p.n >= 2 AND p.file2 = f.id) AS i, fan_out + (SELECT count(*) FROM co_pairs p WHERE p.n >= 2 AND p.file1 = f.id) AS o FROM fan f),
debts AS (SELECT n.id, n.name, i, o, coalesce(p.n, 0) AS co, i / (o + 1.0::DOUBLE) AS anchor FROM nodes n JOIN co_fan USING (id) LEFT JOIN partners p ON p.id = n.id)"""


@query("refactor_targets", f"{G}{CO} SELECT id, name, round(i * o + co / (anchor + 0.1::DOUBLE), 6) AS debt, array_to_string(list_filter([CASE WHEN i > 10 AND o > 10 THEN 'coupled' END, CASE WHEN co > 5 AND anchor < 0.2 THEN 'volatile' END, CASE WHEN o > 20 THEN 'sprawling' END], lambda x: x IS NOT NULL), ',') AS flags FROM debts WHERE (i > 10 AND o > 10) OR (co > 5 AND anchor < 0.2) OR o > 20 ORDER BY debt DESC, id LIMIT 5")
def _(spark, sf_dir):
    return metrics.refactor_targets(metrics.enrich(tables.graph(spark, sf_dir, co_changes=True)))


# co-change
@query("cochange_pairs", f"{G} SELECT file1, file2, n AS co_change_count FROM co_pairs WHERE n >= 2")
def _(spark, sf_dir):
    return cochange.cochange_pairs(tables.commits(spark, sf_dir), None)


@query("cochange_window", f"{G}, recent AS (SELECT 'order:' || o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, 'order:' || o_orderkey LIMIT 100) SELECT a.file AS file1, b.file AS file2, count(*) AS co_change_count FROM commit_files a JOIN commit_files b ON a.id = b.id AND a.file < b.file WHERE a.id IN (SELECT id FROM recent) GROUP BY 1, 2")
def _(spark, sf_dir):
    return cochange.cochange_pairs(tables.commits(spark, sf_dir), least=1)


PART = "part:7"
PARTNERS = "SELECT other AS id, max(n)::DOUBLE AS weight FROM (SELECT file2 AS other, n FROM co_pairs WHERE n >= 2 AND file1 = '{0}' UNION ALL SELECT file1, n FROM co_pairs WHERE n >= 2 AND file2 = '{0}') GROUP BY 1"


@query("cochange_partners", f"{G} {PARTNERS.format(PART)}")
def _(spark, sf_dir):
    return cochange.partners(tables.graph(spark, sf_dir, co_changes=True), PART)


ANY_PARTNERS = PARTNERS.replace("n >= 2", "n >= 1")


@query("shared_partners", f"{G} SELECT id FROM ({ANY_PARTNERS.format('part:7')}) JOIN ({ANY_PARTNERS.format('part:8')}) USING (id)")
def _(spark, sf_dir):
    pairs = cochange.cochange_pairs(tables.commits(spark, sf_dir), None, least=1)
    edges = pairs.select(F.lit("CoChangedWith").alias("edge_type"), F.col("file1").alias("source_id"), F.col("file2").alias("target_id"), F.col("co_change_count").cast("double").alias("weight"))
    return cochange.shared_partners(PropertyGraph.of(tables.nodes(spark, sf_dir), edges), "part:7", "part:8")


@query("commits_since", "SELECT 'order:' || o.o_orderkey AS id, epoch(o.o_orderdate)::BIGINT AS time FROM orders o, (SELECT * FROM orders ORDER BY o_orderdate DESC, 'order:' || o_orderkey LIMIT 1 OFFSET 50) c WHERE o.o_orderdate > c.o_orderdate OR (o.o_orderdate = c.o_orderdate AND 'order:' || o.o_orderkey < 'order:' || c.o_orderkey)")
def _(spark, sf_dir):
    commits = tables.commits(spark, sf_dir)
    at = commits.orderBy(F.desc("time"), "id").offset(50).limit(1).first()["id"]
    return cochange.since(commits, at).select("id", "time")


@query("commit_history", "SELECT 'order:' || o_orderkey AS id, o_orderpriority AS message, epoch(o_orderdate)::BIGINT AS time FROM orders ORDER BY o_orderdate DESC, id LIMIT 20")
def _(spark, sf_dir):
    return cochange.recent(tables.commits(spark, sf_dir)).select("id", "message", "time")


# patterns
REFS = "WITH refs AS (SELECT DISTINCT trim(line) AS value, doc_id AS file, source AS dir FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) >= 3), good AS (SELECT value, count(DISTINCT file) AS files, count(DISTINCT dir) AS dirs, (count(DISTINCT dir) * (count(DISTINCT dir) - 1) / 2)::BIGINT AS score FROM refs GROUP BY value HAVING count(DISTINCT file) BETWEEN 2 AND 20 AND count(DISTINCT dir) >= 2)"
EDGES_SQL = f"{REFS}, firsts AS (SELECT value, score, dir, min(file) AS file FROM refs JOIN good USING (value) GROUP BY 1, 2, 3), best AS (SELECT a.value, a.file AS source, b.file AS target, a.score, a.dir AS dir_a, b.dir AS dir_b FROM firsts a JOIN firsts b ON a.value = b.value AND a.dir < b.dir ORDER BY a.score DESC, a.value, a.dir, b.dir LIMIT 200)"


@query("pattern_scores", f"{REFS} SELECT value, files, dirs, score FROM good")
def _(spark, sf_dir):
    return patterns.scored(tables.pattern_refs(spark, sf_dir))


@query("pattern_edges", f"{EDGES_SQL} SELECT value, source, target, score FROM best")
def _(spark, sf_dir):
    return patterns.pattern_edges(tables.pattern_refs(spark, sf_dir))


@query("boundary_pairs", f"{EDGES_SQL} SELECT dir_a || ' <-> ' || dir_b AS pair, count(*) AS n FROM best GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, pair LIMIT 10")
def _(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    found = patterns.pattern_edges(tables.pattern_refs(spark, sf_dir))
    named = found.join(docs.withColumnsRenamed({"doc_id": "source_doc", "source": "dir_a"}), F.col("source") == F.col("source_doc")).join(docs.withColumnsRenamed({"doc_id": "target_doc", "source": "dir_b"}), F.col("target") == F.col("target_doc"))
    return patterns.boundary_pairs(named.select("dir_a", "dir_b"))


@query("high_fan_out", f"{G}, out_edges AS (SELECT source_id, count(*) FILTER (edge_type <> 'Contains') AS fan_out, count(DISTINCT regexp_extract(t.path, '^(.*)/[^/]*$', 1)) AS domains FROM edges JOIN nodes t ON target_id = t.id GROUP BY 1) SELECT id AS source_id, name, fan_out, domains FROM out_edges JOIN nodes ON id = source_id WHERE node_type = 'Function' AND fan_out >= 3 ORDER BY fan_out DESC, source_id LIMIT 15")
def _(spark, sf_dir):
    # functions play the files here, since only they have edges besides Contains
    g = tables.graph(spark, sf_dir)
    files = g.nodes.withColumn("node_type", F.when(F.col("node_type") == "Function", "File").otherwise(F.col("node_type")))
    files = files.withColumn("node_type", F.when(F.col("id").startswith("part:"), "File").otherwise(F.lit("Namespace")))
    return patterns.high_fan_out(PropertyGraph(files, g.edges), 3).select("source_id", "name", "fan_out", "domains")


# traversal
CALLEE = f"(SELECT min(target_id) FROM edges WHERE {CALLS})"
CALLER = f"(SELECT min(source_id) FROM edges WHERE {CALLS})"


def a_callee(g: PropertyGraph) -> str:
    return g.edges.where(CALLS).agg(F.min("target_id")).first()[0]


def a_caller(g: PropertyGraph) -> str:
    return g.edges.where(CALLS).agg(F.min("source_id")).first()[0]


@query("blast_radius", f"{G}{walk(f'SELECT {CALLEE}', ALL, 1, 40, True)} SELECT id, (depth - 1)::BIGINT AS depth, depth = 1 AS is_direct FROM walk WHERE id <> {CALLEE}")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return traverse.blast_radius(g, a_callee(g))


@query("blast_confidence", f"{G}{walk(f'SELECT {CALLEE}', ALL, 1, 40, True)} SELECT count(*) AS total, CASE WHEN count(*) = 0 THEN 100 ELSE floor(100 * count(*) FILTER (coalesce(last_lsp_sync, 0) > 0) / count(*)) END::BIGINT AS confidence FROM walk JOIN nodes USING (id) WHERE id <> {CALLEE}")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return impact.confidence(g, a_callee(g))


@query("trace_dependency", f"{G}{walk(f'SELECT {CALLER}', ALL, 1, 40)} SELECT {CALLER} AS id, 0::BIGINT AS depth UNION ALL SELECT id, depth::BIGINT FROM walk WHERE id <> {CALLER}")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return traverse.trace_dependency(g, a_caller(g))


@query("call_chain", f"""{G}, steps AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges), goal AS (SELECT min(id) AS g FROM nodes WHERE node_type = 'Class'),
paths AS (SELECT 'region:' || r_regionkey AS cur, ['region:' || r_regionkey] AS path FROM region WHERE r_regionkey = (SELECT n_regionkey FROM goal, customer JOIN nation ON c_nationkey = n_nationkey WHERE 'customer:' || c_custkey = g)
  UNION ALL SELECT b, list_append(path, b) FROM paths JOIN steps ON a = cur WHERE len(path) < 4),
best AS (SELECT path FROM paths, goal WHERE cur = g ORDER BY len(path), path LIMIT 1)
SELECT (i - 1)::BIGINT AS position, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM best)""")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    goal = g.nodes.where("node_type = 'Class'").agg(F.min("id")).first()[0]
    nation = g.edges.where(F.col("target_id") == goal).where("edge_type = 'Contains'").first()["source_id"]
    region = g.edges.where(F.col("target_id") == nation).first()["source_id"]
    return traverse.call_chain(g, region, goal)


@query("nearest_anchor", f"{G}{walk(f'SELECT {CALLER}', ALL, 1, 40)}, met AS (SELECT {CALLER} AS id, 0 AS depth UNION ALL SELECT id, depth FROM walk WHERE id <> {CALLER}) SELECT id, name, path, round(anchor_score, 6) AS anchor_score, depth::BIGINT AS depth FROM met JOIN scored USING (id) ORDER BY scored.anchor_score DESC, depth, id LIMIT 1")
def _(spark, sf_dir):
    g = scored(spark, sf_dir)
    return traverse.navigate_to_anchor(g, a_caller(g)).withColumn("anchor_score", F.round("anchor_score", 6))


LAYERS = walk("SELECT id FROM nodes WHERE name IN ('ASIA', 'EUROPE')", "edge_type = 'Contains'", 1, 49) + ", layers AS (SELECT id, 0 AS depth FROM nodes WHERE name IN ('ASIA', 'EUROPE') UNION ALL SELECT id, depth FROM walk WHERE id NOT IN (SELECT id FROM nodes WHERE name IN ('ASIA', 'EUROPE')))"


@query("depth_layers", f"{G}{LAYERS} SELECT id, depth::BIGINT AS depth FROM layers")
def _(spark, sf_dir):
    return traverse.depth_from(tables.graph(spark, sf_dir), ("ASIA", "EUROPE"))


@query("layered_map", f"{G}{LAYERS} SELECT id, node_type, name, path FROM layers JOIN nodes USING (id) WHERE depth = 2 AND node_type IN ('File', 'Namespace', 'Class', 'Function')")
def _(spark, sf_dir):
    return traverse.layered_map(metrics.enrich(tables.graph(spark, sf_dir), ("ASIA", "EUROPE")), 2)


@query("layered_map_modules", f"{G}{LAYERS} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM layers JOIN nodes USING (id) WHERE depth = 3 AND node_type IN ('File', 'Class', 'Function')")
def _(spark, sf_dir):
    return traverse.layered_map(metrics.enrich(tables.graph(spark, sf_dir), ("ASIA", "EUROPE")), 3, "module")


# overlay: suppliers of even keys have been edited, and one more file is new
OVER = ", over AS (SELECT id, node_type, name || '*' AS name, path FROM nodes WHERE node_type = 'File' AND substr(id, 10)::BIGINT % 2 = 0 UNION ALL SELECT 'supplier:new', 'File', 'new', 'new')"
OVER_EDGES = ", over_edges AS (SELECT 'Contains' AS edge_type, source_id, target_id FROM edges WHERE edge_type = 'Contains' AND starts_with(source_id, 'supplier:') AND substr(source_id, 10)::BIGINT % 4 = 0 AND substr(target_id, 6)::BIGINT % 2 = 0)"


def edited(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    g = tables.graph(spark, sf_dir)
    key = F.expr("try_cast(substring(id, 10) as bigint)")
    files = g.nodes.where("node_type = 'File'").where(key % 2 == 0).select("id", "node_type", F.concat("name", F.lit("*")).alias("name"), "path")
    files = files.union(spark.createDataFrame([("supplier:new", "File", "new", "new")], files.schema))
    e = g.edges.where("edge_type = 'Contains' and startswith(source_id, 'supplier:')").where("try_cast(substring(source_id, 10) as bigint) % 4 = 0 and try_cast(substring(target_id, 6) as bigint) % 2 = 0")
    return g.with_overlay(files, e)


@query("overlay_merge", f"{G}{OVER} SELECT id, name, node_type FROM over UNION ALL SELECT id, name, node_type FROM nodes WHERE id NOT IN (SELECT id FROM over)")
def _(spark, sf_dir):
    return edited(spark, sf_dir).merged().nodes.select("id", "name", "node_type")


@query("overlay_base_first", f"{G}{OVER} SELECT id, name FROM nodes UNION ALL SELECT id, name FROM over WHERE id NOT IN (SELECT id FROM nodes)")
def _(spark, sf_dir):
    return edited(spark, sf_dir).base_first().select("id", "name")


@query("edge_masking", f"{G}{OVER_EDGES}, b AS (SELECT source_id AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS n FROM over_edges GROUP BY 1) SELECT id, coalesce(o.n, b.n) AS n FROM b FULL JOIN o USING (id)")
def _(spark, sf_dir):
    return architecture.out_degrees(edited(spark, sf_dir))


@query("edge_union", f"{G}{OVER_EDGES} SELECT source_id, target_id FROM edges UNION SELECT source_id, target_id FROM over_edges")
def _(spark, sf_dir):
    return architecture.targets(edited(spark, sf_dir))


@query("staleness", f"""{G}{OVER}, files AS (SELECT m.path AS module, f.* FROM nodes m JOIN nodes f ON f.node_type = 'File' AND (f.path = m.path OR starts_with(f.path, m.path || '/')) WHERE m.node_type = 'Namespace'),
found AS (SELECT module, count(*) AS files, count(*) FILTER (id IN (SELECT id FROM over)) AS volatile, list_sort(list(DISTINCT name) FILTER (id IN (SELECT id FROM over))) AS names, max(last_lsp_sync) AS lsp, max(last_git_sync) AS git FROM files GROUP BY 1),
aged AS (SELECT DISTINCT n.path AS module, coalesce(files, 0)::BIGINT AS files, coalesce(volatile, 0)::BIGINT AS volatile, coalesce(array_to_string(names[1:3], ','), '') AS names, lsp, git,
  CASE WHEN lsp IS NOT NULL AND git IS NOT NULL THEN greatest({tables.NOW} - lsp, {tables.NOW} - git) END AS staleness FROM nodes n LEFT JOIN found f ON f.module = n.path WHERE node_type = 'Namespace')
SELECT *, CASE WHEN staleness IS NULL THEN 'Unknown' WHEN staleness < 3600 THEN 'Fresh' WHEN staleness < 86400 THEN 'Stale' ELSE 'Outdated' END AS status FROM aged""")
def _(spark, sf_dir):
    return architecture.master_map(edited(spark, sf_dir), tables.NOW)


@query("overlay_search_name", f"{G}{OVER} SELECT id, name FROM over WHERE contains(lower(name), '2*')")
def _(spark, sf_dir):
    return resolve.search_name(edited(spark, sf_dir).overlay_nodes, "2*").select("id", "name")


@query("overlay_resolve", f"{G}{OVER}, handles AS (SELECT unnest(['supplier:new', 'part:3', 'new', 'part_4', 'ASIA', 'nowhere']) AS handle), hits AS (SELECT handle, 1 AS p, id FROM handles JOIN over ON id = handle UNION ALL SELECT handle, 2, id FROM handles JOIN nodes ON id = handle UNION ALL SELECT handle, 3, id FROM handles JOIN over ON name = handle UNION ALL SELECT handle, 4, id FROM handles JOIN nodes ON name = handle UNION ALL SELECT handle, 5, id FROM handles JOIN nodes ON path = handle) SELECT handle, arg_min(id, (p, id)) AS id, min(p)::BIGINT AS priority FROM hits GROUP BY handle")
def _(spark, sf_dir):
    handles = spark.createDataFrame([(h,) for h in ("supplier:new", "part:3", "new", "part_4", "ASIA", "nowhere")], "handle string")
    return resolve.resolve_many(edited(spark, sf_dir), handles)


# resolution
POSITIONS = ", positions AS (SELECT 'supplier:' || s_suppkey AS file_id, s_path AS path, unnest([5, 120, 333]) AS line FROM suppliers)"


@query("node_at_location", f"{G}{POSITIONS}, inside AS (SELECT p.*, n.id, n.line_end - n.line_start AS span FROM positions p JOIN nodes n ON n.path = p.path AND n.node_type <> 'File' AND p.line BETWEEN n.line_start AND n.line_end) SELECT path, line::BIGINT AS line, file_id, arg_min(id, (span, id)) AS id FROM inside GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return resolve.at_lines(positions(g), g.nodes, ("file_id",))


def positions(g: PropertyGraph) -> DataFrame:
    return g.nodes.where("node_type = 'File'").select(F.col("id").alias("file_id"), "path", F.explode(F.array(F.lit(5), F.lit(120), F.lit(333))).alias("line"))


@query("resolve_static_refs", f"{G}{POSITIONS}, inside AS (SELECT p.path, p.line, n.id, n.line_end - n.line_start AS span FROM positions p JOIN nodes n ON n.path = p.path AND n.node_type <> 'File' AND p.line BETWEEN n.line_start AND n.line_end), sources AS (SELECT path, line, arg_min(id, (span, id)) AS id FROM inside GROUP BY 1, 2), refs AS (SELECT DISTINCT id, 'part_' || line AS target FROM sources) SELECT 'Calls' AS edge_type, r.id AS source_id, n.id AS target_id FROM refs r JOIN nodes n ON n.name = r.target WHERE r.id <> n.id")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    refs = positions(g).select("path", "line", F.concat(F.lit("part_"), F.col("line")).alias("target_name"), F.lit("Calls").alias("edge_type"))
    return resolve.resolve_static_refs(g, refs).select("edge_type", "source_id", "target_id")


@query("cross_runtime_callers", f"{G} SELECT target_id, CASE edge_type WHEN 'CallsHttp' THEN 'http' WHEN 'Implements' THEN 'implements' ELSE 'uses' END AS section, source_id AS id, n.name FROM edges JOIN nodes n ON n.id = source_id WHERE edge_type IN ('CallsHttp', 'Implements', 'Uses')")
def _(spark, sf_dir):
    return resolve.cross_runtime_callers(tables.graph(spark, sf_dir))


@query("call_sites", f"{G} SELECT DISTINCT n.id, n.name, n.path FROM edges JOIN nodes n ON n.id = source_id WHERE edge_type = 'Calls' AND target_id = {CALLEE}")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return resolve.call_sites(g, a_callee(g)).select("id", "name", "path")


@query("neighbours", f"{G} SELECT e.edge_type, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = 'nation:3'")
def _(spark, sf_dir):
    return resolve.neighbours(tables.graph(spark, sf_dir), "nation:3").select("edge_type", "id", "name")


@query("references_others", f"{G} SELECT id, name FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE edge_type IN ('Calls', 'Uses'))")
def _(spark, sf_dir):
    return resolve.references_others(tables.graph(spark, sf_dir)).select("id", "name")


@query("edges_with_ends", f"{G} SELECT e.edge_type, a.name AS source_name, b.name AS target_name FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id")
def _(spark, sf_dir):
    return resolve.edges_with_ends(tables.graph(spark, sf_dir)).select("edge_type", "source_name", "target_name")


# writes
@query("upsert_latest", "WITH changes AS (SELECT 'file:' || user_id AS id, event_id AS seq, event_type <> 'error' AS is_hydrated FROM events) SELECT id, seq, is_hydrated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_hydrated DESC, seq DESC) AS n FROM changes) WHERE n = 1")
def _(spark, sf_dir):
    changes = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("file:"), F.col("user_id")).alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("is_hydrated"))
    return dml.latest(changes)


@query("insert_edges_lenient", f"{G} SELECT edge_type, count(*) AS n FROM (SELECT edge_type FROM edges UNION ALL SELECT 'Uses' FROM orders WHERE 'part:' || o_custkey IN (SELECT id FROM nodes)) GROUP BY 1")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    more = tables.table(spark, sf_dir, "orders").select(F.lit("Uses").alias("edge_type"), F.concat(F.lit("customer:"), F.col("o_custkey")).alias("source_id"), F.concat(F.lit("part:"), F.col("o_custkey")).alias("target_id"))
    return dml.insert_edges(g, more).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


# functions
@query("text_functions", f"{G} SELECT id, concat_ws(' | ', name, signature, docstring, path) AS enriched, substr(signature, strpos(signature, '->') + 3) AS returns, string_split(path, '/')[-1] AS file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, upper(name[1]) || lower(name[2:]) AS title FROM nodes WHERE node_type = 'Function'")
def _(spark, sf_dir):
    nodes = tables.graph(spark, sf_dir).nodes.where("node_type = 'Function'")
    return nodes.select("id", fn.enriched_text(*[F.col(c) for c in ("name", "signature", "docstring", "path")]).alias("enriched"), fn.return_type(F.col("signature")).alias("returns"), fn.file_name(F.col("path")).alias("file"), fn.parent_dir(F.col("path")).alias("dir"), F.initcap("name").alias("title"))


# text sources: pages as files
LITERALS = r"""WITH lines AS (SELECT 'page_' || page_id || '.html' AS path, unnest(string_split(html, chr(10))) AS code, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line FROM pages),
vals AS (SELECT path, line, regexp_replace(unnest(regexp_extract_all(code, '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''')), '^["'']+|["'']+$', '', 'g') AS value FROM lines)
SELECT path, line::BIGINT AS line, value FROM vals WHERE length(value) >= 3 AND ((starts_with(value, '/') AND (length(value) > 5 OR regexp_matches(value, 'Mutation|Query|Subscription'))) OR regexp_matches(value, '^(https?|wss?)://') OR (starts_with(value, '$') AND length(value) > 2)
  OR (length(value) > 4 AND regexp_matches(value, '^[\p{Lu}_\p{N}]+$') AND contains(value, '_') AND regexp_matches(value, 'TOPIC|QUEUE|ENDPOINT|STREAM|SOCKET|ROUTE')))"""


@query("string_literals", LITERALS)
def _(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return extract.string_literals(pages, any_kind=True)


def inline(spark: SparkSession, *files: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files), "path string, text string")


ROUTE_FILES = (
    ("app.ts", 'router.get("/users", listUsers)\nrouter.get("/users", other)\nx.get("/health", ok)'),
    ("main.go", 'r.GET("/ping", ping)\nr.POST("/ping", pong)\nhttp.HandleFunc("/old", legacy)'),
)


@query("route_extract", "SELECT * FROM (VALUES ('app.ts', 'GET', '/users', 'listUsers', 1::BIGINT), ('app.ts', 'GET', '/health', 'ok', 3::BIGINT), ('main.go', 'GET', '/ping', 'ping', 1::BIGINT), ('main.go', 'POST', '/ping', 'pong', 2::BIGINT), ('main.go', 'GET', '/old', 'legacy', 3::BIGINT)) t(file_path, method, path, handler, line)")
def _(spark, sf_dir):
    return sensors.http_routes(inline(spark, *ROUTE_FILES))


@query("static_refs", "SELECT * FROM (VALUES ('a.rs', 1::BIGINT, 'helper', 'Calls'), ('a.rs', 1::BIGINT, 'Widget', 'Uses'), ('b.py', 0::BIGINT, 'Widget', 'Calls'), ('b.py', 0::BIGINT, 'Widget', 'Uses')) t(path, line, target_name, edge_type)")
def _(spark, sf_dir):
    return extract.static_refs(inline(spark, ("a.rs", 'fn main() {\n  let w: Widget = helper("Nope()").unwrap(); // Other()\n}'), ("b.py", "w = Widget()  # Gone()"), ("c.txt", "Widget()")))


@query("openapi_routes", "SELECT * FROM (VALUES ('api.json', 'GET', '/pets', 'listPets', 'All pets'), ('api.json', 'POST', '/pets', 'post:/pets', '')) t(spec_path, method, path, operation_id, summary)")
def _(spark, sf_dir):
    return sensors.openapi(inline(spark, ("api.json", '{"openapi": "3.0", "paths": {"/pets": {"get": {"operationId": "listPets", "summary": "All pets"}, "post": {}}}}')))


@query("proto_services", "SELECT * FROM (VALUES ('s.proto', 'shop', 'Cart', 'AddItem', 'Item', 'Reply', 3::BIGINT), ('s.proto', 'shop', 'Cart', 'Clear', 'Empty', 'Empty', 4::BIGINT)) t(proto_path, package, service, method, input_type, output_type, line)")
def _(spark, sf_dir):
    return sensors.proto(inline(spark, ("s.proto", "package shop;\nservice Cart {\n  rpc AddItem (Item) returns (Reply);\n  rpc Clear(Empty) returns (Empty) {}\n}\nrpc Lost (A) returns (B);")))


@query("graphql_operations", "SELECT * FROM (VALUES ('s.graphql', 'Query', 'user', 'Api', 3::BIGINT), ('s.graphql', 'Query', 'user', 'Query', 3::BIGINT), ('s.graphql', 'Mutation', 'save', 'Query', 5::BIGINT)) t(schema_path, operation_type, field, type_name, line)")
def _(spark, sf_dir):
    return sensors.graphql(inline(spark, ("s.graphql", "type Api\n{\n  query user(id: ID)\n}\nmutation save(x: Int)")))


@query("websocket_endpoints", "SELECT * FROM (VALUES ('w.js', 'wss://x/y', '', 1::BIGINT), ('w.js', 'wss://x/y', '', 1::BIGINT), ('w.js', '', 'handle', 2::BIGINT)) t(file_path, url, handler, line)")
def _(spark, sf_dir):
    return sensors.websocket(inline(spark, ("w.js", 'const s = new WebSocket("wss://x/y")\ns.onmessage = handle')))


# diagnostics: each event's properties stand for a log of its own
@query("diagnostics_parse", "SELECT event_id AS log_id, 'src/f' || user_id || '.py' AS path, event_id % 100 AS line, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Warning' END AS severity, event_type || ' seen' AS message FROM events")
def _(spark, sf_dir):
    return diagnostics.parse(event_logs(spark, sf_dir), "pytest").select("log_id", "path", "line", "severity", "message")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    text = F.concat(F.lit("collected 1 item\n src/f"), F.col("user_id"), F.lit(".py:"), F.col("event_id") % 100, F.lit(": "), F.col("event_type"), F.lit(" seen\nend"))
    return e.select(F.col("event_id").alias("log_id"), text.alias("text"))


@query("error_summary", "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') AS warnings, count(DISTINCT user_id) AS files FROM events")
def _(spark, sf_dir):
    return diagnostics.summary(diagnostics.parse(event_logs(spark, sf_dir), "pytest"))


@query("root_cause", f"{G}, hits AS (SELECT 'supplier:' || (user_id % 10) AS symbol FROM events WHERE event_type = 'error') SELECT symbol, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, symbol LIMIT 1")
def _(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").where("event_type = 'error'")
    return diagnostics.root_cause(e.select(F.concat(F.lit("supplier:"), F.col("user_id") % 10).alias("symbol")))


@query("combined_callees", f"{G} SELECT DISTINCT target_id AS id FROM edges WHERE edge_type = 'Calls' AND source_id IN (SELECT id FROM shown WHERE label = 'deprecated') ORDER BY id LIMIT 20")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return impact.callees(g, g.nodes.where("is_deprecated").select("id"))


COMPILER_LOG = "error[E0308]: mismatched types\n  --> src/a.rs:42:5\n  --> src/b.rs:1:1\nwarning: unused\n --> C:/x.rs:7:2\nerror: aborting"


@query("compiler_log", "SELECT * FROM (VALUES ('src/a.rs', 42::BIGINT, 5::BIGINT, 'Error', 'mismatched types', 'E0308'), ('C:/x.rs', 7::BIGINT, 2::BIGINT, 'Warning', 'unused', NULL)) t(path, line, \"column\", severity, message, code)")
def _(spark, sf_dir):
    return diagnostics.parse(spark.createDataFrame([(1, COMPILER_LOG)], "log_id int, text string"), "cargo-text").drop("log_id", "n")


@query("project_profile", "SELECT * FROM (VALUES ('p', 'Python', 3::BIGINT, true), ('p', 'TypeScript', 5::BIGINT, false), ('q', 'C', 11::BIGINT, true)) t(project, toolchain, rank, is_main)")
def _(spark, sf_dir):
    return project.project_profile(spark.createDataFrame([("p", "setup.py"), ("p", "package.json"), ("p", "tsconfig.json"), ("q", "Makefile")], "project string, name string"))


# change streams
EVENTS = "events"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: users stand for files, types for kinds."""
    return windows.as_changes(tables.table(spark, sf_dir, EVENTS), "user_id", "event_type")


@query("events_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    out = windows.tumbling(changes(spark, sf_dir), sums=("value",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("value", 4).alias("total"))


@query("events_sliding", "SELECT (date_trunc('day', ts) - to_days(k))::TIMESTAMP AS start, count(*) AS n, count(DISTINCT user_id) AS files FROM events, (VALUES (0), (1)) t(k) GROUP BY 1")
def _(spark, sf_dir):
    return windows.sliding(changes(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("events_session", "WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events), runs AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM gaps) SELECT user_id, min(ts) AS start, count(*) AS n FROM runs GROUP BY user_id, run")
def _(spark, sf_dir):
    return windows.sessions(changes(spark, sf_dir)).select(F.col("path").alias("user_id"), F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY 1, 2")
def _(spark, sf_dir):
    events = tables.table(spark, sf_dir, EVENTS)
    twice = windows.with_time(events.union(events))
    return windows.deduplicated(twice, ["event_id"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_overlay", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    """A file stream that keeps the overlay up, run until all files have been read."""
    events = tables.table(spark, sf_dir, EVENTS)
    overlay = windows.Overlay(spark, order=("ts", "event_id"))
    overlay.follow(windows.as_changes(windows.read_changes(spark, f"{sf_dir}/{EVENTS}.parquet*", events.schema), "user_id", "event_type"))
    return overlay.table().select(F.col("path").alias("user_id"), "event_id", F.col("kind").alias("event_type"))


@query("stream_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) NOT IN ('error', 'click')")
def _(spark, sf_dir):
    """Files whose last change isn't a removal, for which two types of events stand."""
    last = windows.latest_state(changes(spark, sf_dir), ("ts", "event_id"), ("error", "click"))
    return last.select(F.col("path").alias("user_id"), "event_id", F.col("kind").alias("event_type"))


@query("stream_debounce", "WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events), runs AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM gaps) SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS kind, count(*) AS n FROM runs GROUP BY user_id, run")
def _(spark, sf_dir):
    out = windows.debounced(changes(spark, sf_dir), "6 hours")
    return out.select(F.col("path").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "n")


PLACES = ("src/f{u}.rs", ".git/f{u}.rs", "src/f{u}.txt", "a/.b/f{u}.py", "a.b/f{u}.tsx", "Makefile{u}", "x/.f{u}.go", "y/f{u}.min.js")


@query("watch_rules", "SELECT event_id, CASE user_id % 8 WHEN 0 THEN 'src/f' || user_id || '.rs' WHEN 4 THEN 'a.b/f' || user_id || '.tsx' ELSE 'y/f' || user_id || '.min.js' END AS path, CASE event_id % 4 WHEN 0 THEN 'Created' WHEN 1 THEN 'Modified' ELSE 'Removed' END AS kind FROM events WHERE user_id % 8 IN (0, 4, 7) AND event_id % 4 < 3")
def _(spark, sf_dir):
    e = tables.table(spark, sf_dir, EVENTS)
    place = F.replace(F.element_at(F.array(*map(F.lit, PLACES)), (F.col("user_id") % 8 + 1).cast("int")), F.lit("{u}"), F.col("user_id").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("Created", "Modified", "Removed", "Accessed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return windows.watched(e.select("event_id", place.alias("path"), kind.alias("kind"))).select("event_id", "path", "kind")


@query("file_diff_text", "SELECT 'f' || s_suppkey AS path, '@@ -1,2 +1,2 @@' || chr(10) || '-' || s_name || chr(10) || '+' || s_name || '!' || chr(10) || ' x' || chr(10) AS diff FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("path"), "s_name", (F.col("s_suppkey") % 2 == 0).alias("even"))
    index = s.select("path", F.concat("s_name", F.lit("\nx\n")).alias("text"))
    workdir = s.select("path", F.concat("s_name", F.when(F.col("even"), "!").otherwise(""), F.lit("\nx\n")).alias("text"))
    out = difftext.file_diffs(index, workdir)
    return out.select("path", F.regexp_extract("diff", r"(?s)(@@ .*)$", 1).alias("diff"))


@query("find_test_file", "SELECT 'lib/m' || s_suppkey || '.rs' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE 'file' END AS kind, CASE s_suppkey % 3 WHEN 1 THEN 'lib/m' || s_suppkey || '_test.rs' WHEN 2 THEN 'lib/m' || s_suppkey || '/mod.rs' END AS test_path FROM supplier UNION ALL SELECT 'p/src/n' || n_nationkey || '.rs', 'inline', 'tests/n' || n_nationkey || '.rs' FROM nation")
def _(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("lib/m"), "s_suppkey").alias("m"), (F.col("s_suppkey") % 3).alias("k"))
    n = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("p/src/n"), "n_nationkey", F.lit(".rs")).alias("path"))
    ends = F.when(F.col("k") == 1, F.array(F.lit("_test.rs"), F.lit("/mod.rs"))).when(F.col("k") == 2, F.array(F.lit("/mod.rs"))).otherwise(F.array(F.lit(".md")))
    files = s.select(F.explode(F.transform(ends, lambda end: F.concat("m", end))).alias("path"))
    return difftext.tests_of(s.select(F.concat("m", F.lit(".rs")).alias("path")).union(n), files)


# the chain-and-hub graph that micro-benchmarks use: N functions in one file, each calling the next, and a hub
CHAIN = 5000
CHAIN_SQL = f"""WITH f AS (SELECT i, 'function_' || i AS name FROM range({CHAIN}) t(i)),
chain AS (SELECT i AS a, i + 1 AS b FROM range({CHAIN} - 1) t(i) UNION ALL SELECT -1, i * 10 FROM range(least(100, {CHAIN} // 10)) t(i))"""


def chain_graph(spark: SparkSession, n: int = CHAIN) -> PropertyGraph:
    name = F.concat(F.lit("function_"), F.col("i"))
    functions = spark.range(n).select(F.col("id").alias("i")).select(name.alias("id"), F.lit("Function").alias("node_type"), name.alias("name"), F.lit("/src/main.rs").alias("path"))
    others = spark.createDataFrame([("main.rs", "File", "main.rs", "/src/main.rs"), ("function_-1", "Function", "core_dispatch", "/src/main.rs")], functions.schema)
    pair = lambda a, b: [F.concat(F.lit("function_"), a).alias("source_id"), F.concat(F.lit("function_"), b).alias("target_id")]
    calls = spark.range(n - 1).select(F.lit("Calls").alias("edge_type"), *pair(F.col("id"), F.col("id") + 1))
    hub = spark.range(min(100, n // 10)).select(F.lit("Calls").alias("edge_type"), *pair(F.lit("-1"), F.col("id") * 10))
    contains = functions.select(F.lit("Contains").alias("edge_type"), F.lit("main.rs").alias("source_id"), F.col("id").alias("target_id"))
    return PropertyGraph.of(functions.union(others), calls.union(hub).union(contains))


@query("chain_find", f"{CHAIN_SQL} SELECT name AS id, 'Function' AS type, name, NULL::VARCHAR AS label FROM f WHERE name = 'function_42'")
def _(spark, sf_dir):
    return Executor(chain_graph(spark)).run({"ops": [find(type="Function", name="function_42")]}).nodes


@query("chain_prefix", f"{CHAIN_SQL} SELECT name AS id, 'Function' AS type, name, NULL::VARCHAR AS label FROM f WHERE starts_with(name, 'function_1') ORDER BY name, id LIMIT 10")
def _(spark, sf_dir):
    return Executor(chain_graph(spark)).run({"ops": [find(name={"starts_with": "function_1"}), {"op": "sort", "by": "name"}, {"op": "limit", "count": 10}]}).nodes


@query("chain_two_hop", f"{CHAIN_SQL} SELECT DISTINCT 'function_' || y.b AS id, 'Function' AS type, 'function_' || y.b AS name, NULL::VARCHAR AS label FROM chain x JOIN chain y ON x.b = y.a WHERE x.a = 7 UNION SELECT 'function_8', 'Function', 'function_8', NULL")
def _(spark, sf_dir):
    return Executor(chain_graph(spark)).run({"ops": [find(name="function_7"), connect("Calls", depth={"min": 1, "max": 2})]}).nodes


@query("chain_three_hop_hub", f"{CHAIN_SQL}, one AS (SELECT b FROM chain WHERE a = -1), two AS (SELECT c.b FROM one JOIN chain c ON c.a = one.b), three AS (SELECT c.b FROM two JOIN chain c ON c.a = two.b) SELECT DISTINCT 'function_' || b AS id, 'Function' AS type, 'function_' || b AS name, NULL::VARCHAR AS label FROM (SELECT b FROM one UNION SELECT b FROM two UNION SELECT b FROM three)")
def _(spark, sf_dir):
    return Executor(chain_graph(spark)).run({"ops": [find(name="core_dispatch"), connect("Calls", depth={"min": 1, "max": 3})]}).nodes


# reports on symbols and files
@query("explain_symbol", f"{G}{CO} SELECT d.id, n.node_type, n.name, n.path, n.signature, n.docstring, i::BIGINT AS fan_in, o::BIGINT AS fan_out, round(anchor, 6) AS anchor_score, co::BIGINT AS partners FROM debts d JOIN nodes n ON n.id = d.id WHERE d.id = '{PART}'")
def _(spark, sf_dir):
    g = metrics.enrich(tables.graph(spark, sf_dir, co_changes=True))
    return impact.explain_symbol(g, PART).withColumn("anchor_score", F.round("anchor_score", 6))


@query("summed_partners", f"{G}, ends AS (SELECT file1 AS id, file2 AS other, n FROM co_pairs WHERE n >= 2 UNION ALL SELECT file2, file1, n FROM co_pairs WHERE n >= 2) SELECT other AS id, sum(n)::DOUBLE AS weight FROM ends WHERE id IN (SELECT id FROM shown WHERE label = 'deprecated') GROUP BY 1 ORDER BY weight DESC, id LIMIT 5")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir, co_changes=True)
    return cochange.summed_partners(g, g.nodes.where("is_deprecated").select("id"))


@query("compare_modules", f"{G}{CO} SELECT id, name, round(anchor, 6) AS anchor_score, o::BIGINT AS edges FROM debts WHERE id IN ('part:7', 'part:8')")
def _(spark, sf_dir):
    g = metrics.enrich(tables.graph(spark, sf_dir, co_changes=True))
    return architecture.compare_modules(g, "part:7", "part:8").select("id", "name", F.round("anchor_score", 6).alias("anchor_score"), "edges")


@query("entry_points", f"{G} SELECT id, name, path FROM nodes WHERE name IN ('ASIA', 'EUROPE')")
def _(spark, sf_dir):
    return metrics.entry_points(tables.graph(spark, sf_dir), ("ASIA", "EUROPE"))


@query("prewarm_anchors", f"{G} SELECT id, name FROM scored WHERE embedding IS NULL ORDER BY anchor_score DESC, id LIMIT 20")
def _(spark, sf_dir):
    return semantic.prewarm(scored(spark, sf_dir)).select("id", "name")


@query("code_snippet", "SELECT i::BIGINT AS line, line AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id = 3) WHERE i BETWEEN 1 AND 5")
def _(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return impact.snippet(docs, "3", 3, 2)


@query("list_dir", f"{G} SELECT string_split(substr(path, 6), '/')[1] AS name, bool_or(contains(substr(path, 6), '/')) AS is_dir FROM nodes WHERE starts_with(path, 'ASIA/') GROUP BY 1")
def _(spark, sf_dir):
    return extract.list_dir(tables.graph(spark, sf_dir).nodes.select("path"), "ASIA")


@query("find_files", f"{G} SELECT DISTINCT path FROM nodes WHERE regexp_full_match(path, '[^/]*/NATION_1[^/]/[^/]*')")
def _(spark, sf_dir):
    return extract.find_files(tables.graph(spark, sf_dir).nodes.select("path").distinct(), "*/NATION_1?/*")


@query("health", f"{G} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, 0::BIGINT AS overlay_count")
def _(spark, sf_dir):
    from .operators import tools

    return tools.call("get_health", tables.graph(spark, sf_dir)).drop("last_commit")


from . import catalogue_writes  # noqa: E402, F401  (adds to the queries above)
