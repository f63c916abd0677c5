"""Registered queries of writes, storage, sources, parsers, tools and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .catalogue import OVER, OVER_EDGES, G, edited, query
from .functions import text
from .graph import PropertyGraph
from .operators import cochange, diagnostics, dml, metrics, resolve, tools, traverse
from .runtime import new_path
from .sources import project, storage, symbols, tables

EVENT = "SELECT event_id AS log_id, "
KIND = "CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Warning' END AS severity"


def logs(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """A log for each event; in form, {u} is the user, {l} a line, {t} the type and {s} how bad it is."""
    e = tables.table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type") == "error", "error").otherwise("warning"))
    parts = {"{u}": F.col("user_id").cast("string"), "{l}": (F.col("event_id") % 100).cast("string"), "{t}": F.col("event_type"), "{s}": F.col("s")}
    out = F.lit(form)
    for mark, value in parts.items():
        out = F.replace(out, F.lit(mark), value)
    return e.select(F.col("event_id").alias("log_id"), out.alias("text"))


def parser(name: str, form: str, sql: str) -> None:
    query(f"parse_{name.replace('-', '_')}", f"{EVENT}{sql} FROM events")(lambda spark, sf_dir: diagnostics.parse(logs(spark, sf_dir, form), name).drop("n"))


parser(
    "cargo-json",
    '{"reason":"compiler-message","message":{"message":"{t} seen","level":"{s}","code":{"code":"E{u}"},"spans":[{"file_name":"no.rs","line_start":1,"column_start":1,"is_primary":false},{"file_name":"src/f{u}.rs","line_start":{l},"column_start":4,"is_primary":true}]}}\n{"reason":"build-finished"}\nnot json',
    f"'src/f' || user_id || '.rs' AS path, event_id % 100 AS line, 4::BIGINT AS \"column\", {KIND}, event_type || ' seen' AS message, 'E' || user_id AS code",
)
parser(
    "cargo-text",
    "Compiling x\nerror[E{u}]: {t} seen\n  note\n  --> C:/f{u}.rs:{l}:7\n  --> other.rs:1:1\n\nwarning: without a place\n",
    "'C:/f' || user_id || '.rs' AS path, event_id % 100 AS line, 7::BIGINT AS \"column\", 'Error' AS severity, event_type || ' seen' AS message, 'E' || user_id AS code",
)
parser(
    "cargo-test",
    "running 2 tests\ntest m{u}::t{l} ... FAILED\ntest ok ... ok",
    "'m' || user_id || '/t' || event_id % 100 AS path, 0::BIGINT AS line, NULL::BIGINT AS \"column\", 'Error' AS severity, 'test m' || user_id || '::t' || event_id % 100 || ' ... FAILED' AS message, NULL::VARCHAR AS code",
)
parser(
    "go-build",
    "# pkg\nd/f{u}.go:{l}:12: {t} seen\nnothing",
    "'d/f' || user_id || '.go' AS path, event_id % 100 AS line, NULL::BIGINT AS \"column\", 'Error' AS severity, '12: ' || event_type || ' seen' AS message, NULL::VARCHAR AS code",
)
parser(
    "go-test",
    "=== RUN T\n--- FAIL: T{u}\n\tf{u}.go:{l}: {t} seen\n\tok",
    "'f' || user_id || '.go' AS path, event_id % 100 AS line, NULL::BIGINT AS \"column\", 'Error' AS severity, '[T' || user_id || '] ' || event_type || ' seen' AS message, NULL::VARCHAR AS code",
)
parser(
    "jest",
    '{"testResults":[{"assertionResults":[{"status":"passed","title":"a"},{"status":"failed","title":"b","fullName":"x b","ancestorTitles":["f{u}.test.js"],"lineNumber":{l},"failureMessages":["{t} seen"]}]}]}',
    "'f' || user_id || '.test.js' AS path, event_id % 100 AS line, NULL::BIGINT AS \"column\", 'Error' AS severity, event_type || ' seen' AS message, NULL::VARCHAR AS code",
)


# a compiler's log for each file, with a line that some of the file's functions span
FILE_LINE = "(substr(id, 10)::BIGINT * 7) % 500 + 1"
PLACED = f"""{G}, diags AS (SELECT id, path, {FILE_LINE} AS line FROM nodes WHERE node_type = 'File'),
spans AS (SELECT d.path, d.line, n.id, n.line_end - n.line_start AS span FROM diags d JOIN nodes n ON n.path = d.path AND n.node_type <> 'File' AND d.line BETWEEN coalesce(n.line_start, 0) AND coalesce(n.line_end, 0)),
near AS (SELECT path, line, arg_min(id, (span, id)) AS id FROM spans GROUP BY path, line),
placed AS (SELECT d.path, d.line, coalesce(n.id, (SELECT min(id) FROM nodes x WHERE x.path = d.path)) AS symbol FROM diags d LEFT JOIN near n ON d.path = n.path AND d.line = n.line)"""


def decorated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    g = tables.graph(spark, sf_dir)
    files = g.nodes.where("node_type = 'File'").withColumn("line", F.expr("(try_cast(substring(id, 10) as bigint) * 7) % 500 + 1"))
    text_ = F.concat(F.lit("error: broken\n --> "), "path", F.lit(":"), "line", F.lit(":1\n"))
    return diagnostics.decorate(g, files.select(F.col("id").alias("log_id"), text_.alias("text")), "cargo-text")


@query("decorate_symbols", f"{PLACED} SELECT path, line, symbol FROM placed")
def _(spark, sf_dir):
    return decorated(spark, sf_dir)["diagnostics"].select("path", "line", "symbol")


@query("decorate_summary", f"{PLACED} SELECT count(*) AS errors, 0::BIGINT AS warnings, count(DISTINCT path) AS files FROM placed")
def _(spark, sf_dir):
    return decorated(spark, sf_dir)["summary"]


@query("decorate_callees", f"{PLACED} SELECT DISTINCT target_id AS id FROM edges WHERE edge_type = 'Calls' AND source_id IN (SELECT symbol FROM placed) ORDER BY id LIMIT 20")
def _(spark, sf_dir):
    return decorated(spark, sf_dir)["callees"].select("id")


@query("tool_run_build", f"{PLACED} SELECT count(*) AS n, count(symbol) AS placed FROM placed")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    files = g.nodes.where("node_type = 'File'").withColumn("line", F.expr("(try_cast(substring(id, 10) as bigint) * 7) % 500 + 1"))
    span = F.struct(F.col("path").alias("file_name"), F.col("line").alias("line_start"), F.lit(1).alias("column_start"), F.lit(True).alias("is_primary"))
    message = F.struct(F.lit("broken").alias("message"), F.lit("error").alias("level"), F.array(span).alias("spans"))
    lines = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message")))
    found = tools.call("run_build", g, logs=files.select(F.col("id").alias("log_id"), lines.alias("text")))["diagnostics"]
    return found.agg(F.count("*").alias("n"), F.count("symbol").alias("placed"))


@query("tool_run_tests", "SELECT count(*) AS errors, 0::BIGINT AS warnings, count(DISTINCT user_id) AS files FROM events")
def _(spark, sf_dir):
    return tools.call("run_tests", tables.graph(spark, sf_dir), logs=logs(spark, sf_dir, "test m::t{u} ... FAILED"))["summary"]


@query("tool_run_clippy", "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') AS warnings, count(DISTINCT user_id) AS files FROM events")
def _(spark, sf_dir):
    form = '{"reason":"compiler-message","message":{"message":"m","level":"{s}","spans":[{"file_name":"f{u}","line_start":1,"column_start":1,"is_primary":true}]}}'
    return tools.call("run_clippy", tables.graph(spark, sf_dir), logs=logs(spark, sf_dir, form))["summary"]


# writes
def renamed(spark: SparkSession, sf_dir: str, hydrated: bool = True) -> tuple[PropertyGraph, DataFrame]:
    g = tables.graph(spark, sf_dir)
    some = g.nodes.where("node_type = 'Function' and is_deprecated")
    return g, some.select("id", "node_type", F.concat("name", F.lit("!")).alias("name"), "path", F.lit(hydrated).alias("is_hydrated"))


@query("batch_insert", f"{G} SELECT id, CASE WHEN is_deprecated THEN name || '!' ELSE name END AS name FROM nodes UNION ALL SELECT 'part:new', 'new'")
def _(spark, sf_dir):
    g, some = renamed(spark, sf_dir)
    more = spark.createDataFrame([("part:new", "Function", "new", "", True)], some.schema)
    return dml.upsert(g, some.union(more)).nodes.select("id", "name")


@query("ghost_never_replaces", f"{G} SELECT id, name FROM nodes")
def _(spark, sf_dir):
    g, some = renamed(spark, sf_dir, hydrated=False)
    return dml.upsert(g, some).nodes.select("id", "name")


@query("ghosts", "SELECT DISTINCT 'f' || user_id AS path, 'unknown:' || event_id % 20 AS name, 'Function' AS node_type, false AS is_hydrated FROM events")
def _(spark, sf_dir):
    callers = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("f"), "user_id").alias("path"), (F.col("event_id") % 20).alias("line"))
    return resolve.ghosts(tables.graph(spark, sf_dir), callers).select("path", "name", "node_type", "is_hydrated")


@query("insert_edges_strict", f"{G} SELECT edge_type, count(*) AS n FROM (SELECT edge_type FROM edges UNION ALL SELECT 'Uses' FROM part p JOIN customer c ON p_partkey = c_custkey) GROUP BY 1")
def _(spark, sf_dir):
    more = tables.table(spark, sf_dir, "part").join(tables.table(spark, sf_dir, "customer"), F.col("p_partkey") == F.col("c_custkey"))
    more = more.select(F.lit("Uses").alias("edge_type"), F.concat(F.lit("part:"), "p_partkey").alias("source_id"), F.concat(F.lit("customer:"), "c_custkey").alias("target_id"))
    return dml.insert_edges(tables.graph(spark, sf_dir), more, strict=True).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("replace_cochange_edges", f"{G} SELECT 'part:' || p_partkey AS source_id, 'part:' || (p_partkey + 1) AS target_id FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir, co_changes=True)
    part = tables.table(spark, sf_dir, "part")
    new = part.select(F.lit("CoChangedWith").alias("edge_type"), F.concat(F.lit("part:"), "p_partkey").alias("source_id"), F.concat(F.lit("part:"), F.col("p_partkey") + 1).alias("target_id"))
    once = dml.replace_edges(g, "CoChangedWith", new)
    return dml.replace_edges(once, "CoChangedWith", new).edges.where("edge_type = 'CoChangedWith'").select("source_id", "target_id")


@query("overlay_upsert", f"{G}{OVER} SELECT id, CASE WHEN substr(id, 10) = '2' THEN 'again' ELSE name END AS name FROM over UNION ALL SELECT 'supplier:more', 'more'")
def _(spark, sf_dir):
    new = spark.createDataFrame([("supplier:2", "File", "again", "again"), ("supplier:more", "File", "more", "more")], "id string, node_type string, name string, path string")
    return dml.overlay_upsert(edited(spark, sf_dir), new).overlay_nodes.select("id", "name")


@query("overlay_insert_edges", f"{G}{OVER}{OVER_EDGES} SELECT edge_type, source_id, target_id FROM over_edges UNION SELECT 'Uses', id, 'supplier:new' FROM over WHERE id <> 'supplier:new'")
def _(spark, sf_dir):
    g = edited(spark, sf_dir)
    new = g.overlay_nodes.where("id <> 'supplier:new'").select(F.lit("Uses").alias("edge_type"), F.col("id").alias("source_id"), F.lit("supplier:new").alias("target_id"))
    return dml.overlay_insert_edges(g, new.union(new)).overlay_edges.select("edge_type", "source_id", "target_id")


@query("overlay_merge_write", f"{G}{OVER}{OVER_EDGES} SELECT (SELECT count(*) FROM over) + 1 AS nodes, (SELECT count(*) FROM over_edges) + 1 AS edges")
def _(spark, sf_dir):
    g = edited(spark, sf_dir)
    nodes = spark.createDataFrame([("supplier:new", "File", "newer", "newer"), ("supplier:more", "File", "more", "more")], "id string, node_type string, name string, path string")
    edges = spark.createDataFrame([("Uses", "supplier:new", "supplier:more")] * 2, "edge_type string, source_id string, target_id string")
    merged = dml.overlay_merge(g, nodes, edges)
    return merged.overlay_nodes.agg(F.count("*").alias("nodes")).crossJoin(merged.overlay_edges.agg(F.count("*").alias("edges")))


@query("overlay_clear", f"{G} SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def _(spark, sf_dir):
    return edited(spark, sf_dir).without_overlay().merged().nodes.groupBy("node_type").agg(F.count("*").alias("n"))


# storage
def stored(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    path = new_path(spark, "saved")
    storage.save(tables.graph(spark, sf_dir), path)
    return storage.load(spark, path)


@query("storage_nodes", f"{G} SELECT id, node_type, name, path, line_start::BIGINT AS line_start, signature, is_deprecated FROM nodes")
def _(spark, sf_dir):
    return stored(spark, sf_dir).nodes.select("id", "node_type", "name", "path", "line_start", "signature", "is_deprecated")


@query("storage_edges", f"{G} SELECT edge_type, source_id, target_id FROM edges")
def _(spark, sf_dir):
    return stored(spark, sf_dir).edges.select("edge_type", "source_id", "target_id")


@query("storage_replaced", f"{G} SELECT edge_type, count(*) AS n FROM edges WHERE edge_type = 'Calls' GROUP BY 1")
def _(spark, sf_dir):
    path = new_path(spark, "saved")
    g = tables.graph(spark, sf_dir)
    storage.save(g, path)
    storage.save(PropertyGraph(g.nodes, g.edges.where("edge_type = 'Calls'")), path)
    return storage.load(spark, path).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("json_export", f"{G} SELECT 'node' AS kind, id AS a, name AS b FROM nodes UNION ALL SELECT 'edge', source_id, target_id FROM edges")
def _(spark, sf_dir):
    rows = storage.to_json(tables.graph(spark, sf_dir))
    got = lambda x, y: F.coalesce(F.get_json_object("json", f"$.{x}"), F.get_json_object("json", f"$.{y}"))
    return rows.select("kind", got("id", "source_id").alias("a"), got("name", "target_id").alias("b"))


@query("last_commit", "SELECT 'order:' || o_orderkey AS last_commit FROM orders ORDER BY o_orderdate DESC, last_commit LIMIT 1")
def _(spark, sf_dir):
    path = new_path(spark, "mark")
    for commit in ("older", cochange.head(tables.commits(spark, sf_dir)).first()["id"]):
        storage.set_last_commit(spark, path, commit)
    return spark.createDataFrame([(storage.last_commit(spark, path),)], "last_commit string")


# sources
PAGE_FILES = "(SELECT 'd' || page_id % 7 || '/page_' || page_id || '.html' AS path, page_id FROM pages)"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), F.col("page_id") % 7, F.lit("/page_"), "page_id", F.lit(".html")).alias("path"), "page_id")


@query("tracked_files", f"SELECT path FROM {PAGE_FILES} WHERE page_id % 3 <> 0")
def _(spark, sf_dir):
    files = page_files(spark, sf_dir)
    return project.tracked(files, files.where("page_id % 3 = 0")).select("path")


@query("ignored_patterns", f"SELECT path FROM {PAGE_FILES} WHERE NOT starts_with(path, 'd3/') AND NOT contains(path, '1.html')")
def _(spark, sf_dir):
    return project.tracked(page_files(spark, sf_dir), patterns=("^d3/", r"1\.html$")).select("path")


DIFF = "SELECT 'c' || o_custkey AS path, o_orderstatus AS change, true AS staged FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'c' || o_custkey, o_orderstatus, false FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'c' || o_custkey, 'Added', false FROM orders WHERE o_orderkey % 3 = 2"


def differing(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("path"), F.col("o_orderstatus").alias("change"))
    return {name: o.where(F.col("o_orderkey") % 3 == k) for k, name in enumerate(("staged", "unstaged", "untracked"))}


@query("tool_file_diff", DIFF)
def _(spark, sf_dir):
    return tools.call("get_file_diff", tables.graph(spark, sf_dir), **differing(spark, sf_dir))


@query("tool_file_diff_of_path", f"SELECT * FROM ({DIFF}) WHERE path = 'c1'")
def _(spark, sf_dir):
    return tools.call("get_file_diff", tables.graph(spark, sf_dir), **differing(spark, sf_dir), path="c1")


NEWEST = "SELECT 'order:' || o_orderkey AS id, epoch(o_orderdate::TIMESTAMP)::BIGINT AS time FROM orders ORDER BY time DESC, id"


@query("tool_branch_status", f"{NEWEST} LIMIT 1")
def _(spark, sf_dir):
    return tools.call("get_branch_status", tables.graph(spark, sf_dir), commits=tables.commits(spark, sf_dir))


@query("changed_files_since", f"{G}, newest AS ({NEWEST} LIMIT 30) SELECT DISTINCT file AS path FROM commit_files WHERE id IN (SELECT id FROM newest) AND file NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size > 40)")
def _(spark, sf_dir):
    commits = tables.commits(spark, sf_dir)
    at = commits.select("id", "time").orderBy(F.desc("time"), "id").limit(31).orderBy("time", F.desc("id")).first()["id"]
    ignored = tables.table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("part:"), "p_partkey").alias("path"))
    return cochange.changed_since(commits, at, ignored)


@query("remote_identity", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'team' || s_nationkey || CASE WHEN s_suppkey % 3 = 1 THEN '/sub' ELSE '' END END AS owner, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'r' || s_suppkey END AS name FROM supplier")
def _(spark, sf_dir):
    key, team = F.col("s_suppkey"), F.concat(F.lit("team"), F.col("s_nationkey"))
    url = F.when(key % 3 == 0, F.concat(F.lit("git@host.example:"), team, F.lit("/r"), key, F.lit(".git"))).when(key % 3 == 1, F.concat(F.lit("https://user@host.example:8443/"), team, F.lit("/sub/r"), key)).otherwise(F.lit("nothing"))
    found = tables.table(spark, sf_dir, "supplier").select("s_suppkey", project.owner_and_name(url).alias("x"))
    return found.select("s_suppkey", "x.owner", "x.name")


KIND_OF = "['Class', 'Method', 'Function', 'Variable', 'Struct', 'Key', 'Event', 'Enum']"


def document_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kinds = F.array(*[F.lit(k) for k in ("Class", "Method", "Function", "Variable", "Struct", "Key", "Event", "Enum")])
    part = tables.table(spark, sf_dir, "part")
    parent = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("s"), F.col("p_partkey") - 1))
    rows = part.select(F.concat(F.lit("src/f"), F.floor(F.col("p_partkey") / 10), F.lit(".rs")).alias("path"), F.concat(F.lit("s"), "p_partkey").alias("name"), F.element_at(kinds, (F.col("p_size") % 8 + 1).cast("int")).alias("kind"), parent.alias("parent"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    return symbols.symbol_nodes(rows)


SYMBOLS = f"""WITH s AS (SELECT p_partkey AS k, 'src/f' || p_partkey // 10 || '.rs' AS path, 's' || p_partkey AS name, {KIND_OF}[p_size % 8 + 1] AS kind FROM part),
used AS (SELECT *, CASE kind WHEN 'Event' THEN 'Module' ELSE kind END AS node_type FROM s WHERE kind NOT IN ('Variable', 'Key'))"""


@query("document_symbols", f"{SYMBOLS} SELECT node_type, name, path FROM used UNION ALL SELECT DISTINCT 'File', string_split(path, '/')[-1], path FROM used")
def _(spark, sf_dir):
    return document_symbols(spark, sf_dir)[0].select("node_type", "name", "path")


@query("document_symbol_edges", f"{SYMBOLS} SELECT coalesce(p.name, string_split(u.path, '/')[-1]) AS source, u.name AS target FROM used u LEFT JOIN used p ON u.k % 2 = 1 AND p.k = u.k - 1 AND p.path = u.path")
def _(spark, sf_dir):
    nodes, edges = document_symbols(spark, sf_dir)
    names = nodes.select("id", "name")
    out = edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return out.join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id").select("source", "target")


@query("reference_edges", f"""{G}, refs AS (SELECT f.id AS file_id, x.path, {FILE_LINE.replace('id', 'x.id')} AS line FROM nodes f JOIN nodes x ON f.node_type = 'File' AND x.node_type = 'File' AND substr(x.id, 10)::BIGINT = substr(f.id, 10)::BIGINT + 1),
spans AS (SELECT r.file_id, r.path, r.line, n.id, n.line_end - n.line_start AS span FROM refs r JOIN nodes n ON n.path = r.path AND n.node_type <> 'File' AND r.line BETWEEN coalesce(n.line_start, 0) AND coalesce(n.line_end, 0))
SELECT DISTINCT 'Uses' AS edge_type, file_id AS source_id, target_id FROM (SELECT file_id, arg_min(id, (span, id)) AS target_id FROM spans GROUP BY file_id, path, line)""")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    files = g.nodes.where("node_type = 'File'").select("id", "path", F.expr("try_cast(substring(id, 10) as bigint)").alias("k"))
    refs = files.select((F.col("k") - 1).alias("k"), "path", (F.col("k") * 7 % 500 + 1).cast("int").alias("line")).join(files.select("k", F.col("id").alias("file_id")), "k")
    return resolve.reference_edges(g, refs.select("file_id", "path", "line")).select("edge_type", "source_id", "target_id")


# enrichment, synchronisation and what else the tools do
ENRICHED = f"{G}, mates AS (SELECT f AS id, count(*) AS partners FROM (SELECT file1 AS f FROM co_pairs WHERE n >= 2 UNION ALL SELECT file2 FROM co_pairs WHERE n >= 2) GROUP BY 1)"


@query("tool_run_enrichment", f"{ENRICHED}, deg AS (SELECT id, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT target_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source_id, 0, 1 FROM edges UNION ALL SELECT file2, 1, 0 FROM co_pairs WHERE n >= 2 UNION ALL SELECT file1, 0, 1 FROM co_pairs WHERE n >= 2) GROUP BY 1) SELECT n.id, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out, coalesce(fan_in, 0) / (coalesce(fan_out, 0) + 1.0::DOUBLE) AS anchor_score, coalesce(partners, 0)::BIGINT AS co_change_count FROM nodes n LEFT JOIN deg USING (id) LEFT JOIN mates USING (id)")
def _(spark, sf_dir):
    return tools.call("run_enrichment", tables.graph(spark, sf_dir, co_changes=True)).nodes.select("id", "fan_in", "fan_out", "anchor_score", "co_change_count")


FILE_COMMITS = "file_commits AS (SELECT DISTINCT 'order:' || l_orderkey AS id, s_path AS file, 'supplier:' || l_suppkey AS node FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey)"


def file_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.graph(spark, sf_dir).nodes.where("node_type = 'File'").select(F.expr("try_cast(substring(id, 10) as bigint)").alias("l_suppkey"), "path")
    lines = tables.table(spark, sf_dir, "lineitem").join(files, "l_suppkey").groupBy(F.concat(F.lit("order:"), "l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    return tables.commits(spark, sf_dir).drop("files").join(lines, "id")


@query("tool_sync_state", f"{G}, {FILE_COMMITS}, newest AS (SELECT DISTINCT c.id, t.time FROM file_commits c JOIN ({NEWEST}) t USING (id) ORDER BY t.time DESC, c.id LIMIT 100) SELECT a.node AS source_id, b.node AS target_id, count(*)::DOUBLE AS weight FROM file_commits a JOIN file_commits b ON a.id = b.id AND a.file < b.file WHERE a.id IN (SELECT id FROM newest) GROUP BY 1, 2")
def _(spark, sf_dir):
    synced = tools.call("sync_state", tables.graph(spark, sf_dir), commits=file_commits(spark, sf_dir))
    return synced.edges.where("edge_type = 'CoChangedWith'").select("source_id", "target_id", "weight")


@query("tool_sync_state_known", f"{G} SELECT 0::BIGINT AS n, count(*) AS edges FROM edges")
def _(spark, sf_dir):
    commits = file_commits(spark, sf_dir)
    synced = tools.call("sync_state", tables.graph(spark, sf_dir), commits=commits, last=cochange.head(commits).first()["id"])
    return synced.edges.agg(F.count_if(F.col("edge_type") == "CoChangedWith").alias("n"), F.count("*").alias("edges"))


@query("tool_context_depth", f"{G} SELECT n.id, n.name, 1::BIGINT AS depth_from_main FROM nodes n JOIN edges e ON e.target_id = n.id JOIN nodes r ON e.source_id = r.id WHERE n.id = 'nation:7' AND r.name = 'ASIA'")
def _(spark, sf_dir):
    return tools.call("get_context_depth", metrics.enrich(tables.graph(spark, sf_dir), ("ASIA",)), symbol="nation:7")


@query("tool_context_for_prompt", f"""{G}, me AS (SELECT * FROM nodes WHERE id = 'part:3'),
ins AS (SELECT coalesce(string_agg(name, ', ' ORDER BY name), '') AS t FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE edge_type = 'Calls' AND target_id = 'part:3')),
outs AS (SELECT coalesce(string_agg(name, ', ' ORDER BY name), '') AS t FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE edge_type = 'Calls' AND source_id = 'part:3'))
SELECT concat_ws(chr(10), name, signature, docstring, path, 'callers: ' || ins.t, 'callees: ' || outs.t, 'changes with: ') AS context FROM me, ins, outs""")
def _(spark, sf_dir):
    return tools.call("get_context_for_prompt", tables.graph(spark, sf_dir), symbol="part:3").select("context")


@query("tool_test_template", f"{G} SELECT '#[cfg(test)]' || chr(10) || 'mod ' || m || ' {{' || chr(10) || '    use super::*;' || chr(10) || chr(10) || '    #[test]' || chr(10) || '    fn test_part:5() {{' || chr(10) || '        // assert the result' || chr(10) || '    }}' || chr(10) || '}}' || chr(10) AS template FROM (SELECT replace(replace(string_split(path, '/')[-1], '.rs', ''), '-', '_') AS m FROM nodes WHERE id = 'part:5')".replace("{{", "{").replace("}}", "}"))
def _(spark, sf_dir):
    return tools.call("get_test_template", tables.graph(spark, sf_dir), function_name="part:5")


# lookups, traversal, scalar functions
@query("find_by_path", f"{G} SELECT id FROM nodes WHERE path = (SELECT path FROM nodes WHERE id = 'supplier:3')")
def _(spark, sf_dir):
    nodes = tables.graph(spark, sf_dir).nodes
    return resolve.by_path(nodes, nodes.where("id = 'supplier:3'").first()["path"]).select("id")


@query("resolve_at_line", f"{G} SELECT arg_min(n.id, (n.line_end - n.line_start, n.id)) AS id FROM nodes n, (SELECT path, line_start FROM nodes WHERE id = 'part:3') p WHERE n.path = p.path AND n.node_type <> 'File' AND p.line_start BETWEEN coalesce(n.line_start, 0) AND coalesce(n.line_end, 0)")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    at = g.nodes.where("id = 'part:3'").first()
    return resolve.at_line(g, at["path"], at["line_start"]).select("id")


@query("handlers", "SELECT form AS name, 'part:' || p_partkey AS id FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'part_' || p_partkey WHEN 1 THEN 'Part_' || p_partkey ELSE 'part__' || p_partkey END AS form FROM part) WHERE p_partkey % 3 <> 2")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    names = tables.table(spark, sf_dir, "part").select(F.concat(F.when(key % 3 == 0, "part_").when(key % 3 == 1, "Part_").otherwise("part__"), key).alias("name"))
    return resolve.handlers(names, tables.graph(spark, sf_dir).nodes)


@query("bfs", f"""{G}, start AS (SELECT source_id AS id FROM edges WHERE edge_type = 'Calls' ORDER BY 1 LIMIT 1),
one AS (SELECT DISTINCT target_id AS id FROM edges WHERE source_id IN (SELECT id FROM start)),
two AS (SELECT DISTINCT target_id AS id FROM edges WHERE source_id IN (SELECT id FROM one) AND target_id NOT IN (SELECT id FROM one))
SELECT id, depth FROM (SELECT id, 1::BIGINT AS depth FROM one UNION ALL SELECT id, 2 FROM two)""")
def _(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    start = g.edges.where("edge_type = 'Calls'").agg(F.min("source_id")).first()[0]
    return traverse.bfs(g, start, 2).select("id", "depth").distinct()


@query("snake_and_camel", "SELECT c_custkey, 'cust_omer_' || c_custkey || '_of_' || c_nationkey AS snake, 'custOmerOf' || c_nationkey AS camel FROM customer")
def _(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    raised = F.concat(F.lit("CustOmer_"), "c_custkey", F.lit("_Of_"), "c_nationkey")
    lowered = F.concat(F.lit("cust_omer__of_"), "c_nationkey")
    return c.select("c_custkey", F.regexp_replace(text.snake_case(raised), "_+", "_").alias("snake"), text.camel_case(lowered).alias("camel"))


@query("ages", "SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age, CASE WHEN s < 5 THEN 'live' WHEN s < 60 THEN 'recent' ELSE 'stale' END AS freshness FROM (SELECT o_orderkey, (o_orderkey * o_orderkey) % 400000 AS s FROM orders)")
def _(spark, sf_dir):
    s = F.col("o_orderkey") * F.col("o_orderkey") % 400000
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", text.age_text(s).alias("age"), text.freshness(s).alias("freshness"))


@query("token_estimates", r"SELECT doc_id, 2::BIGINT * len(w) AS tokens, CASE WHEN 2 * len(w) > 40 THEN array_to_string(w[1:20], ' ') ELSE text END AS cut FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL)")
def _(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.token_estimate(F.col("text")).cast("bigint").alias("tokens"), text.truncate_words(F.col("text"), 40).alias("cut"))


@query("uuid5_ids", f"{G}, h AS (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(node_type || ':' || path || ':' || name)) AS h FROM nodes) SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[1 + (strpos('0123456789abcdef', h[17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS uuid FROM h")
def _(spark, sf_dir):
    nodes = tables.graph(spark, sf_dir).nodes
    return nodes.select("id", fn.node_id(F.col("node_type"), F.col("path"), F.col("name")).alias("uuid"))
