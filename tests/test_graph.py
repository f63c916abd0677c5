import random
import uuid

import pytest
from graphs import ids, small
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.graph import PropertyGraph
from graphloom.operators import cochange, dml, metrics, resolve, tools, traverse
from graphloom.sources import storage


def test_degrees_count_parallel_edges(spark):
    g = small(spark)
    g = PropertyGraph(g.nodes, g.edges.union(g.edges.where("source_id = 'a'")))
    e = metrics.enrich(g, ("main",))
    rows = {r["id"]: r for r in e.nodes.collect()}
    assert (rows["b"]["fan_in"], rows["b"]["fan_out"]) == (3, 1)
    assert rows["y"]["anchor_score"] == 0 and rows["b"]["anchor_score"] == 1.5
    assert sum(r["fan_in"] for r in rows.values()) == sum(r["fan_out"] for r in rows.values()) == g.edges.count()
    assert rows["main"]["depth_from_main"] == 0 and rows["a"]["depth_from_main"] is None


def test_ids_are_version_5_uuids(spark):
    rows = spark.createDataFrame([("File", "/a/b.rs", "b.rs"), ("Function", "é", "名")], "t string, p string, n string")
    got = rows.select("t", "p", "n", fn.node_id(F.col("t"), F.col("p"), F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['t']}:{r['p']}:{r['n']}")) for r in got)


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    got = [round(r[0], 9) for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(fn.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0, -1.0]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(fn.snake_case(F.lit("getUserName"))) == "get_user_name"
    assert get(fn.camel_case(F.lit("get_user_name"))) == "getUserName"
    assert get(fn.return_type(F.lit("fn f() -> Vec<u8>"))) == "Vec"
    assert get(fn.return_type(F.lit("fn f()"))) == "()"
    assert get(fn.enriched_text(F.lit("n"), F.lit(""), F.lit(None).cast("string"), F.lit("p"))) == "n | p"
    assert [get(fn.age_text(F.lit(s))) for s in (5, 65, 7200, 200000)] == ["5s", "1m", "2h", "2d"]
    assert [get(fn.semantic_candidate(F.lit(v))) for v in ("/api/v1", "/a", "USER_TOPIC", "USER_NAME", "wss://x", "$HOME", "ab")] == [True, False, True, False, True, True, False]
    assert get(fn.truncate_words(F.lit("a b c d"), 4)) == "a b"


def brute_reach(edges, starts, most):
    met, frontier = {}, set(starts)
    for d in range(1, most + 1):
        frontier = {b for a, b in edges if a in frontier} - met.keys()
        met.update(dict.fromkeys(frontier, d))
    return met


@pytest.mark.parametrize("seed", range(4))
def test_reach_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    steps = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "source string, target string")
    starts = spark.createDataFrame([("0",), ("3",)], "id string")
    got = {r["id"]: r["depth"] for r in traverse.reach(starts, steps, 5).collect()}
    assert got == {str(k): v for k, v in brute_reach(edges, {0, 3}, 5).items()}


def test_paths_and_closures(spark):
    g = small(spark)
    chain = lambda a, b: [r["id"] for r in traverse.call_chain(g, a, b).orderBy("position").collect()]
    assert chain("main", "c") == ["main", "a", "b", "c"]
    assert chain("main", "main") == ["main"] and chain("c", "main") == [] and chain("main", "y") == []
    radius = {r["id"]: (r["depth"], r["is_direct"]) for r in traverse.blast_radius(g, "b").collect()}
    assert radius == {"a": (0, True), "x": (0, True), "main": (1, False), "file": (2, False)}
    assert ids(traverse.trace_dependency(g, "a")) == {"a", "b", "c"}
    assert ids(traverse.bfs(g, "main", 2)) == {"a", "x", "b"}


def test_closures_and_paths_end_at_no_depth(spark):
    n = 203  # edges; closures ended after 200
    name = lambda i: f"n{i:03}"
    nodes = spark.createDataFrame([(name(i), "Function", name(i), "/p") for i in range(n + 1)], "id string, node_type string, name string, path string")
    edges = spark.createDataFrame([("Calls", name(i), name(i + 1)) for i in range(n)], "edge_type string, source_id string, target_id string")
    g = PropertyGraph.of(nodes.coalesce(1), edges.coalesce(1))
    steps = g.steps().coalesce(1)
    assert {r["id"]: r["depth"] for r in traverse.reach(spark.createDataFrame([(name(0),)], "id string"), steps).collect()} == {name(i): i for i in range(1, n + 1)}
    assert [r["id"] for r in traverse.call_chain(g, name(0), name(n)).orderBy("position").collect()] == [name(i) for i in range(n + 1)]
    assert ids(traverse.reach(spark.createDataFrame([(name(0),)], "id string"), steps, 2)) == {name(1), name(2)}


def test_overlay(spark):
    g = small(spark)
    over = spark.createDataFrame([("a", "Function", "a2", "/n"), ("z", "Function", "z", "/z")], "id string, node_type string, name string, path string")
    edges = spark.createDataFrame([("Calls", "a", "z"), ("Calls", "a", "b")], "edge_type string, source_id string, target_id string")
    both = g.with_overlay(over, edges)
    assert {r["name"] for r in both.merged().nodes.where("id = 'a'").collect()} == {"a2"}
    assert {r["name"] for r in both.base_first().where("id = 'a'").collect()} == {"a"}
    assert both.merged().edges.count() == 7
    assert both.without_overlay().overlay_nodes is None
    for handle, wanted in (("a2", "a"), ("z", "z"), ("main", "main"), ("/src/main.rs", "file")):
        assert resolve.resolve(both, handle).first()["id"] == wanted
    assert resolve.resolve(both, "nothing").count() == 0


def test_writes(spark):
    g = small(spark)
    ghost = spark.createDataFrame([("a", "Function", "ghost", "/g", False), ("n", "Function", "n", "/n", False)], "id string, node_type string, name string, path string, is_hydrated boolean")
    up = dml.upsert(g, ghost)
    assert up.nodes.where("id = 'a'").first()["name"] == "a" and up.nodes.count() == 8
    real = ghost.withColumn("is_hydrated", F.lit(True))
    assert dml.upsert(up, real).nodes.where("id = 'a'").first()["name"] == "ghost"
    lost = spark.createDataFrame([("Calls", "a", "nowhere"), ("Calls", "a", "y")], "edge_type string, source_id string, target_id string")
    assert dml.insert_edges(g, lost).edges.count() == 7
    with pytest.raises(dml.MissingEndpoint):
        dml.insert_edges(g, lost, strict=True)


def test_positions(spark):
    nodes = [("f", "File", "f", "/p", None, None), ("out", "Class", "out", "/p", 1, 100), ("in", "Function", "in", "/p", 10, 20)]
    g = PropertyGraph.of(spark.createDataFrame(nodes, "id string, node_type string, name string, path string, line_start int, line_end int"), small(spark).edges)
    assert [resolve.at_line(g, "/p", n).first()["id"] for n in (5, 10, 20, 21)] == ["out", "in", "in", "out"]
    assert resolve.at_line(g, "/q", 5).count() == 0


def test_co_change(spark):
    commits = spark.createDataFrame([("1", "m", ["a", "b", "b"], 1), ("2", "m", ["b", "a"], 2), ("3", "m", ["a", "c"], 3), ("4", "m", [str(i) for i in range(101)], 4), ("5", "m", None, 5)], "id string, message string, files array<string>, time bigint")
    assert [tuple(r) for r in cochange.cochange_pairs(commits).collect()] == [("a", "b", 2)]
    assert cochange.cochange_pairs(commits, least=1).count() == 2
    assert ids(cochange.since(commits, "3")) == {"4", "5"}
    assert {r["path"] for r in cochange.changed_since(commits, "2").where("length(path) = 1 and path >= 'a'").collect()} == {"a", "c"}


def test_storage_round_trip(spark, tmp_path):
    g, path = small(spark), f"file://{tmp_path}/graph"
    storage.save(g, path)
    storage.save(g, path)
    back = storage.load(spark, path)
    assert sorted(map(str, back.nodes.collect())) == sorted(map(str, g.nodes.collect()))
    assert sorted(map(str, back.edges.collect())) == sorted(map(str, g.edges.collect()))
    assert storage.to_json(g).count() == 13
    assert storage.last_commit(spark, f"file://{tmp_path}/meta") is None
    storage.set_last_commit(spark, f"file://{tmp_path}/meta", "abc")
    assert storage.last_commit(spark, f"file://{tmp_path}/meta") == "abc"


def test_tools(spark):
    g = metrics.enrich(small(spark), ("main",))
    assert ids(tools.call("trace_dependency", g, symbol="x")) == {"x", "b", "c"}
    assert tools.call("get_health", g).first()["node_count"] == 7
    assert "fn test_a" in tools.call("get_test_template", g, function_name="a").first()[0]
    assert tools.call("get_context_for_prompt", g, symbol="b").first()["context"].startswith("b")
    assert ids(tools.call("find_untested_functions", g)) == {"y"}
    assert ids(tools.call("find_dead_code", g)) == {"y"}
    assert tools.call("get_coverage_summary", g).first()["untested"] == 1
    with pytest.raises(LookupError):
        tools.call("explain_symbol", g, symbol="nothing")
    assert len(tools.TOOLS) >= 35
