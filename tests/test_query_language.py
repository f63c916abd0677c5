import json

import pytest
from graphs import ids, small

from graphloom.plans.named import NAMED
from graphloom.plans.ops import Executor, Spec, explain
from graphloom.plans.selectors import Name, SpecError


def run(spark, *ops, **more):
    return Executor(small(spark)).run({"ops": list(ops), **more})


def test_counts_of_the_small_graph(spark):
    main = {"op": "find", "name": "main"}
    calls = lambda depth=1, **k: {"op": "connect", "edge": "Calls", "depth": depth, **k}
    between = {"min": 1, "max": 2}
    assert run(spark, {"op": "find", "type": "Function"}).count() == 6
    assert run(spark, main).count() == 1
    assert run(spark, {"op": "find", "type": "Class"}).count() == 0
    assert ids(run(spark, main, calls()).nodes) == {"a", "x"}
    assert ids(run(spark, main, calls(between)).nodes) == {"a", "x", "b"}
    assert ids(run(spark, main, calls(between), {"op": "filter", "name": "a"}).nodes) == {"a"}
    assert run(spark, {"op": "find", "type": ["Function", "File"]}).count() == 7
    assert run(spark, {"op": "find", "path": "main.rs"}).count() == 2
    assert run(spark, main, {"op": "connect", "edge": {"not": ["Calls"]}}).count() == 0
    assert run(spark, {"op": "find", "name": "c"}, calls()).count() == 0
    assert run(spark, {"op": "find"}, {"op": "sort", "by": "name"}, {"op": "limit", "count": 3}).count() == 3
    assert run(spark, {"op": "find", "type": "Function"}, {"op": "sort", "by": "name"}, {"op": "limit", "count": 3, "offset": 4}).count() == 2


def test_depth_is_the_shortest_distance(spark):
    main = {"op": "find", "name": "main"}
    at = lambda depth, direction="outgoing": ids(run(spark, main, {"op": "connect", "edge": "Calls", "depth": depth, "direction": direction}).nodes)
    assert at(2) == {"b"} and at(3) == {"c"} and at(4) == set()
    assert at(1, "incoming") == set()


def test_target_label_and_names(spark):
    file = {"op": "find", "type": "File"}
    assert ids(run(spark, file, {"op": "connect", "edge": "Contains", "target": {"type": "Function"}}).nodes) == {"main"}
    assert run(spark, file, {"op": "connect", "edge": "Contains", "target": {"type": "Class"}}).count() == 0
    assert ids(run(spark, {"op": "find", "label": "deprecated"}).nodes) == {"c"}
    assert run(spark, {"op": "find", "label": {"not": ["deprecated"]}}).count() == 6
    assert ids(run(spark, {"op": "find", "name": {"glob": "m?in"}}).nodes) == {"main"}
    assert ids(run(spark, {"op": "find", "name": {"glob": "main.*"}}).nodes) == {"file"}
    assert ids(run(spark, {"op": "find", "id": "x"}).nodes) == {"x"}


def test_groups_sorts_and_json(spark):
    out = run(spark, {"op": "find"}, {"op": "group", "by": "type"}, {"op": "sort", "by": "label", "direction": "asc"})
    assert {r["key"]: r["count"] for r in out.groups.collect()} == {"Function": 6, "File": 1}
    assert out.nodes.collect()[-1]["id"] == "c"  # nulls come first
    shown = json.loads(out.to_json())
    assert shown["count"] == 7 and len(shown["groups"]) == 2


def test_spec_forms_and_errors():
    bare = {"ops": [{"op": "find"}]}
    assert Spec.parse({"query": bare}) == Spec.parse({"spec": bare}) == Spec.parse(json.dumps(bare)) == Spec.parse(bare)
    for bad in ({"ops": [{"op": "jump"}]}, {"ops": [{"op": "connect"}]}, {"ops": [{"op": "find", "name": {"exact": "a", "glob": "b"}}]}, {"ops": [{"op": "sort", "by": "size"}]}, {"ops": [{"op": "connect", "edge": "Calls", "depth": {"min": 3, "max": 1}}]}, {"ops": [{"op": "limit", "count": -1}]}, {"ops": {}}, {"mode": "fast"}):
        with pytest.raises(SpecError):
            Spec.parse(bad)
    assert Name.parse({"startsWith": "a"}) == Name.parse({"starts_with": "a"})


def test_named_queries(spark):
    run_named = lambda name: ids(Executor(small(spark)).run({"named": name}).nodes)
    assert run_named("get_callers") == {"main", "a", "b", "x"}
    assert run_named("get_callees") == {"a", "b", "c", "x"}
    assert run_named("get_deprecated_functions") == {"c"}
    assert run_named("get_file_functions") == {"main"}
    assert run_named("get_test_coverage") == set()
    assert set(NAMED) >= {"get_blast_radius", "get_call_chain", "get_module_functions", "get_function_imports"}
    with pytest.raises(SpecError):
        Executor(small(spark)).run({"named": "nothing"})


def test_explain():
    steps = explain({"ops": [{"op": "connect", "edge": "Calls"}, {"op": "limit", "count": 1}]})
    assert steps[0].startswith("1. connect") and steps[1].startswith("warning") and steps[2].startswith("2. limit")


def test_semantic_filter(spark):
    from pyspark.sql import functions as F

    from graphloom.graph import PropertyGraph

    g = small(spark)
    nodes = g.nodes.withColumn("embedding", F.when(F.col("id") == "a", F.array(F.lit(1.0), F.lit(0.0))).when(F.col("id") == "b", F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    found = Executor(PropertyGraph(nodes, g.edges), embed=lambda t: [1.0, 0.1], on_demand=False).run({"ops": [{"op": "find"}, {"op": "semantic_filter", "like": "a"}]})
    assert ids(found.nodes) == {"a"}
    found = Executor(PropertyGraph(nodes, g.edges), embed=lambda t: [1.0, 0.1]).run({"ops": [{"op": "find"}, {"op": "semantic_filter", "like": "a"}]})
    assert ids(found.nodes) == ids(g.nodes) - {"b"}  # what has no vector gets one from its text; stored ones stand
    assert run(spark, {"op": "find"}, {"op": "semantic_filter", "like": "a"}).count() == 0
