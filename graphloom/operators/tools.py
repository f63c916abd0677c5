"""The registry of named tools: each maps arguments to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import return_type
from ..graph import PropertyGraph
from . import architecture, cochange, impact, metrics, patterns, resolve, semantic, traverse

READ, STRUCTURE, MUTATE = "ReadOnly", "StructuralWrite", "Mutating"


@dataclass(frozen=True)
class Tool:
    name: str
    capability: str
    call: Callable


TOOLS: dict[str, Tool] = {}


def tool(name: str, capability: str = READ):
    """Registers a function of a graph and keyword arguments."""

    def add(f):
        TOOLS[name] = Tool(name, capability, f)
        return f

    return add


def call(name: str, graph: PropertyGraph, **arguments) -> DataFrame | PropertyGraph | dict:
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}")
    return TOOLS[name].call(graph, **arguments)


def found(graph: PropertyGraph, handle: str) -> str:
    """The id that a handle means; an error if nothing has it."""
    row = resolve.resolve(graph, handle).first()
    if row is None:
        raise LookupError(f"nothing is called {handle!r}")
    return row["id"]


tool("explore_architecture")(lambda g, max_depth=2: metrics.explore_architecture(g, max_depth))
tool("list_entry_points")(metrics.entry_points)
tool("compare_modules")(lambda g, module_a, module_b: architecture.compare_modules(g, found(g, module_a), found(g, module_b)))
tool("trace_dependency")(lambda g, symbol: traverse.trace_dependency(g, found(g, symbol)))
tool("get_call_chain")(lambda g, from_, to: traverse.call_chain(g, found(g, from_), found(g, to)))
tool("navigate_to_anchor")(lambda g, symbol: traverse.navigate_to_anchor(g, found(g, symbol)))
tool("get_layered_map")(traverse.layered_map)
tool("get_master_map")(architecture.master_map)
tool("get_blast_radius")(lambda g, symbol, include_coupling=False: impact.blast_radius(g, found(g, symbol), include_coupling))
tool("get_coupling_radar")(lambda g, symbol: cochange.partners(g, found(g, symbol)))
tool("find_anchors")(metrics.top_anchors)
tool("get_anchor_score")(lambda g, symbol: metrics.anchor_score(g, found(g, symbol)))
tool("get_context_depth")(lambda g, symbol: metrics.context_depth(g, found(g, symbol)))
tool("find_dead_code")(metrics.dead_code)
tool("explain_symbol")(lambda g, symbol: impact.explain_symbol(g, found(g, symbol)))
tool("suggest_refactor_targets")(metrics.refactor_targets)
tool("get_cross_runtime_callers")(lambda g, node_id: resolve.cross_runtime_callers(g, node_id))
tool("get_context_for_prompt")(lambda g, symbol, max_tokens=2000: impact.context_for_prompt(g, found(g, symbol), max_tokens))
tool("get_call_sites")(lambda g, symbol: resolve.call_sites(g, found(g, symbol)))
tool("find_untested_functions")(metrics.untested)
tool("get_coverage_summary")(lambda g, module_path=None: metrics.coverage(g, module_path))
tool("run_enrichment", STRUCTURE)(lambda g: metrics.enrich(g, ("main", "App")))


@tool("architectural_observations")
def observations(graph: PropertyGraph, min_fan_out: int = 50) -> dict[str, DataFrame]:
    return {"high_fan_out": patterns.high_fan_out(graph, min_fan_out), "boundary_pairs": patterns.boundary_pairs_of(graph)}


@tool("semantic_search")
def search(graph: PropertyGraph, query: str, limit: int = 10, embed: Callable = semantic.hashed_embedding) -> DataFrame:
    return semantic.semantic_search(graph, embed(query), limit, model=semantic.batches_of(embed))


@tool("query_graph")
def query_graph(graph: PropertyGraph, query, embed: Callable | None = None):
    from ..plans.ops import Executor

    return Executor(graph, embed=embed).run(query).nodes


@tool("describe_schema")
def describe(graph: PropertyGraph) -> DataFrame:
    from ..plans.named import describe_schema

    return describe_schema(graph.spark)


@tool("sync_state", STRUCTURE)
def sync_state(graph: PropertyGraph, commits: DataFrame, last: str | None = None) -> PropertyGraph:
    """Co-change edges anew from all commits, without a least count, unless the latest commit is known."""
    from .dml import replace_edges

    latest = cochange.head(commits).first()
    if latest is None or latest["id"] == last:
        return graph
    pairs = cochange.cochange_pairs(commits, least=1)
    return metrics.enrich(replace_edges(graph, "CoChangedWith", cochange.cochange_edges(pairs, graph.nodes)), ("main", "App"))


@tool("get_code_snippet")
def code_snippet(graph: PropertyGraph, files: DataFrame, path: str, line: int | None = None, context_lines: int = 10) -> DataFrame:
    """The symbol at a line if there is one, else the lines around it, else the file's first lines."""
    if line is not None:
        at = resolve.at_line(graph, path, line).first()
        if at is not None:
            return impact.symbol_snippets(files, graph.merged().nodes.where(F.col("id") == at["id"]))
    return impact.snippet(files, path, line or 1, context_lines)


@tool("get_commit_history")
def commit_history(graph: PropertyGraph, commits: DataFrame, limit: int = 20) -> DataFrame:
    return cochange.recent(commits, limit)


@tool("get_branch_status")
def branch_status(graph: PropertyGraph, commits: DataFrame) -> DataFrame:
    return cochange.head(commits)


@tool("get_file_diff")
def file_diff(graph: PropertyGraph, staged: DataFrame, unstaged: DataFrame, untracked: DataFrame, path: str | None = None) -> DataFrame:
    """Uncommitted changes (path, change, staged), duplicates kept (S3); their texts are from ``difftext.file_diffs``."""
    rows = staged.select("path", "change", F.lit(True).alias("staged")).union(unstaged.select("path", "change", F.lit(False))).union(untracked.select("path", F.lit("Added"), F.lit(False)))
    return rows if path is None else rows.where(F.col("path") == path)


def _log_tool(name: str, default: str) -> None:
    @tool(name, MUTATE)
    def run(graph: PropertyGraph, logs: DataFrame, parser: str = default) -> dict[str, DataFrame]:
        """Reads logs of a run; running commands is the caller's."""
        from .diagnostics import decorate

        return decorate(graph, logs, parser)


for _name, _parser in (("run_build", "cargo-json"), ("run_tests", "cargo-test"), ("run_clippy", "cargo-json")):
    _log_tool(_name, _parser)


@tool("get_test_template")
def test_template(graph: PropertyGraph, function_name: str) -> DataFrame:
    """(template): the scaffold of a test for a symbol, by its type."""
    node = graph.merged().nodes.where(F.col("id") == found(graph, function_name))
    module = F.replace(F.replace(F.substring_index("path", "/", -1), F.lit(".rs"), F.lit("")), F.lit("-"), F.lit("_"))
    plain = F.replace(F.lit(function_name), F.lit("::"), F.lit("_"))
    asks = F.when((F.col("node_type") == "Function") & (return_type(F.coalesce("signature", F.lit(""))) != "()"), F.lit("        // assert the result\n")).otherwise(F.lit(""))
    names = (
        F.when(F.col("node_type") == "Struct", F.array(F.concat(module, F.lit("_new")), F.concat(module, F.lit("_default"))))
        .when(F.col("node_type") == "Enum", F.array(F.concat(module, F.lit("_variants"))))
        .otherwise(F.array(plain))
    )
    tests = F.array_join(F.transform(names, lambda n: F.concat(F.lit("    #[test]\n    fn test_"), n, F.lit("() {\n"), asks, F.lit("    }\n"))), "\n")
    return node.select(F.concat(F.lit("#[cfg(test)]\nmod "), module, F.lit(" {\n    use super::*;\n\n"), tests, F.lit("}\n")).alias("template"))


@tool("get_health")
def health(graph: PropertyGraph, last_commit: str | None = None) -> DataFrame:
    """(node_count, edge_count, overlay_count, last_commit)."""
    overlay = graph.overlay_nodes if graph.overlay_nodes is not None else graph.nodes.where(F.lit(False))
    return graph.stats().crossJoin(overlay.agg(F.count("*").alias("overlay_count"))).withColumn("last_commit", F.lit(last_commit).cast("string"))
