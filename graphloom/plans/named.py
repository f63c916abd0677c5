"""Named queries, and the catalogue of what queries can name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ops import Connect, Filter, Find
from .selectors import OneOf, SpecError, edge_selector


def _calls(direction: str, least: int = 1, most: int = 1) -> Connect:
    return Connect(edge_selector("Calls"), direction, least, most)


def _type(name: str) -> Find:
    return Find(type=OneOf((name,)))


# fixed values: the named queries and what they expand to; ``Defines`` stands for Contains here
NAMED = {
    "get_blast_radius": (Find(), _calls("outgoing", 1, 2), _calls("incoming", 1, 2)),
    "get_call_chain": (Find(), _calls("outgoing", 1, 10)),
    "get_file_functions": (_type("File"), Connect(edge_selector("Contains"), target=_type("Function"))),
    "get_function_imports": (_type("Function"), Connect(edge_selector("Import"))),
    "get_callers": (Find(), _calls("incoming")),
    "get_callees": (Find(), _calls("outgoing")),
    "get_module_functions": (_type("Module"), Connect(edge_selector("Contains"), least=1, most=2, target=_type("Function"))),
    "get_test_coverage": (_type("Function"), Connect(edge_selector("TestedBy"), "incoming")),
    "get_deprecated_functions": (Find(type=OneOf(("Function",)), label=OneOf(("deprecated",))),),
}


def named_ops(name: str) -> tuple[Find | Connect | Filter, ...]:
    if name not in NAMED:
        raise SpecError(f"unknown named query {name!r}")
    return NAMED[name]


# fixed values: what describe_schema lists
DESCRIBED_NODES = (
    ("File", "Source file"),
    ("Function", "Function or method"),
    ("Class", "Class or struct"),
    ("Module", "Module or namespace"),
    ("Variable", "Variable or constant"),
)
DESCRIBED_EDGES = (
    ("Calls", "A function calls another"),
    ("Contains", "A container holds a symbol"),
    ("Uses", "A symbol uses a type"),
    ("Implements", "A type implements another"),
    ("Imports", "A file imports another"),
    ("CoChangedWith", "Two files change together"),
    ("Pattern", "Two places share a literal"),
    ("CallsHttp", "A route reaches its handler"),
)
EXAMPLES = (
    '{"ops":[{"op":"find","type":"Function","name":"main"}]}',
    '{"ops":[{"op":"find","type":"Function"},{"op":"connect","edge":"Calls","depth":{"min":1,"max":2}}]}',
    '{"ops":[{"op":"find","type":"Function","label":"deprecated"}]}',
    '{"ops":[{"op":"find","type":["File","Class"]},{"op":"group","by":"type"}]}',
    '{"ops":[{"op":"find","name":{"glob":"get_*"}},{"op":"sort","by":"name"},{"op":"limit","count":10}]}',
)


def describe_schema(spark: SparkSession) -> DataFrame:
    """(kind, name, description)."""
    rows = [("node", *x) for x in DESCRIBED_NODES] + [("edge", *x) for x in DESCRIBED_EDGES]
    rows += [("example", str(i), x) for i, x in enumerate(EXAMPLES, 1)]
    return spark.createDataFrame(rows, "kind string, name string, description string")
