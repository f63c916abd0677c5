"""The property graph's record types."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: the vocabularies of node and edge types
NODE_TYPES = (
    "File", "Namespace", "Module", "Package", "Class", "Interface", "Struct", "Enum", "Trait",
    "Function", "Method", "Property", "Variable", "Constant", "HttpRoute", "Topic", "Resource", "Schema",
)
EDGE_TYPES = (
    "Contains", "Calls", "Uses", "Implements", "Imports", "CoChangedWith", "Pattern", "CallsHttp",
    "Produces", "Consumes", "DeployedTo",
)

#: Other names that selectors accept for an edge type.
EDGE_ALIASES = {"CO_CHANGED_WITH": "CoChangedWith", "Import": "Imports"}
#: Names without a counterpart: they select nothing.
UNKNOWN_EDGES = ("Defines", "Inherits", "TestedBy", "AnchoredAt")

NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("node_type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("signature", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("fan_in", T.IntegerType()),
        T.StructField("fan_out", T.IntegerType()),
        T.StructField("anchor_score", T.DoubleType()),
        T.StructField("depth_from_main", T.IntegerType()),
        T.StructField("co_change_count", T.LongType()),
        T.StructField("is_deprecated", T.BooleanType(), False),
        T.StructField("last_lsp_sync", T.LongType()),
        T.StructField("last_git_sync", T.LongType()),
        T.StructField("commit_hash", T.StringType()),
        T.StructField("is_hydrated", T.BooleanType(), False),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("edge_type", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("weight", T.DoubleType()),
    ]
)
DIAGNOSTICS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("code", T.StringType()),
    ]
)
COMMITS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("message", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("time", T.LongType()),
    ]
)
DEFAULTS = {"is_deprecated": False, "is_hydrated": True}


def conform(df, schema: T.StructType = NODES):
    """df with exactly the schema's columns: missing ones are null or their default, others go."""
    from pyspark.sql import functions as F

    columns = []
    for f in schema.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        if f.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]))
        columns.append(value.alias(f.name))
    return df.select(*columns)
