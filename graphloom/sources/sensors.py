"""Routes, services and endpoints that other runtimes reach."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import node_id
from ..operators.resolve import handlers
from ..schema import EDGES, NODES, conform

METHODS = ("get", "post", "put", "delete", "patch")
OPERATION = "struct<operationId:string,operation_id:string,summary:string>"


def _lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "raw"))
    return rows.select("path", (F.col("n") + 1).alias("line"), "raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("code"))


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError:
        yaml = None
    for batch in batches:
        texts = []
        for text in batch["text"]:
            try:
                texts.append(json.dumps(yaml.safe_load(text), default=str) if yaml else simple_yaml(text))
            except Exception:  # a file that can't be read has no operations
                texts.append(None)
        yield pd.DataFrame({"path": batch["path"], "text": texts})


def simple_yaml(text: str) -> str:
    """The nested mappings of an API description, as JSON: what this module needs of YAML where no reader is there."""
    root: dict = {}
    stack = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith(("#", "- ", "---")) or ":" not in line:
            continue
        indent = len(line) - len(line.lstrip())
        head, _, value = line.strip().partition(": ") if ": " in line.strip() else line.strip().rpartition(":")[::1]
        key = (head or line.strip()).rstrip(":").strip("\"'")
        while stack[-1][0] >= indent:
            stack.pop()
        if value:
            stack[-1][1][key] = value.strip("\"'")
        else:
            stack[-1][1][key] = child = {}
            stack.append((indent, child))
    return json.dumps(root)


def openapi(files: DataFrame) -> DataFrame:
    """(spec_path, method, path, operation_id, summary) of API descriptions (path, text) in JSON or YAML."""
    is_json = F.col("text").rlike(r"^\s*\{")
    texts = files.where(is_json).select("path", "text").union(files.where(~is_json).select("path", "text").mapInPandas(_yaml_to_json, "path string, text string"))
    item = ",".join(f"{m}:{OPERATION}" for m in METHODS)
    spec = texts.select(F.col("path").alias("spec_path"), F.from_json("text", f"struct<paths:map<string,struct<{item}>>>").alias("s"))
    items = spec.select("spec_path", F.explode("s.paths").alias("path", "item"))
    listed = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"item.{m}").alias("op")) for m in METHODS])
    ops = items.select("spec_path", "path", F.explode(listed).alias("o")).where("o.op is not null")
    name = F.coalesce("o.op.operationId", "o.op.operation_id", F.concat_ws(":", "o.method", "path"))
    return ops.select("spec_path", F.upper("o.method").alias("method"), "path", name.alias("operation_id"), F.coalesce("o.op.summary", F.lit("")).alias("summary"))


def _carried(rows: DataFrame, start: Column, end: Column, name: Column) -> DataFrame:
    """rows with ``block``: the name of the block that a line lies in, from its opening line to its closing one."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(start, name).when(end, F.lit(""))
    return rows.withColumn("block", F.last(mark, ignorenulls=True).over(w))


def proto(files: DataFrame) -> DataFrame:
    """(proto_path, package, service, method, input_type, output_type, line) of service files."""
    rows = _lines(files)
    package = rows.where(F.col("code").startswith("package ")).groupBy("path").agg(F.min(F.struct("line", F.trim(F.regexp_extract("code", r"^package\s+([^;]*)", 1)).alias("package"))).alias("p"))
    service = F.trim(F.regexp_extract("code", r"^service\s+([^{]*)", 1))
    rows = _carried(rows, F.col("code").startswith("service "), F.col("code") == "}", service)
    rpc = rows.where(F.col("code").startswith("rpc ") & (F.coalesce("block", F.lit("")) != ""))
    pattern = r"^rpc\s+([^(]*?)\s*\(\s*([^)]*?)\s*\)\s*(?:returns)?\s*\(?\s*([^){;]*)"
    rpc = rpc.select("path", "line", "block", *[F.regexp_extract("code", pattern, i).alias(c) for i, c in ((1, "method"), (2, "input_type"), (3, "output_type"))])
    rpc = rpc.where("method <> '' and input_type <> ''").join(package, "path", "left")
    return rpc.select(F.col("path").alias("proto_path"), F.coalesce("p.package", F.lit("")).alias("package"), F.col("block").alias("service"), "method", "input_type", F.trim("output_type").alias("output_type"), "line")


def graphql(files: DataFrame) -> DataFrame:
    """(schema_path, operation_type, field, type_name, line): operations inside typed blocks and on their own.

    An operation inside a block of a type is listed under that type and, as every operation, under Query.
    """
    rows = _lines(files)
    opens = F.col("code").startswith("type ") & ~F.col("code").contains("{")
    rows = _carried(rows, opens, F.col("code") == "}", F.regexp_extract("code", r"^type\s+(\S+)", 1))
    ops = rows.where(F.col("code").rlike(r"^(query|mutation|subscription) "))
    kind = F.initcap(F.regexp_extract("code", r"^(\w+)", 1))
    field = F.trim(F.regexp_extract("code", r"^\w+\s*([^(]*)", 1))
    inside = ops.where("coalesce(block, '') <> ''").select("path", kind.alias("operation_type"), field.alias("field"), F.col("block").alias("type_name"), "line").where("field <> '' and not startswith(field, '{')")
    alone = ops.select("path", kind.alias("operation_type"), F.regexp_extract("code", r"^\w+ ([^ (]*)", 1).alias("field"), F.lit("Query").alias("type_name"), "line")
    return inside.union(alone).withColumnRenamed("path", "schema_path")


# fixed values: what marks a socket's URL, its constructor and its handlers in a line
SOCKET_URLS = (r'"(wss?://[^"\']+)"', r'new\s+WebSocket\s*\(\s*["\']([^"\']+)["\']')
SOCKET_HANDLER = r"(on(?:open|message|close|error))\s*[=:]\s*(\w+)"


def websocket(files: DataFrame) -> DataFrame:
    """(file_path, url, handler, line): socket URLs, constructors and event handlers."""
    rows = _lines(files)

    def all_of(pattern: str, group: int) -> DataFrame:
        return rows.select("path", "line", F.explode(F.regexp_extract_all("raw", F.lit(pattern), F.lit(group))).alias("found"))

    urls = all_of(SOCKET_URLS[0], 1).union(all_of(SOCKET_URLS[1], 1))
    names = all_of(SOCKET_HANDLER, 2)
    return urls.select(F.col("path").alias("file_path"), F.col("found").alias("url"), F.lit("").alias("handler"), "line").union(names.select("path", F.lit(""), "found", "line"))


# fixed values: (framework, method, path, handler) patterns that one line must fit
ROUTES = (
    ("rust-axum", r"(?i)(get|post|put|delete|patch|options)\s*\(", r'route!\s*\(\s*"([^"]+)"', r"\.handler\(([^)]+)\)"),
    ("rust-actix", r"#\[(get|post|put|delete|patch|options|head)\s*\(", r'path\s*=\s*"([^"]+)"', r"fn\s+(\w+)\s*\("),
    ("python-fastapi", r"@\w+\.(get|post|put|delete|patch|options)\s*\(", r'@[\w\.]+\.(?:get|post|put|delete|patch|options)\s*\(\s*"([^"]+)"', r"async\s+def\s+(\w+)\s*\("),
    ("python-flask", r"@(app|blueprint)\.route\s*\(", r'route\s*\(\s*"([^"]+)"', r"def\s+(\w+)\s*\("),
    ("ts-express", r"\.(get|post|put|delete|patch|options)\s*\(", r'\.get\s*\(\s*"([^"]+)"', r'\.get\s*\(\s*"[^"]+"\s*,\s*(\w+)'),
    ("ts-fastify", r"(get|post|put|delete|patch)\s*\(", r'\.get\s*\(\s*"([^"]+)"', r"handler:\s*(\w+)"),
    ("go-std", r"(Get|Post|Put|Delete|Handle)\s*\(", r'HandleFunc\s*\(\s*"([^"]+)"', r"HandleFunc\s*\([^,]+,\s*(\w+)"),
    ("go-gin", r"(GET|POST|PUT|DELETE|PATCH)\s*\(", r'r\.(?:GET|POST|PUT|DELETE|PATCH)\s*\(\s*"([^"]+)"', r'r\.(?:GET|POST|PUT|DELETE|PATCH)\s*\(\s*"[^"]+"\s*,\s*(\w+)'),
)


def http_routes(files: DataFrame) -> DataFrame:
    """(file_path, method, path, handler, line), one of each method and path of a file, by line and framework."""
    rows = _lines(files)
    found = [
        F.when(
            (F.regexp_extract("raw", path, 1) != "") & (F.regexp_extract("raw", handler, 1) != ""),
            F.struct(F.upper(F.coalesce(F.nullif(F.regexp_extract("raw", method, 1), F.lit("")), F.lit("GET"))).alias("method"), F.regexp_extract("raw", path, 1).alias("path"), F.regexp_extract("raw", handler, 1).alias("handler"), F.lit(i).alias("rank")),
        )
        for i, (_, method, path, handler) in enumerate(ROUTES)
    ]
    routes = rows.select(F.col("path").alias("file_path"), "line", F.explode(F.array_compact(F.array(*found))).alias("r")).select("file_path", "line", "r.*")
    best = routes.groupBy("file_path", "method", "path").agg(F.min(F.struct("line", "rank", "handler")).alias("b"))
    return best.select("file_path", "method", "path", "b.handler", "b.line")


def to_graph(kind: str, found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for what a sensor found: kind is http, openapi, proto, graphql or websocket.

    Routes reach their handlers by CallsHttp; what serves an rpc Implements it; resolvers and handlers Use theirs.
    """
    if kind == "http":
        rows = found.select(F.lit("HttpRoute").alias("node_type"), F.concat_ws(" ", "method", "path").alias("name"), F.col("file_path").alias("path"), F.concat_ws(":", "method", "path").alias("key"), F.col("handler").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.col("line").alias("line_start"), F.col("handler").alias("wanted"))
    elif kind == "openapi":
        rows = found.select(F.lit("HttpRoute").alias("node_type"), F.concat_ws(" ", "method", "path").alias("name"), F.col("spec_path").alias("path"), F.concat_ws(":", "method", found["path"]).alias("key"), F.col("operation_id").alias("signature"), F.nullif("summary", F.lit("")).alias("docstring"), F.lit(None).cast("int").alias("line_start"), F.col("operation_id").alias("wanted"))
    elif kind == "proto":
        # the rpc is part of the key: one node an rpc
        rows = found.select(F.lit("Module").alias("node_type"), F.concat_ws(".", "service", "method").alias("name"), F.col("proto_path").alias("path"), F.concat_ws(".", "package", "service", "method").alias("key"), F.concat_ws(" -> ", "input_type", "output_type").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.col("line").alias("line_start"), F.col("method").alias("wanted"))
    elif kind == "graphql":
        rows = found.select(F.lit("Interface").alias("node_type"), F.concat_ws(": ", "operation_type", "field").alias("name"), F.col("schema_path").alias("path"), F.concat_ws(":", "operation_type", "field").alias("key"), F.col("type_name").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.col("line").alias("line_start"), F.col("field").alias("wanted"))
    elif kind == "websocket":
        shown = F.when(F.col("url") == "", F.concat(F.lit("ws:handler:"), F.col("handler"))).otherwise(F.col("url"))
        rows = found.select(F.lit("Variable").alias("node_type"), shown.alias("name"), F.col("file_path").alias("path"), shown.alias("key"), F.nullif("handler", F.lit("")).alias("signature"), F.lit(None).cast("string").alias("docstring"), F.col("line").alias("line_start"), F.nullif("handler", F.lit("")).alias("wanted"))
    else:
        raise ValueError(kind)
    rows = rows.withColumn("id", node_id(F.col("node_type"), F.col("path"), F.col("key")))
    order = ("exact", "camel", "snake") if kind == "graphql" else ("exact",) if kind in ("http", "websocket") else ("exact", "snake", "camel")
    served = rows.where("wanted is not null").join(handlers(rows.select(F.col("wanted").alias("name")).where("name is not null"), nodes, order).withColumnsRenamed({"name": "wanted", "id": "handler_id"}), "wanted")
    edge_type, outward = {"http": ("CallsHttp", True), "openapi": ("CallsHttp", True), "proto": ("Implements", False), "graphql": ("Uses", False), "websocket": ("Uses", False)}[kind]
    a, b = ("id", "handler_id") if outward else ("handler_id", "id")
    edges = served.select(F.lit(edge_type).alias("edge_type"), F.col(a).alias("source_id"), F.col(b).alias("target_id")).distinct()
    return conform(rows.dropDuplicates(["id"]), NODES), conform(edges, EDGES)
