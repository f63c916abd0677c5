"""Diagnostics from build and test logs, and what they touch.

Logs are DataFrames of (log_id, text). Parsers that carry a header to a later line do so with a window over a log's
lines, which is the only order there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import cochange, impact

COLUMNS = ("log_id", "n", "path", "line", "column", "severity", "message", "code")
NUMBER = r"^\d{1,9}$"


def lines_of(logs: DataFrame) -> DataFrame:
    """(log_id, n, raw, code): numbered lines, as they are and trimmed."""
    rows = logs.select("log_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "raw"))
    return rows.withColumn("code", F.regexp_replace("raw", r"^\s+|\s+$", ""))


def shaped(rows: DataFrame, path: Column, line: Column, column: Column | None, severity: Column, message: Column, code: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return rows.select(
        "log_id", "n", path.alias("path"), line.cast("int").alias("line"), (null if column is None else column).cast("int").alias("column"),
        severity.alias("severity"), message.alias("message"), (null if code is None else code).cast("string").alias("code"),
    )


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.cast("int"))


def compiler_json(logs: DataFrame) -> DataFrame:
    """A JSON object a line: compiler messages with a primary span."""
    schema = "struct<reason:string,message:struct<message:string,code:struct<code:string>,level:string,spans:array<struct<file_name:string,line_start:int,column_start:int,is_primary:boolean>>>>"
    rows = lines_of(logs).withColumn("j", F.from_json("raw", schema)).where("j.reason = 'compiler-message'")
    rows = rows.withColumn("span", F.get(F.filter("j.message.spans", lambda s: s["is_primary"]), 0)).where("span is not null and j.message.level in ('error', 'warning', 'note', 'help')")
    return shaped(rows, F.col("span.file_name"), F.col("span.line_start"), F.col("span.column_start"), F.initcap("j.message.level"), F.col("j.message.message"), F.col("j.message.code.code"))


def compiler_text(logs: DataFrame) -> DataFrame:
    """A header names an error or a warning; the first arrow below it says where."""
    rows = lines_of(logs)
    code = F.col("code")
    coded = code.rlike(r"^(error\[E|warning\[C)")
    bare = code.rlike(r"^(error|warning):")
    header = F.when(
        coded | bare,
        F.struct(
            F.when(code.startswith("error"), "Error").otherwise("Warning").alias("severity"),
            F.trim(F.when(coded, F.regexp_extract("code", r"^\w+\[[^\]]*\]:?(.*)$", 1)).otherwise(F.regexp_extract("code", r"^\w+:(.*)$", 1))).alias("message"),
            F.when(coded, F.regexp_extract("code", r"^\w+\[([^\]]*)\]", 1)).alias("code"),
        ),
    )
    w = Window.partitionBy("log_id").orderBy("n")
    rows = rows.withColumn("header", header).withColumn("block", F.sum(F.col("header").isNotNull().cast("int")).over(w))
    place = F.trim(F.regexp_extract("code", r"-->(.*)$", 1))
    # a path, a line and perhaps a column, read from the end since paths may hold colons
    long, short = r"^(.*):([^:]*):([^:]*)$", r"^([^:]*):([^:]*)$"
    is_long = place.rlike(long)
    path = F.when(is_long, F.regexp_extract(place, long, 1)).otherwise(F.regexp_extract(place, short, 1))
    line = _number(F.when(is_long, F.regexp_extract(place, long, 2)).otherwise(F.regexp_extract(place, short, 2)))
    column = F.when(is_long, _number(F.regexp_extract(place, long, 3)))
    arrows = rows.where(F.col("header").isNull() & F.col("code").contains("-->") & (F.col("block") > 0)).select("log_id", "n", "block", path.alias("path"), line.alias("line"), column.alias("column")).where("line is not null")
    first = arrows.groupBy("log_id", "block").agg(F.min(F.struct("n", "path", "line", "column")).alias("a"))
    headers = rows.where("header is not null").select("log_id", "block", "header")
    return headers.join(first, ["log_id", "block"]).select("log_id", "a.n", "a.path", "a.line", "a.column", "header.severity", "header.message", "header.code").select(*COLUMNS)


def cargo_test(logs: DataFrame) -> DataFrame:
    """Failed tests, with a path made of their names, and panics with a position."""
    rows = lines_of(logs)
    failed = rows.where(F.col("raw").contains(" FAILED")).withColumn("t", F.regexp_extract("raw", r"test (.*?) \.\.\.", 1)).where("t <> ''")
    tests = shaped(failed, F.replace("t", F.lit("::"), F.lit("/")), F.lit(0), None, F.lit("Error"), F.col("raw"))
    panics = rows.where(~F.col("raw").contains(" FAILED") & F.col("raw").contains("panicked") & F.col("raw").contains(".rs:"))
    parts = panics.select("log_id", "n", "raw", F.explode(F.filter(F.split(F.trim("raw"), r"\s+"), lambda p: p.contains(".rs:"))).alias("p"))
    pattern = r"^(.*?\.rs):([^:]*)(?::(.*))?$"
    parts = parts.withColumn("line", _number(F.regexp_extract("p", pattern, 2))).where("line is not null")
    return tests.union(shaped(parts, F.regexp_extract("p", pattern, 1), F.col("line"), _number(F.regexp_extract("p", pattern, 3)), F.lit("Error"), F.col("raw")))


def go_build(logs: DataFrame) -> DataFrame:
    """``file.go:line:rest``; what follows the line, a column included, is the message."""
    pattern = r"^(.*?\.go):([^:]*):(.*)$"
    rows = lines_of(logs).withColumn("line", _number(F.regexp_extract("code", pattern, 2))).where("line is not null")
    message = F.trim(F.regexp_extract("code", pattern, 3))
    return shaped(rows, F.regexp_extract("code", pattern, 1), F.col("line"), None, F.when(message.startswith("warning:"), "Warning").otherwise("Error"), message)


def go_test(logs: DataFrame) -> DataFrame:
    """Tab-indented positions below a failed test; the first carries the test's name, other output ends the test."""
    rows = lines_of(logs)
    pattern = r"^(.*?\.go):([^:]*):(.*)$"
    is_header = F.col("code").startswith("--- FAIL:")
    is_tabbed = F.col("raw").startswith("\t") & F.col("code").contains(".go:") & ~is_header
    is_place = is_tabbed & F.coalesce(_number(F.regexp_extract("code", pattern, 2)).isNotNull(), F.lit(False))
    is_reset = ~is_header & ~is_tabbed & (F.col("code") != "") & ~F.col("code").rlike("^(---|===)")
    # the last mark before a line: a header's name, or an empty one where a place or a reset has used it up
    mark = F.when(is_header, F.trim(F.regexp_extract("code", r"^--- FAIL:(.*)$", 1))).when(is_place | is_reset, F.lit(""))
    w = Window.partitionBy("log_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", is_place).withColumn("mark", mark).withColumn("test", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(""))).where("place")
    message = F.concat(F.when(F.col("test") != "", F.concat(F.lit("["), F.col("test"), F.lit("] "))).otherwise(F.lit("")), F.trim(F.regexp_extract("code", pattern, 3)))
    return shaped(rows, F.regexp_extract("code", pattern, 1), F.regexp_extract("code", pattern, 2), None, F.lit("Error"), message)


def jest(logs: DataFrame) -> DataFrame:
    """A JSON report's failed assertions; of other logs, the lines that name a failed file."""
    one = "struct<status:string,title:string,lineNumber:int,fullName:string,ancestorTitles:array<string>,failureMessages:array<string>>"
    parsed = logs.select("log_id", "text", F.from_json("text", f"struct<testResults:array<struct<assertionResults:array<{one}>>>>").alias("j"))
    failed = parsed.where("j.testResults is not null").select("log_id", F.posexplode(F.flatten(F.transform(F.filter("j.testResults", lambda t: t["assertionResults"].isNotNull()), lambda t: t["assertionResults"]))).alias("n", "a")).where("a.status = 'failed'")
    title = F.coalesce("a.title", F.lit("unknown"))
    ancestor = F.get(F.filter("a.ancestorTitles", lambda x: x.endswith(".js") | x.contains(".test.") | x.contains(".spec.")), 0)
    path = F.coalesce(F.when(F.col("a.fullName").isNotNull(), ancestor), F.lit("unknown"))
    report = shaped(failed, path, F.coalesce("a.lineNumber", F.lit(1)), None, F.lit("Error"), F.coalesce(F.get("a.failureMessages", 0), title))
    plain = lines_of(parsed.where("j.testResults is null")).where(F.col("code").startswith("FAIL "))
    return report.union(shaped(plain, F.trim(F.expr("substring(code, 6)")), F.lit(0), None, F.lit("Error"), F.col("code")))


def pytest(logs: DataFrame) -> DataFrame:
    """``file.py:line: message``; an error if the message speaks of one, else a warning."""
    pattern = r"^(.*?\.py):(\d{1,9}):(.*)$"
    rows = lines_of(logs).where(F.col("code").rlike(pattern))
    message = F.trim(F.regexp_extract("code", pattern, 3))
    severity = F.when(F.lower(message).rlike("error|failed|exception"), "Error").otherwise("Warning")
    return shaped(rows, F.trim(F.regexp_extract("code", pattern, 1)), F.regexp_extract("code", pattern, 2), None, severity, message)


# fixed values: the names of parsers
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cargo-json": compiler_json,
    "cargo-text": compiler_text,
    "text": compiler_text,
    "cargo-test": cargo_test,
    "go-build": go_build,
    "go-test": go_test,
    "jest": jest,
    "pytest": pytest,
}


def parse(logs: DataFrame, parser: str) -> DataFrame:
    return PARSERS[parser](logs)


def with_symbols(graph: PropertyGraph, diagnostics: DataFrame) -> DataFrame:
    """diagnostics with the id of the symbol around each, or, where none is, the path's first node."""
    from .resolve import at_lines

    near = at_lines(diagnostics.select("path", "line").distinct(), graph.nodes, ()).withColumnRenamed("id", "_near")
    first = graph.nodes.groupBy("path").agg(F.min("id").alias("_first"))
    joined = diagnostics.join(near, ["path", "line"], "left").join(first, "path", "left")
    return joined.withColumn("symbol", F.coalesce("_near", "_first")).drop("_near", "_first")


def summary(diagnostics: DataFrame) -> DataFrame:
    """(errors, warnings, files)."""
    return diagnostics.agg(F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings"), F.countDistinct("path").alias("files"))


def root_cause(enriched: DataFrame) -> DataFrame:
    """(symbol, n): the symbol of most diagnostics, if there are three and it has two of them."""
    total = enriched.agg(F.count("*").alias("total"))
    n = enriched.where("symbol is not null").groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "symbol").limit(1)
    return n.crossJoin(F.broadcast(total)).where("total >= 3").select("symbol", "n")


def decorate(graph: PropertyGraph, logs: DataFrame, parser: str) -> dict[str, DataFrame]:
    """Errors and warnings with their symbols, and what those call and change with (the report's parts)."""
    found = with_symbols(graph, parse(logs, parser).where("severity in ('Error', 'Warning')"))
    symbols = found.where("symbol is not null").select(F.col("symbol").alias("id")).distinct()
    return {"diagnostics": found, "summary": summary(found), "root_cause": root_cause(found), "callees": impact.callees(graph, symbols), "partners": cochange.summed_partners(graph, symbols)}
