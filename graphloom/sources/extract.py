"""References and string literals from source text.

The JVM does all of it: comments and strings are blanked by one regular expression, lines are numbered by
``posexplode``, and names come from ``regexp_extract_all``. What a full parser would tell apart by grammar is told
apart by what stands before and after a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantic_candidate

# fixed values: calls that belong to a language or its library
BUILTIN_CALLS = (
    "new", "clone", "into", "from", "to_string", "to_owned", "as_ref", "as_mut", "unwrap", "expect", "ok", "err",
    "unwrap_or", "unwrap_or_else", "unwrap_or_default", "ok_or", "is_some", "is_none", "is_ok", "is_err", "map_err",
    "and_then", "or_else", "flatten", "iter", "iter_mut", "into_iter", "enumerate", "zip", "flat_map", "any", "all",
    "trim", "split", "join", "await", "spawn", "block_on", "println", "print", "eprintln", "eprint", "format",
    "panic", "assert", "assert_eq", "assert_ne", "debug_assert", "lock", "write", "writeln", "read", "open", "close",
    "flush", "self", "super", "crate", "std",
)
# fixed values: types that belong to a language or its library
BUILTIN_TYPES = (
    "String", "Vec", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "Option", "Result", "Box", "Arc", "Rc", "Mutex",
    "RwLock", "Ok", "Err", "Some", "None", "Self", "Send", "Sync", "Clone", "Copy", "Debug", "Display", "Default",
    "Drop", "Into", "From", "AsRef", "AsMut", "Iterator", "Future", "Pin", "Path", "PathBuf", "Error", "Write",
    "Read", "True", "False", "NotImplementedError", "TypeError", "ValueError", "KeyError", "IndexError", "Exception",
    "RuntimeError", "StopIteration", "Promise", "Array", "Object", "Function", "Number", "Boolean", "Symbol",
    "BigInt", "Date", "Map", "Set", "WeakMap", "WeakSet", "Proxy", "Reflect", "JSON", "Math", "RegExp", "RangeError",
    "I8", "I16", "I32", "I64", "U8", "U16", "U32", "U64", "F32", "F64", "Usize", "Isize", "Bool", "Char",
)
# fixed values: the kinds of source files
LANGUAGES = {"rs": "rust", "py": "python", "js": "script", "jsx": "script", "ts": "script", "tsx": "script"}
#: Words that may stand before a bracket without being called.
KEYWORDS = ("if", "for", "while", "match", "return", "fn", "def", "class", "function", "switch", "catch", "in", "and", "or", "not", "elif", "loop", "let", "lambda", "with", "except", "async", "typeof", "yield")

STRING = r'"(?:[^"\\\n]|\\.)*"' + "|" + r"'(?:[^'\\\n]|\\.)*'"
BLANK = {"python": STRING + r"|#[^\n]*", "rust": r'"(?:[^"\\]|\\.)*"' + r"|//[^\n]*", "script": STRING + r"|//[^\n]*"}


def language(path: Column) -> Column:
    """The kind of a path's file; null for others."""
    kinds = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return kinds[F.regexp_extract(path, r"\.([^./]+)$", 1)]


def _lines(files: DataFrame, text: Column) -> DataFrame:
    return files.select("path", "kind", F.posexplode(F.split(text, "\n")).alias("line", "code"))


def static_refs(files: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(path, line, target_name, edge_type) of files (path, text): calls and, in PascalCase, types; lines from 0.

    definitions (path, name) are what a file defines itself, which overrides the lists of what languages own.
    """
    known = files.select("path", language(F.col("path")).alias("kind"), "text").where("kind is not null")
    bare = F.lit(None).cast("string")
    for kind, pattern in BLANK.items():
        bare = F.when(F.col("kind") == kind, F.regexp_replace("text", pattern, '""')).otherwise(bare)
    lines = _lines(known, bare)
    called = F.regexp_extract_all("code", F.lit(r"(?<!\bfn )(?<!\bdef )(?<!\bfunction )(?<!\bclass )\b([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\("), F.lit(1))
    typed = F.regexp_extract_all("code", F.lit(r"\b([A-Za-z_]\w+)\b"), F.lit(1))
    calls = lines.select("path", "line", F.explode(called).alias("target_name"), F.lit("Calls").alias("edge_type")).where(~F.col("target_name").isin(*KEYWORDS))
    types = lines.select("path", "line", F.explode(typed).alias("target_name"), F.lit("Uses").alias("edge_type"))
    found = calls.union(types).where(F.length("target_name") > 1)
    if definitions is not None:
        own = definitions.select("path", F.col("name").alias("target_name")).distinct().withColumn("_own", F.lit(True))
        found = found.join(own, ["path", "target_name"], "left")
    else:
        found = found.withColumn("_own", F.lit(None).cast("boolean"))
    foreign = F.when(F.col("edge_type") == "Calls", ~F.col("target_name").isin(*BUILTIN_CALLS)).otherwise(F.col("target_name").rlike(r"^\p{Lu}") & ~F.col("target_name").isin(*BUILTIN_TYPES))
    return found.where(F.coalesce("_own", F.lit(False)) | foreign).select("path", "line", "target_name", "edge_type")


def string_literals(files: DataFrame, any_kind: bool = False) -> DataFrame:
    """(path, line, value) of literals that may name something shared; any_kind also reads files of unknown kinds."""
    kinds = files.select("path", language(F.col("path")).alias("kind"), "text")
    lines = _lines(kinds if any_kind else kinds.where("kind is not null"), F.col("text"))
    values = lines.select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(f"({STRING})"), F.lit(1))).alias("value"))
    return values.withColumn("value", F.regexp_replace("value", "^[\"']+|[\"']+$", "")).where(semantic_candidate(F.col("value")))


def numbered(files: DataFrame) -> DataFrame:
    """(path, line, text): lines from 1."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def read_range(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    return numbered(files.where(F.col("path") == path)).where(F.col("line").between(first, last))


def list_dir(files: DataFrame, folder: str) -> DataFrame:
    """(name, is_dir) right below a folder, by name."""
    prefix = folder.rstrip("/") + "/" if folder.strip("/") else ""
    below = files.where(F.col("path").startswith(prefix)).select(F.expr(f"substring(path, {len(prefix) + 1})").alias("rest"))
    return below.groupBy(F.substring_index("rest", "/", 1).alias("name")).agg(F.bool_or(F.col("rest").contains("/")).alias("is_dir")).orderBy("name")


def find_files(files: DataFrame, glob: str) -> DataFrame:
    """Paths that fit a glob, in which ``*`` and ``?`` stay within a path's part and ``**`` doesn't."""
    import re

    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    pattern = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    return files.where(F.col("path").rlike(f"^{pattern}$")).select("path").orderBy("path")
