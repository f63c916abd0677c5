"""Tuning, toolchains and repositories."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Ingestion:
    # fixed values: defaults of the limits on ingestion
    files_per_batch: int = 50
    max_files_per_scan: int = 5000
    ingest_batch_size: int = 100
    scan_timeout_secs: int = 120
    cochange_max_commit_files: int = 100
    cochange_commit_window: int = 100
    cochange_min_pair_count: int = 2
    nlp_prewarm_count: int = 20
    nlp_batch_size: int = 50
    nlp_budget_per_pass: int = 20
    ui_session_ttl_secs: int = 600
    default_query_limit: int = 100
    max_pattern_edges: int = 200


@dataclass
class Semantic:
    # fixed values: defaults of semantic search
    similarity_threshold: float = 0.3
    anchor_weight: float = 0.3


@dataclass
class Runtime:
    # fixed values: defaults of command limits
    default_command_timeout_secs: int = 60
    default_test_timeout_secs: int = 300


@dataclass
class Tuning:
    ingestion: Ingestion = field(default_factory=Ingestion)
    semantic: Semantic = field(default_factory=Semantic)
    runtime: Runtime = field(default_factory=Runtime)


def load_tuning(path: str | Path) -> Tuning:
    """From a TOML file; defaults for what it lacks, and for all of it if it can't be read."""
    out = Tuning()
    try:
        raw = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return out
    for section in fields(out):
        part = getattr(out, section.name)
        for f in fields(part):
            value = raw.get(section.name, {}).get(f.name)
            if isinstance(value, type(getattr(part, f.name))):
                setattr(part, f.name, value)
    return out


def save_tuning(tuning: Tuning, path: str | Path) -> None:
    lines = []
    for section in fields(tuning):
        lines.append(f"[{section.name}]")
        part = getattr(tuning, section.name)
        lines += [f"{f.name} = {getattr(part, f.name)}" for f in fields(part)] + [""]
    Path(path).write_text("\n".join(lines))


# fixed values: (name, marker, priority, build command, test command, build parser, test parser)
PROFILES = (
    ("rust", "Cargo.toml", 100, "cargo build --message-format=json", "cargo test --message-format=short", "cargo-json", "cargo-test"),
    ("go", "go.mod", 90, "go build", "go test", "go-build", "go-test"),
    ("typescript", "tsconfig.json", 85, "npm run build", "npm test", "text", "jest"),
    ("javascript", "package.json", 80, "npm run build", "npm test", "text", "jest"),
    ("python", "pyproject.toml", 80, "python -m build", "pytest", "text", "pytest"),
)
# fixed values: (rank, toolchain, a pattern of its marker files); the lowest rank is the main one
MARKERS = (
    (1, "Rust", r"^Cargo\.toml$"), (2, "Go", r"^go\.mod$"), (3, "Python", r"^(pyproject\.toml|setup\.py|requirements\.txt)$"),
    (4, "JavaScript", r"^package\.json$"), (5, "TypeScript", r"^tsconfig\.json$"), (6, "Java", r"^(pom\.xml|build\.gradle(\.kts)?)$"),
    (7, "CSharp", r"\.(csproj|sln)$"), (8, "Ruby", r"^(Gemfile|Rakefile)$"), (9, "Php", r"^composer\.json$"),
    (10, "Cpp", r"^CMakeLists\.txt$"), (11, "C", r"^Makefile$"), (12, "Zig", r"^(zig\.mod|build\.zig)$"),
    (13, "Swift", r"^Package\.swift$"), (16, "R", r"^(DESCRIPTION|NAMESPACE)$"), (17, "Perl", r"^(Makefile\.PL|cpanfile|META\.json)$"),
    (18, "Matlab", r"^MATLAB\.prj$"),
)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "name string, marker string, priority int, build_command string, test_command string, build_parser string, test_parser string")


def project_profile(files: DataFrame) -> DataFrame:
    """(project, toolchain, rank, is_main) from the names of a project's top files (project, name).

    A package is TypeScript with its own configuration, else JavaScript; CMake makes a project C++, else Make C.
    """
    found = [F.when(F.col("name").rlike(pattern), F.struct(F.lit(rank).alias("rank"), F.lit(tool).alias("toolchain"))) for rank, tool, pattern in MARKERS]
    hits = files.select("project", F.explode(F.array_compact(F.array(*found))).alias("t")).select("project", "t.*").distinct()
    tools = hits.groupBy("project").agg(F.array_sort(F.collect_set(F.struct("rank", "toolchain"))).alias("all"))
    has = lambda t: F.exists("all", lambda x: x["toolchain"] == t)
    kept = F.filter("all", lambda x: ~((x["toolchain"] == "JavaScript") & has("TypeScript")) & ~((x["toolchain"] == "TypeScript") & ~has("JavaScript")) & ~((x["toolchain"] == "C") & has("Cpp")))
    rows = tools.withColumn("kept", kept).select("project", F.posexplode("kept").alias("i", "t"))
    return rows.select("project", "t.toolchain", "t.rank", (F.col("i") == 0).alias("is_main"))


def owner_and_name(url: Column) -> Column:
    """A struct of a remote's owner and name, from either form of address."""
    pattern = r"^(?:\w+://(?:[^@/]+@)?[^/:]+(?::\d+)?/|(?:[^@/]+@)?[^:/]+:)(.+)/([^/]+?)(?:\.git)?/?$"
    owner = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.when(owner.isNotNull(), F.struct(owner.alias("owner"), F.regexp_extract(url, pattern, 2).alias("name")))


def tracked(files: DataFrame, ignored: DataFrame | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Files (path) without ignored paths, or those that fit ignored patterns."""
    out = files if ignored is None else files.join(ignored.select("path"), "path", "left_anti")
    for pattern in patterns:
        out = out.where(~F.col("path").rlike(pattern))
    return out


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of a folder's files, from any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("content").cast("string").alias("text"))
