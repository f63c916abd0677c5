"""Text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names that mark a function as called by the language rather than by code
COMMON_NAMES = (
    "default", "new", "clone", "from", "into", "as_ref", "as_mut", "to_string", "to_owned", "debug", "display",
    "fmt", "format", "from_str", "parse", "try_from", "try_into", "borrowed",
)
# fixed values: words that make an upper-case constant a channel's name
CHANNEL_WORDS = ("TOPIC", "QUEUE", "ENDPOINT", "STREAM", "SOCKET", "ROUTE")


def label() -> Column:
    return F.when(F.col("is_deprecated"), F.lit("deprecated"))


def enriched_text(name: Column, signature: Column, docstring: Column, path: Column) -> Column:
    """What is embedded for a node: its parts joined by a bar, without the empty ones."""
    return F.concat_ws(" | ", *[F.nullif(x, F.lit("")) for x in (name, signature, docstring, path)])


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def camel_case(name: Column) -> Column:
    """Drops underscores and raises the character after each run of them."""
    parts = F.filter(F.split(name, "_"), lambda x: x != "")
    raised = F.transform(parts, lambda x, i: F.when((i == 0) & ~name.startswith("_"), x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))))
    return F.array_join(raised, "")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )


def freshness(seconds: Column) -> Column:
    return F.when(seconds < 5, "live").when(seconds < 60, "recent").otherwise("stale")


def return_type(signature: Column) -> Column:
    """What follows the last arrow, up to a generic's bracket or else a semicolon; the unit type without an arrow."""
    after = F.trim(F.substring_index(signature, "->", -1))
    cut = F.when(F.instr(after, "<") > 0, F.substring_index(after, "<", 1)).otherwise(F.substring_index(after, ";", 1))
    return F.when(F.instr(signature, "->") > 0, cut).otherwise(F.lit("()"))


def token_estimate(text: Column) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.size(words) * 2


def truncate_words(text: Column, max_tokens: int = 2000) -> Column:
    """The text, cut to half as many words as tokens where it has more."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) * 2 > max_tokens, F.array_join(F.slice(words, 1, max_tokens // 2), " ")).otherwise(text)


def is_common_name(name: Column) -> Column:
    return name.rlike(f"({'|'.join(COMMON_NAMES)})$")


def is_trait_path(path: Column) -> Column:
    return path.contains("trait")


def semantic_candidate(value: Column) -> Column:
    """Whether a literal may name something that other code shares: a path, a channel, a URL or a variable."""
    size = F.length(value)
    channel = (size > 4) & value.rlike(r"^[\p{Lu}_\p{N}]+$") & value.contains("_") & value.rlike("|".join(CHANNEL_WORDS))
    path = value.startswith("/") & ((size > 5) | value.rlike("Mutation|Query|Subscription"))
    return (size >= 3) & (path | channel | value.rlike(r"^(https?|wss?)://") | (value.startswith("$") & (size > 2)))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of ``*`` and ``?``; all else stands for itself."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"
