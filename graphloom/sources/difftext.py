"""Texts of uncommitted changes, and where a module's tests lie."""

from __future__ import annotations

import difflib
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_END = "\n\\ No newline at end of file\n"


def _blob(text: str | None) -> str:
    if text is None:
        return "0" * 7
    raw = text.encode()
    return hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()[:7]


def patch(path: str, old: str, new: str | None) -> str:
    """The patch of one file, in git's form; new is None where the file is gone. Equal texts have none."""
    if old == new:
        return ""
    head = f"diff --git a/{path} b/{path}\n"
    head += f"deleted file mode 100644\nindex {_blob(old)}..{_blob(new)}\n" if new is None else f"index {_blob(old)}..{_blob(new)} 100644\n"
    # lines end at line feeds alone
    before, after = (list(io.StringIO(t or "", newline="\n")) for t in (old, new))
    lines = list(difflib.unified_diff(before, after))[2:]
    if not lines:
        return head
    names = f"--- a/{path}\n" + ("+++ /dev/null\n" if new is None else f"+++ b/{path}\n")
    return head + names + "".join(x if x.endswith("\n") else x + NO_END for x in lines)


def _patches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        new = [t if there else None for t, there in zip(batch["new"], batch["there"], strict=True)]
        texts = [patch(*x) for x in zip(batch["path"], batch["old"], new, strict=True)]
        yield pd.DataFrame({"path": batch["path"], "diff": texts})


def file_diffs(index: DataFrame, workdir: DataFrame, path: str | None = None) -> DataFrame:
    """(path, diff): what differs between the index and the working copy, both (path, text), a null text being empty.

    Files that the index hasn't are untracked and have no diff. Files are joined by path; equal ones are dropped in the
    JVM, so that only changed texts reach Python, a pair at a time.
    """
    if path is not None:
        index, workdir = (x.where(F.col("path") == path) for x in (index, workdir))
    old = index.select("path", F.coalesce("text", F.lit("")).alias("old"))
    new = workdir.select("path", F.coalesce("text", F.lit("")).alias("new"), F.lit(True).alias("there"))
    changed = old.join(new, "path", "left").withColumn("there", F.coalesce("there", F.lit(False))).where("not there or old <> new")
    return changed.mapInPandas(_patches, "path string, diff string")


def tests_of(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kind, test_path) of modules (path): where their tests may be, among files (path).

    A module below src may hold its tests itself ('inline', with a file of its name below tests); else the first file of
    the usual names that there is ('file'), else 'none'.
    """
    base = F.replace(F.replace("path", F.lit(".rs"), F.lit("")), F.lit("/src/"), F.lit("/tests/"))
    tries = F.array(*[F.concat(base, F.lit(end)) for end in ("_test.rs", "_tests.rs", "/mod.rs", "")])
    keys = modules.select("path").distinct()
    inline = keys.where(F.contains("path", F.lit("/src/"))).select("path", F.lit("inline").alias("kind"), F.concat(F.lit("tests/"), F.substring_index("path", "/", -1)).alias("test_path"))
    others = keys.where(~F.contains("path", F.lit("/src/"))).select("path", F.posexplode(tries).alias("n", "test_path"))
    there = others.join(files.select(F.col("path").alias("test_path")).distinct(), "test_path", "left_semi")
    first = there.groupBy("path").agg(F.min_by("test_path", "n").alias("test_path"))
    found = keys.where(~F.contains("path", F.lit("/src/"))).join(first, "path", "left")
    return inline.union(found.select("path", F.when(F.col("test_path").isNull(), "none").otherwise("file"), "test_path"))
