"""Line dedup by winnowing over line hashes.

The lines of a text that hold a word, in order, are a sequence of hashes. A line goes if it lies in a run of lines with
at least MIN_WORDS words or MIN_LINES lines that equals an earlier run, in the order of (doc_id, line), which ends before
the run begins. The first occurrence stays, so a passage that documents share stays once.

A window is the shortest run of lines from a line on that has that many words or lines. Of each window the line with the
least hash (of equal ones the last) is selected; windows that follow one another mostly select the same line, so a text
keeps fewer positions than lines. Any repeated run holds a window, whose selected line is one of both occurrences'
fingerprints, whatever surrounds either. A fingerprint carries the hashes of the lines around it, ten at most. First,
positions are joined by fingerprint alone: those whose line is selected once in all texts go. The others' matches are
extended both ways on the line hashes: to the left up to the begin of each window that selected the line, to the right
up to the line before which the next window would end. Each such run is joined with the first occurrence of its line
hashes, and where that is an earlier one the run's lines are deleted. A longer run is the union of such runs, of its own
windows, so it is deleted to its last line.

First occurrences and counts are taken map-side. A run meets one row, the first with its line hashes; those that many
positions share are broadcast (there are 10,000 at most), so a passage in a third of all documents neither fills a task
nor makes pairs.

Defined results: lines are compared without the white space around them, by 128-bit hashes; blank lines inside a deleted
run go with it; null and empty texts stay as they are; rows with the same doc_id and text count as one document, and
both keep or lose the same lines; null ids come first; further columns are not read, whatever their names, and ``keep``
may name any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_counted, mapped, pieces, share, utf8

MIN_WORDS = 50
MIN_LINES = 4
SPACES = b" \t\x0b\x0c\r"
#: Bytes of a line's hash.
HASH = 16


def units(raw: bytes) -> list[tuple[int, bytes]]:
    """(number, content) of the lines that hold a word; lines count from 0, blank ones too."""
    return [(i, stripped) for i, x in enumerate(raw.split(b"\n")) if (stripped := x.strip(SPACES))]


def window_ends(words: list[int], min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> list[int]:
    """Where the window from each line on ends, without the lines that begin none; ends never fall."""
    out, end, total = [], 0, 0
    for i in range(len(words)):
        if end < i:
            end, total = i, 0
        while end < len(words) and total < min_words and end - i < min_lines:
            total += words[end]
            end += 1
        if total < min_words and end - i < min_lines:
            break
        out.append(end)
        total -= words[i]
    return out


def selected(hashes: list[bytes], ends: list[int]) -> list[int]:
    """The line that each window selects: the one with the least hash, of equal ones the last."""
    return [max(range(i, end), key=lambda k: (hashes[k] == low, k)) for i, end in enumerate(ends) for low in [min(hashes[i:end])]]


def fingerprints(raw: bytes, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> list[tuple[bytes, int, bytes, bytes]]:
    """(hash, begin, hashes around, runs) of each selected line.

    The hashes are those of the lines from ``begin`` on; runs are pairs of bytes, where a run begins and ends among them.
    """
    lines = [x for _, x in units(raw)]
    hashes = [xxhash.xxh3_128_digest(x) for x in lines]
    ends = window_ends([len(x.split()) for x in lines], min_words, min_lines)
    chosen = selected(hashes, ends)
    out, i = [], 0
    while i < len(ends):
        begin, runs, last = i, bytearray(), 0
        while i < len(ends) and chosen[i] == chosen[begin]:
            # beyond the next window's end, runs belong to the next window
            beyond = ends[i + 1] if i + 1 < len(ends) else len(lines) + 1
            for last in range(ends[i], max(beyond, ends[i] + 1)):
                runs += bytes((i - begin, last - begin))
            i += 1
        out.append((hashes[chosen[begin]], begin, b"".join(hashes[begin:last]), bytes(runs)))
    return out


POSITIONS = "id bigint, tie bigint, fingerprint bigint, begin int, hashes binary, runs binary"
RUNS = "id bigint, tie bigint, first int, last int, c1 bigint, c2 bigint"


def _positions(batches: Iterator[pa.RecordBatch], min_words: int, min_lines: int) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "tie": pa.int64(), "fingerprint": pa.int64(), "begin": pa.int32(), "hashes": pa.binary(), "runs": pa.binary()}
    for batch in pieces(batches):
        rows = [
            (doc, tie, int.from_bytes(fingerprint[:8], "little", signed=True), *more)
            for doc, tie, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "text")), strict=True)
            if raw
            for fingerprint, *more in fingerprints(raw, min_words, min_lines)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs through each position, each with a 128-bit hash of its lines' hashes."""
    for batch in batches:
        owner, first, last, digests = [], [], [], []
        for k, (begin, hashes, runs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("begin", "hashes", "runs")), strict=True)):
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                owner.append(k)
                first.append(begin + a)
                last.append(begin + b - 1)
                digests.append(xxhash.xxh3_128_digest(hashes[HASH * a : HASH * b]))
        if owner:
            c = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("tie").take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())],
                names=["id", "tie", "first", "last", "c1", "c2"],
            )


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """id and tie, which name a document, its text as bytes and further columns."""
    key = [F.coalesce(F.col("`doc_id`").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col("`text`")).alias("tie")]
    return docs.select(*key, utf8("text").alias("text"), *[F.col(f"`{c}`") for c in more])


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """(id, tie, runs): the runs [first, last] of each document, among its lines with words, that equal earlier ones."""
    found = share(mapped(keyed(docs), partial(_positions, min_words=min_words, min_lines=min_lines), POSITIONS), "positions")
    place = F.xxhash64("id", "tie", "begin")
    met = found.groupBy("fingerprint").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("met")).where("x <> y")
    joined = join_counted(found, share(met.select("fingerprint", "met"), "met"), ["fingerprint"], "met", found.count())
    runs = share(mapped(joined.select("id", "tie", "begin", "hashes", "runs"), _extended, RUNS), "runs")
    at = F.struct("id", "tie", "first", "last")
    firsts = runs.groupBy("c1", "c2").agg(F.min(at).alias("one"), F.max(at).alias("other"), F.count("*").alias("met")).where("one <> other")
    pairs = join_counted(runs, share(firsts.select("c1", "c2", "one", "met"), "firsts"), ["c1", "c2"], "met", runs.count())
    own = (F.col("id") == F.col("one.id")) & (F.col("tie") == F.col("one.tie"))
    later = pairs.where(~own | (F.col("first") > F.col("one.last")))
    return later.groupBy("id", "tie").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def without(raw: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """The text without the lines of the runs; its lines with a word, and how many of those went."""
    worded = [i for i, _ in units(raw)]
    if not runs:
        return raw, len(worded), 0
    gone: set[int] = set()
    for run in runs:
        gone.update(range(worded[run["first"]], worded[run["last"]] + 1))
    left = b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in gone)
    return left, len(worded), sum(i in gone for i in worded)


def _without(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, None):
        texts, n, gone = [], [], []
        for raw, runs in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
            text, lines, deleted = without(raw or b"", runs or [])
            texts.append(None if raw is None else text.decode("utf-8", "replace"))
            n.append(lines)
            gone.append(deleted)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema=schema)


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """The columns ``keep`` of docs, text without later repeated runs, n_lines (with a word) and n_deleted of them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    runs = later_runs(docs, min_words, min_lines)
    named = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    key = [F.coalesce(F.col("`doc_id`").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col("`text`")).alias("tie")]
    rows = docs.select(*named, *key, utf8("text").alias("_text"))
    joined = rows.join(runs.hint("merge"), ["id", "tie"], "left")  # by shuffle at every size: runs grow with the texts
    rows = joined.select(*[F.col(f"_keep{i}") for i in range(len(keep))], "runs", "_text")
    schema = StructType([StructField(c, docs.schema[c].dataType) for c in keep] + [StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_deleted", LongType())])
    return mapped(rows, partial(_without, schema=to_arrow_schema(schema)), schema)


#: The same from the definition, for MIN_WORDS and MIN_LINES as above: every window, longer by 0 to 3 lines, against all
#: of them. A longer run is a union of such ones. Lines count from 1 here.
ORACLE = rf"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS u,
    trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(line, '{WORD}')) AS words
  FROM raw WHERE regexp_matches(line, '{WORD}')
), leads AS (
  SELECT doc_id, u, words, lead(words, 1) OVER w AS w2, lead(words, 2) OVER w AS w3, lead(words, 3) OVER w AS w4
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY u)
), ends AS (
  SELECT doc_id, u, u + CASE WHEN words >= 50 THEN 0 WHEN words + w2 >= 50 THEN 1 WHEN words + w2 + w3 >= 50 THEN 2
    WHEN w4 IS NOT NULL THEN 3 END AS least_end FROM leads
), longer AS (
  SELECT doc_id, u, least_end + unnest([0, 1, 2, 3]) AS e FROM ends WHERE least_end IS NOT NULL
), runs AS (
  SELECT l.doc_id, l.u, l.e, min(x.i) AS first, max(x.i) AS last, string_agg(x.line, chr(10) ORDER BY x.u) AS content
  FROM longer l JOIN units x ON l.doc_id = x.doc_id AND x.u BETWEEN l.u AND l.e
  GROUP BY l.doc_id, l.u, l.e HAVING count(*) = l.e - l.u + 1
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS doc0, first_value(last) OVER w AS last0
  FROM runs WINDOW w AS (PARTITION BY content ORDER BY doc_id, u)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM ranked WHERE doc_id <> doc0 OR first > last0
), marked AS (
  SELECT r.doc_id, r.i, r.line, g.i IS NOT NULL AS deleted, regexp_matches(r.line, '{WORD}') AS worded
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i
), lefts AS (
  SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (worded AND deleted) AS n_deleted,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT deleted), '') AS left_text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, length(left_text)::BIGINT AS kept_chars, md5(left_text) AS kept_md5
FROM documents d LEFT JOIN lefts l ON d.doc_id = l.doc_id
"""
