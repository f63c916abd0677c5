"""Mixing sources to target weights, with DataFrame operations alone.

Sizes are summed by source (map-side first), the few sums become rates, and each document is emitted floor(rate)
times plus once more with a probability equal to the fraction, by a hash of its id: reruns agree, and no task needs
to see a whole source. Only the table of sources is ordered; it is dealt out by range, so it may be long, too.

Defined results: a null text has size 0; a null source is a source of its own, the last; sources without words get a
rate of 0 and their documents are not emitted; rows that share a doc_id share their hash and so their fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_totals, share, sized_join, small

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3


def n_words(column: str = "text") -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{column}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(*by: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the row's id alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(x.cast("string"), F.lit("")) for x in by]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight): weights repeat WEIGHTS over the sources by code point, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(sums.select("*", F.isnull("source").alias("last"), F.lit(1).alias("one")), ["last", "source"], "one", "rank", "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    return ranked.select("source", "source_size", weight.cast("bigint").alias("weight"))


def targets(table: DataFrame, most: int = MOST) -> DataFrame:
    """Adds target: shares by weight of the sum of all sizes, none above most times its source's size.

    In ascending order of size a weight, the sources that reach their limit come first. For each count of such
    sources the level (target a weight) of the others follows from two running sums; the true one is the first
    at which the next source stays at or below its limit.
    """
    totals = table.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    order = table.select("*", (F.col("source_size") / F.col("weight")).alias("a_weight"), F.isnull("source").alias("last"))
    run = running_totals(order, ["a_weight", "last", "source"], "source_size", "size_before", "by_level")
    run = running_totals(run, ["a_weight", "last", "source"], "weight", "weight_before", "by_level")
    run = run.crossJoin(F.broadcast(totals))
    level = (F.col("all_size") - most * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    run = share(run.withColumn("level", level), "levels")
    ok = F.col("level") * F.col("weight") <= most * F.col("source_size")
    found = run.where(ok & (F.col("level") >= 0)).agg(F.min(F.struct("a_weight", "last", "source", "level")).alias("x"))
    chosen = found.select(F.col("x.level").alias("at"))
    limit = (most * F.col("source_size")).cast("double")
    return run.crossJoin(F.broadcast(chosen)).select("source", "source_size", "weight", F.least(F.coalesce(F.col("at") * F.col("weight"), limit), limit).alias("target"))


def rates(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(source, source_size, weight, target, rate), and whether it may be broadcast."""
    sized = docs.select("source", n_words().alias("size"))
    return small(rated(targets(sources(sized))), "rates")


def rated(table: DataFrame) -> DataFrame:
    return table.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(rate: Column, key: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (coin(key) < rate - whole).cast("bigint")).cast("bigint")


def with_copies(rows: DataFrame, table: DataFrame, fits: bool) -> DataFrame:
    """Adds n_copies to rows (doc_id and source among their columns) from the table of rates; null meets null."""
    key = F.struct(F.isnull("source"), F.coalesce("source", F.lit("")))
    by = table.select(key.alias("_key"), F.struct("source_size", "target", "rate").alias("_mix"))
    joined = sized_join(rows.withColumn("_key", key), by, "_key", "left", fits)
    return joined.withColumn("n_copies", copies(F.col("_mix.rate"), F.col("doc_id"))).drop("_key")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its source's rate says, with the columns of docs."""
    table, fits = rates(docs)
    # the caller's columns travel in a struct, so that theirs and ours never share a name
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = with_copies(docs.select("doc_id", "source", row), table, fits).where("n_copies > 0")
    copies_of = out.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    return copies_of.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def plan(docs: DataFrame) -> DataFrame:
    """Per document, without its text: doc_id, source, size, source_size, target, rate, n_copies and taken words."""
    sized = share(docs.select(F.col("doc_id"), F.col("source"), n_words().alias("size")), "sized")
    table, fits = small(rated(targets(sources(sized))), "rates")
    out = with_copies(sized, table, fits)
    return out.select("doc_id", "source", "size", "_mix.source_size", "_mix.target", "_mix.rate", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1 AS rank FROM sums
), weighed AS (
  SELECT source, source_size, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked
), run AS (
  SELECT *, source_size / weight AS a_weight,
    coalesce(sum(source_size) OVER w, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before,
    (sum(source_size) OVER ())::BIGINT AS all_size, (sum(weight) OVER ())::BIGINT AS all_weight
  FROM weighed
  WINDOW w AS (ORDER BY source_size / weight, (source IS NULL), encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (all_size - 3 * size_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM run
), chosen AS (
  SELECT level AS lvl FROM leveled WHERE level * weight <= 3 * source_size AND level >= 0
  ORDER BY a_weight, (source IS NULL), encode(source) LIMIT 1
), aimed AS (
  SELECT source, source_size, least(coalesce(lvl * weight, (3 * source_size)::DOUBLE), (3 * source_size)::DOUBLE) AS target
  FROM leveled LEFT JOIN chosen ON true
), coins AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM coins
"""
