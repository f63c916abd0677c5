"""What the corpus operators share: shared-folder tables, size-checked broadcasts, prefix sums, components.

A *shared table* is a Parquet table below ``spark.checkpoint.dir``, the folder that the driver and all executors
see. It cuts lineage the way ``checkpoint()`` does, but stays columnar, compressed and prunable. An executor that
is lost later costs a re-read of a file, never a recomputation of what led to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, drop_path, new_path, share, shared_folder  # noqa: F401

#: Words everywhere in this package: runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches hold about this many bytes at most, or one row.
BATCH_BYTES = 4_000_000

#: Arrow batches are cut into pieces of about this many bytes of text before Python lists are made of them.
PIECE_BYTES = 8_000_000


def small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Shares df, counts it and says whether it may be broadcast."""
    kept = share(df, name)
    return kept, kept.count() <= rows


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, fits: bool) -> DataFrame:
    """Joins with a broadcast of the right side if it was found small, else by shuffle (AQE splits hot keys)."""
    return left.join(F.broadcast(right) if fits else right, on, how)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, by exact name, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def carried(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of docs, whatever their names, and last the text as bytes."""
    name = "_text"
    while name in keep:
        name = f"_{name}"
    return docs.select(*[F.col(f"`{c}`") for c in keep], utf8("text").alias(name))


def utf8(column: str) -> Column:
    """A text column as bytes; null stays null."""
    return F.col(f"`{column}`").cast("binary")


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with batches that are bounded in bytes, since texts may be long: both sides hold one at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str | None = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``most`` bytes in ``column`` (None: the last one), or one row."""
    for batch in batches:
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(batch.num_columns - 1 if column is None else column)).to_pylist()]
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


#: Of a table's rows, a key holds a hot part if it has over this share of them, and at least HOT_ROWS rows.
HOT_SHARE = 1 / 10_000
HOT_ROWS = 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int) -> DataFrame:
    """left.join(right, on), inner, where ``right`` has one row a key and, as ``n``, how many rows of left have the key.

    Keys with more rows than HOT_SHARE of all are 1 / HOT_SHARE at most, so their rows of right are broadcast, and the
    rows of left that meet them aren't dealt out by key; all others are joined by shuffle.
    """
    hot = right.where(F.col(n) > max(HOT_ROWS, int(rows * HOT_SHARE)))
    rest = right.where(F.col(n) <= max(HOT_ROWS, int(rows * HOT_SHARE)))
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).union(cold.join(rest.hint("merge"), on)).drop(n)


def running_totals(df: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds, as ``out``, the sum of ``value`` over all rows before a row in the given order.

    The rows are dealt out by range, so that no task gets more than its share even if one key is very common;
    only one row a partition meets in one task. ``order`` must be total, or rows that tie share arbitrarily.
    """
    dealt = share(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # offsets has a row for each partition, which the shuffle settings bound
    return (
        dealt.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_before")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that edges reach from each node that has an edge.

    Alternates two steps until the edges are stars around the smallest nodes: each node's larger neighbours are
    linked to its smallest neighbour, then each node's smaller neighbours are. Both keep the components, and the
    number of rounds grows with the logarithm of the longest path. Minima are taken map-side first; the joins
    leave hot hubs to AQE. Each round is written to the shared folder. Only two numbers reach the driver a round.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = share(now, "edges")

    def mark(e: DataFrame) -> tuple[int, int]:
        x = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return x[0], x[1]

    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = share(small_star.select("e.u", "e.v").where("u > v").distinct(), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
