"""Change streams (path, kind, ts): the watcher's rules, windows, late data, repeats, and the overlay they keep up.

Every function takes a stream or a table and gives the same rows for both; on a stream what comes later than ``late``
behind the latest change is dropped, and windows come in append mode once nothing can change them. A null path is no
file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import drop_path, finished, new_path, shared_folder

# fixed values: the extensions of the source files that are watched, and the kinds of changes that count
WATCHED = (
    "rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "cpp", "h", "hpp",
    "cs", "rb", "swift", "kt", "scala", "vue", "svelte",
)
CREATED, MODIFIED, REMOVED = "Created", "Modified", "Removed"
#: So many batches of an overlay are merged into one.
MERGED = 16


def with_time(changes: DataFrame, column: str = "ts") -> DataFrame:
    """Event times as timestamps with a zone, which watermarks need."""
    return changes.withColumn(column, F.col(column).cast("timestamp"))


def as_changes(rows: DataFrame, path: str = "path", kind: str = "kind", time: str = "ts") -> DataFrame:
    """rows as changes: path, kind and ts from columns of other names, the rest as it is, but for columns of these names."""
    rest = [c for c in rows.columns if c not in (path, kind, time, "path", "kind", "ts")]
    return rows.select(F.col(path).alias("path"), F.col(kind).alias("kind"), F.col(time).cast("timestamp").alias("ts"), *rest)


def _timed(changes: DataFrame, late: str) -> DataFrame:
    return changes.withWatermark("ts", late) if changes.isStreaming else changes


def watched(changes: DataFrame, removals: bool = True) -> DataFrame:
    """Changes of source files that are created, modified or removed, none of them hidden or in a hidden folder.

    A watcher that looks for the file on the disk never sees removals: ``removals=False``.
    """
    kinds = (CREATED, MODIFIED, REMOVED) if removals else (CREATED, MODIFIED)
    hidden = F.col("path").rlike(r"^\.|/\.(?!/|$)")
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return changes.where(F.col("kind").isin(*kinds) & ~hidden & extension.isin(*WATCHED))


def tumbling(changes: DataFrame, width: str = "1 day", late: str = "1 hour", sums: tuple[str, ...] = ()) -> DataFrame:
    """(start, kind, n, and the sums of columns): changes of each kind in each window."""
    out = _timed(changes, late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return out.select(F.col("window.start").alias("start"), "kind", "n", *sums)


def sliding(changes: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n, files): changes and different files in each window, both exact.

    Files are counted in two steps, first each file in each window: no window is one task's distinct set.
    """
    each = _timed(changes, late).groupBy(F.window("ts", width, step), "path").agg(F.count("*").alias("n"))
    out = each.groupBy("window").agg(F.sum("n").alias("n"), F.count("path").alias("files"))
    return out.select(F.col("window.start").alias("start"), "n", "files")


def sessions(changes: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(path, start, n): runs of a file's changes without a longer gap."""
    out = _timed(changes, late).groupBy(F.session_window("ts", gap), "path").agg(F.count("*").alias("n"))
    return out.select("path", F.col("session_window.start").alias("start"), "n")


def debounced(changes: DataFrame, quiet: str = "100 milliseconds", late: str = "1 hour") -> DataFrame:
    """(path, kind, ts, n): the last of each run of a file's changes that lie nearer than ``quiet``.

    Of changes at the same time the last kind in order stands. No run is dropped, however many there are.
    """
    out = _timed(changes, late).groupBy(F.session_window("ts", quiet), "path").agg(F.max(F.struct("ts", "kind")).alias("last"), F.count("*").alias("n"))
    return out.select("path", "last.kind", "last.ts", "n")


def deduplicated(changes: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One change of each key: within the watermark on a stream, overall on a table."""
    if changes.isStreaming:
        return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return changes.dropDuplicates(keys)


def _last(changes: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    rest = [c for c in changes.columns if c not in (key, *order)]
    rows = changes.where(F.col(key).isNotNull()).groupBy(key)
    return rows.agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*").select(*changes.columns)


def latest_state(changes: DataFrame, order: tuple[str, ...] = ("ts",), removed: tuple[str, ...] = (REMOVED,)) -> DataFrame:
    """Each file's last change, by order and then by the other columns; a removal drops the file."""
    return _last(changes, "path", order).where(~F.col("kind").isin(*removed))


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int = 20) -> DataFrame:
    """A stream of the Parquet files in a folder (X1, X3: a bounded number of files a batch, by default 20)."""
    return with_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def lasting(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that outlives the session, for a stream that goes on in the next one."""
    return f"{shared_folder(spark)}/graphloom/streams/{name}"


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Processes all that is there, in batches, and stops; with ``every``, polls at that interval and doesn't stop.

    A checkpoint, such as ``lasting`` names, makes the next run go on from here (X6); without one a run begins anew.
    """
    where = checkpoint or new_path(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", where)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Overlay:
    """The latest change of each file, kept below a root as tables: one a batch, merged by MERGED into one.

    A batch costs what it brings, not what the overlay holds. A batch that is delivered again changes nothing, a table
    that wasn't finished is written anew, and a driver that starts again on the root goes on from there, with ``follow``
    also in the stream. Removed files stay as rows that ``table`` hides, so that a late change can't revive them.
    """

    def __init__(self, spark: SparkSession, key: str = "path", order: tuple[str, ...] = ("ts",), removed: tuple[str, ...] = (REMOVED,), root: str | None = None):
        self.spark, self.key, self.order, self.removed = spark, key, order, removed
        self.root = root or new_path(spark, "overlay")
        self.replaced: list[str] = []
        tables = finished(spark, self.root) if root else []
        bases = [t for t in tables if t.startswith("base-")]
        least = bases[-1].replace("base-", "delta-") if bases else ""
        self.tables = bases[-1:] + [t for t in tables if t.startswith("delta-") and t > least]
        self.batch = int(self.tables[-1].rpartition("-")[2]) if self.tables else -1

    def _rows(self) -> DataFrame:
        return _last(self.spark.read.parquet(*[f"{self.root}/{t}" for t in self.tables]), self.key, self.order)

    def table(self) -> DataFrame | None:
        if not self.tables:
            return None
        rows = self._rows()
        return rows.where(~F.col("kind").isin(*self.removed)) if "kind" in rows.columns else rows

    def apply(self, changes: DataFrame, batch: int) -> None:
        if batch <= self.batch:
            return
        self._add(f"delta-{batch:012d}", _last(changes, self.key, self.order))
        self.batch = batch
        if len(self.tables) > MERGED:
            merged, before = f"base-{batch:012d}", self.tables
            self._write(merged, self._rows())
            for name in self.replaced:  # those of the merge before: readers of the last ones may still be at work
                drop_path(self.spark, f"{self.root}/{name}")
            self.tables, self.replaced = [merged], before

    def _add(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows)
        self.tables.append(name)

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def follow(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Takes in a stream of changes, from where the last run on this root stopped."""
        return run_once(stream, self.apply, checkpoint=f"{self.root}/checkpoint", every=every)

    def staleness(self) -> DataFrame | None:
        """(latest): the time of the last change."""
        return self._rows().agg(F.max(self.order[0]).alias("latest")) if self.tables else None
