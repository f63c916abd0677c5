"""Sessions, and tables in the folder that the driver and all executors share.

Iterative operators cut lineage by writing each round to ``spark.checkpoint.dir`` as Parquet: columnar, prunable, and
safe if an executor is lost, which a local checkpoint isn't.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after it has been counted and found to have at most so many narrow rows.
BROADCAST_ROWS = 100_000

#: Shared tables that this driver has made and not dropped, in order.
PATHS: list[str] = []


def session(name: str = "graphloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the caller's settings win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the session is local, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table of this package from the shared folder; a session that has ended is no error."""
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables in a folder, in order; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where) if s.isDirectory()]
    return sorted(p.getName() for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it goes when the driver's Python ends, or with ``released``."""
    path = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    PATHS.append(path)
    atexit.register(drop_path, spark, path)
    return path


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Drops the shared tables that were made inside, so that a long session doesn't fill the store.

    For a caller who has written or collected the results; plans over those tables can't be read afterwards.
    """
    before = len(PATHS)
    try:
        yield
    finally:
        while len(PATHS) > before:
            drop_path(spark, PATHS.pop())


def share(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and returns it as read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Shares df and marks it for broadcast if it has been counted and is small."""
    kept = share(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept
