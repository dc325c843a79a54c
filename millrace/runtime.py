"""Session and shared storage.

``materialize`` cuts lineage with a table in the folder that all executors share (``spark.checkpoint.dir``). Such tables
survive the loss of executors, and a plan that needs an intermediate result twice reads it twice instead of making it twice.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def session(app: str = "millrace", cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for; on a cluster the driver brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the session's Python workers (once per application), wherever they run and whatever their path
    is: Spark's file server hands them an archive of its modules."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("millrace", os.path.relpath(path, root)))
        context.addPyFile(archive)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of this machine only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The tables live until the end of
    their ``scope``, ``release`` or the end of the process."""
    spark = ship(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20  # as written: compressed columns


def _bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def _written_small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    kept = materialize(df, "small")
    fits = _bytes(*_TABLES[-1]) <= BROADCAST_BYTES and kept.limit(rows + 1).count() <= rows
    return kept, fits


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for the small side of a join: written, measured, and marked for broadcast only if it has at most ``rows`` rows and
    BROADCAST_BYTES; beyond that it is joined by a shuffle, whose skewed partitions Spark splits."""
    kept, fits = _written_small(df, rows)
    return F.broadcast(kept) if fits else kept


HOT_ROWS = 1_000_000


def spread_join(rows: DataFrame, few: DataFrame, on: Sequence[str], hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``few`` by the columns ``on``, of which one value may hold a large part of the rows.

    If ``few`` is small by measure, it goes to the rows and nothing is shuffled. Otherwise the keys with over ``hot`` rows are
    counted (at most rows / hot of them), their rows are dealt to parts of about that size, and only their matches are copied to each part.
    Null keys join nothing.
    """
    on = list(on)
    kept, fits = _written_small(few, BROADCAST_ROWS)
    if fits:
        return rows.join(F.broadcast(kept), on)
    sizes = rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > hot)
    heavy = small(sizes.select(*on, F.expr(f"cast(__n div {hot} as int)").alias("__last")))
    last = F.coalesce("__last", F.lit(0))
    dealt = rows.withColumn("__h", F.xxhash64(*rows.columns)).join(heavy, on, "left").withColumn("__salt", F.pmod("__h", last + 1).cast("int")).drop("__h", "__last")
    copied = kept.join(heavy, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("__last")
    return dealt.join(copied, [*on, "__salt"]).drop("__salt")


@contextmanager
def scope() -> Iterator[None]:
    """Delete, at the end of the block, the tables that were materialized in it; its results must be written or read inside."""
    before = len(_TABLES)
    try:
        yield
    finally:
        release(before)


def release(before: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote in this process, but for the first ``before``."""
    while len(_TABLES) > before:
        spark, path = _TABLES.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended already
            return


atexit.register(release)


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A parquet table of a data folder. ``spread``: for heavy work on each row; a table of fewer splits than there are cores
    (one small file, say) is dealt to all of them, a larger one is left as it is read."""
    rows = ship(spark).read.parquet(f"{folder}/{name}.parquet")
    if spread and rows.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        return rows.repartition(cores)
    return rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
