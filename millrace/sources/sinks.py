"""Sinks: token files, tables that are done or not there, JSON lines and CSV reports, provenance."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import starts_of


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def local_path(path: str) -> str:
    """The file-system path of a folder that all executors mount."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is no mounted folder")
    return "/" + path.removeprefix("file:").lstrip("/")


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end (its marker exists)."""
    system, target = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written only if it is not there to its end, so a restarted job resumes."""
    if not is_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_tokens(docs: DataFrame, path: str, order: list[str], ids: str = "ids") -> DataFrame:
    """Write the documents' tokens as uint32 records by ``order``: a table of parts (``part``, ``start``, ``tokens``, ``data``)
    that, read by ``start``, are the stream. Returns the parts' catalog; checks that the lengths agree and that no part ends in zeros,
    as one would whose writing broke off.

    Documents know their offsets (a distributed prefix sum), so tasks write their own ranges and nothing is collected.
    """
    spark = docs.sparkSession
    sized = starts_of(docs.select(*order, ids).withColumn("__n", F.size(ids)), order, "__n", "__start")
    ranged = sized.repartitionByRange(F.col("__start")).sortWithinPartitions("__start").select("__start", F.col(ids).alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch is a contiguous run of the stream
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([len(flat)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["start", "tokens", "data"])

    ranged.mapInArrow(join, "start long, tokens long, data binary").write.mode("overwrite").parquet(path)
    parts = spark.read.parquet(path)
    tail = F.substring("data", -4, 4)
    if parts.where((F.length("data") != F.col("tokens") * 4) | ((F.col("tokens") > 0) & (tail == F.lit(bytes(4))))).limit(1).count():
        raise ValueError(f"{path}: a part's length differs from its number of tokens, or its tail is zero")
    return parts.select("start", "tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(``start``, ``ids``) of the parts of a token table."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in batch.column(1).to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))], names=["start", "ids"])

    return spark.read.parquet(path).select("start", "data").mapInArrow(split, "start long, ids array<int>")


def export_tokens(spark: SparkSession, path: str, file: str) -> int:
    """One uint32 file of a token table; returns the tokens written. Tasks write their parts at their places into a file that is
    laid out first, so nothing passes through the driver; the file must be visible under this path to all executors. A
    repeated task writes the same bytes again. The file gets its name when it is whole."""
    import os

    parts = spark.read.parquet(path)
    total = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    with open(f"{file}.tmp", "wb") as out:
        out.truncate(total * 4)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(f"{file}.tmp", "r+b") as out:
            for batch in batches:
                for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out.seek(start * 4)
                    written += out.write(data.as_buffer()) // 4
        yield pa.record_batch([pa.array([written], pa.int64())], names=["tokens"])

    written = parts.select("start", "data").mapInArrow(write, "tokens long").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if written != total:
        raise ValueError(f"{file}: {written} of {total} tokens written")
    os.replace(f"{file}.tmp", file)
    return written


def read_token_file(spark: SparkSession, file: str, size: int = 1 << 20) -> DataFrame:
    """(``start``, ``ids``): a uint32 file as runs of ``size`` tokens; tasks read their ranges by memory map.

    The file must be visible under this path to all executors.
    """
    import os

    total = os.path.getsize(file) // 4
    runs = spark.range(0, total, size).select(F.col("id").alias("start"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = np.memmap(file, dtype="<u4", mode="r") if total else np.zeros(0, "<u4")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                ids = np.asarray(stream[start : start + size]).astype(np.int32)
                yield pa.record_batch([pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])

    return runs.mapInArrow(load, "start long, ids array<int>")


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None, compression: str = "none") -> None:
    """JSON lines, in global order if asked for."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("compression", compression).json(path)


def write_report(rows: DataFrame, path: str, digits: int = 4) -> None:
    """A small report as one CSV file with rounded numbers."""
    numbers = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")}
    rounded = rows.select(*[F.round(c, digits).alias(c) if c in numbers else F.col(c) for c in rows.columns])
    rounded.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_meta(spark: SparkSession, path: str, options: dict, **counts: int) -> DataFrame:
    """One JSON row with the options and counts of a run."""
    row = json.dumps({"options": options, **counts, "written_at": datetime.now(timezone.utc).isoformat()}, sort_keys=True)
    out = spark.createDataFrame([(row,)], "value string")
    out.coalesce(1).write.mode("overwrite").text(path)
    return out


def link(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A named view of an existing table instead of a copy."""
    table = spark.read.parquet(path)
    table.createOrReplaceTempView(name)
    return table
