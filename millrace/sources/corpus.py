"""Sources: JSON-lines corpora (plain, gz, zst), file catalogs, evaluation logs, training logs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import last_match
from ..functions.labels import directory, parse_dir
from ..operators.dynamics import as_of

METADATA = "struct<text_hash:string,weborganizer_max:string,original_word_count:int,language:string,dolma2_qc:map<string,double>>"
DOCUMENT = f"struct<id:string,text:string,metadata:{METADATA}>"
QC_FIELD = r'"dolma2_qc":\s*(\{[^{}]*\})'  # fixed value: where a line has its quality scores
LOG_PATTERN = r"'eval_loss': '([0-9.]+)'.{0,300}?'total_tokens_seen': ([0-9]+)"  # fixed value: a loss and its tokens in a log


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(``path``, ``line``, ``value``): the lines of text files that are not blank, numbered from 0; Spark picks the codec by
    the suffix (.gz, .zst).

    Lines are numbered within each split of a file, and the splits' counts give the offsets, so a large file that can be split
    is no single task. A compressed file is one split: work on its lines should follow a repartition.
    """
    read = spark.read.text(paths, wholetext=False).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), "value", F.monotonically_increasing_id().alias("__at")
    )
    filled = read.where(F.trim("value") != "")
    inside = Window.partitionBy("path", "__block").orderBy("__at")
    numbered = filled.withColumn("__rn", F.row_number().over(inside) - 1)
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = filled.groupBy("path", "__block").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = numbered.join(starts.select("path", "__block", "__start"), ["path", "__block"])
    return joined.select("path", (F.col("__start") + F.col("__rn")).cast("long").alias("line"), "value")


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of JSON lines: ``path``, ``line``, ``id``, ``text``, ``metadata``; a broken line gives nulls."""
    parsed = lines(spark, paths).select("path", "line", F.from_json("value", DOCUMENT).alias("d"))
    return parsed.select("path", "line", "d.id", "d.text", "d.metadata")


def qc_score(line: Column, key: str = "1") -> Column:
    """The quality score of a raw line, without parsing the rest: from the last match of its field; null without one."""
    return F.get_json_object(last_match(line, QC_FIELD), f"$.{key}").cast("double")


def json_documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a given schema (no inference pass)."""
    return spark.read.schema(schema).json(paths)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(``path``, ``bytes``) of the files below a folder, in path order; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("bytes")).orderBy("path")


def count_documents(docs: DataFrame, path: str = "path") -> DataFrame:
    """(``shard``, ``file_path``, ``n_docs``): the catalog of a corpus; shards are numbered in path order."""
    counted = docs.groupBy(F.col(path).alias("file_path")).agg(F.count("*").alias("n_docs"))
    return counted.select((F.row_number().over(Window.orderBy("file_path")) - 1).cast("int").alias("shard"), "file_path", "n_docs")  # a row per file


def check_catalog(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """Files whose number of documents differs between two catalogs, or that only one has; empty if the catalog holds."""
    a, b = catalog.select("file_path", F.col("n_docs").alias("listed")), fresh.select("file_path", F.col("n_docs").alias("counted"))
    return a.join(b, "file_path", "full").where(~F.col("listed").eqNullSafe(F.col("counted")))


def with_offsets(catalog: DataFrame) -> DataFrame:
    """The catalog with ``lo`` and ``hi`` (exclusive): the row ids of each file, and its labels. A row per file."""
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = catalog.withColumn("hi", F.sum("n_docs").over(upto))
    labels = parse_dir(directory(F.col("file_path")))
    return ends.withColumn("lo", F.col("hi") - F.col("n_docs")).withColumn("__d", labels).select(*catalog.columns, "lo", "hi", "__d.source", "__d.topic", "__d.vigintile")


MAX_FILES = 1_000_000  # up to which the bounds of the files go to the tasks (24 MB)


def locate(rows: DataFrame, catalog: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows with the ``shard`` and ``shard_offset`` of their row id; ids outside the catalog and null ids get nulls.

    The bounds of up to MAX_FILES files are sorted arrays that go to the tasks, where each id is found by binary search; only the
    ids pass through Python. Beyond that, an as-of join over ranges finds the last file that begins at or before the id.
    Columns of these names are replaced.
    """
    rows = rows.drop("shard", "shard_offset")
    bounds = with_offsets(catalog).where("n_docs > 0").select("lo", "hi", "shard")
    found = bounds.limit(MAX_FILES + 1).toPandas()
    if len(found) > MAX_FILES:
        file = bounds.select(F.col("lo").alias(row_id), F.struct("lo", "hi", "shard").alias("__file"))
        located = as_of(rows, file, row_id, "__file")
        inside = F.col(row_id) < F.col("__file.hi")
        return located.select(*rows.columns, F.when(inside, F.col("__file.shard")).cast("int").alias("shard"), F.when(inside, F.col(row_id) - F.col("__file.lo")).alias("shard_offset"))
    found = found.sort_values("lo")
    sent = rows.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy(np.int64) for c in ("lo", "hi", "shard")))

    @F.pandas_udf("shard int, shard_offset long")
    def search(ids: pd.Series) -> pd.DataFrame:
        lo, hi, shard = sent.value
        known = ids.notna().to_numpy()
        values = ids.fillna(-1).to_numpy(np.int64)
        at = np.searchsorted(lo, values, side="right") - 1
        known &= (at >= 0) & (values < hi[at]) if len(lo) else False
        out = pd.DataFrame({"shard": shard[at] if len(lo) else 0, "shard_offset": values - (lo[at] if len(lo) else 0)}, index=ids.index).astype("Int64")
        out.loc[~known, :] = pd.NA
        return out

    placed = rows.withColumn("__at", search(F.col(row_id).cast("long")))
    return placed.select(*rows.columns, "__at.shard", "__at.shard_offset")


def eval_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark logs ``<model>/<suite>/.../samples_<task>_<date>.jsonl``: model, suite, task, key (the suite for mmlu tasks), and
    the record's fields. ``target`` is read as a string, whatever its type."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "samples_*.jsonl").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    record = "doc_id long, target string, arguments map<string,struct<arg_1:string>>, filtered_resps array<array<string>>"
    root = re.escape(folder.rstrip("/").removeprefix("file://"))
    part = lambda k: F.regexp_extract("path", root + r"/([^/]+)/([^/]+)/", k)
    task = F.regexp_extract("path", r"samples_(.+)_\d{4}-\d\d-\d\dT", 1)
    named = raw.select(part(1).alias("model"), part(2).alias("suite"), task.alias("task"), F.from_json("value", record).alias("r"))
    return named.select("model", "suite", "task", F.when(F.col("task").startswith("mmlu"), F.col("suite")).otherwise(F.col("task")).alias("key"), "r.*")


def eval_losses(logs: DataFrame, tokens_per_step: int, text: str = "value", run: str = "run") -> DataFrame:
    """(run, step, loss) from whole log texts: pairs of ``'eval_loss': 'x'`` and a following ``'total_tokens_seen': n`` in the
    next 300 characters; the last value of a step wins."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LOG_PATTERN), F.lit(1)).alias("loss"), F.regexp_extract_all(text, F.lit(LOG_PATTERN), F.lit(2)).alias("seen"))
    found = logs.select(run, F.posexplode(pairs).alias("at", "p"))
    step = F.round(F.col("p.seen").cast("double") / tokens_per_step).cast("long")
    return found.groupBy(run, step.alias("step")).agg(F.max_by(F.col("p.loss").cast("double"), "at").alias("loss"))


@dataclass
class Config:
    """Options of the pipeline; the defaults are fixed values, those of the project."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    train_frac: float = 0.05
    num_eval: int = 50_000
    num_dev: int = 10_000
    seed: int = 42
    pool_seed: int = 20_261_015
    target_tokens: float = 1.9e10
    tokens_per_row: float = 1511.6
    z_clip: float = 3.0
    min_scored: int = 32
    block_size: int = 2048
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML or JSON file; unknown keys go to ``extra``, nested sections are flattened."""
        with open(path) as f:
            text = f.read()
        try:
            import yaml

            values = yaml.safe_load(text) or {}
        except ImportError:
            import json

            values = json.loads(text)
        flat: dict = {}
        for key, value in values.items():
            flat.update(value if isinstance(value, dict) else {key: value})
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in flat.items() if k in known}, extra={k: v for k, v in flat.items() if k not in known})
