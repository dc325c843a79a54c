"""Queries over files: tables are written in the pipeline's formats to the shared folder and read by its sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import dynamics, tokens
from ..runtime import shared_dir, table
from ..sources import corpus, sinks
from . import corpus_queries as base
from . import experiment_queries as experiments

Q: dict = {}
SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_file(rows: DataFrame, path: str) -> None:
    """The lines of a small log as one file of a given name."""
    spark = rows.sparkSession
    rows.coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    jvm = spark.sparkContext._jvm
    system, parts = sinks._file_system(spark, f"{path}.parts")
    for status in system.listStatus(parts):
        if status.getPath().getName().startswith("part-"):
            system.mkdirs(jvm.org.apache.hadoop.fs.Path(path).getParent())
            system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(path))
    system.delete(parts, True)


@query("select doc_id, md5(text) as hash, length(text) as chars, 1::bigint as places from documents")
def jsonl_corpus(spark, folder):
    """Documents as compressed JSON lines with blank lines between, read back; each line of a file has a number of its own."""
    path = _place(spark, "jsonl")
    sinks.write_jsonl(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), f"{path}", compression="gzip")
    spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(path)
    found = corpus.documents(spark, path)
    places = found.groupBy("path", "line").agg(F.count("*").alias("places"))
    return found.join(places, ["path", "line"]).select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("hash"), F.length("text").alias("chars"), "places")


@query("select sum(n_docs)::bigint as docs, count(*) as files, 0::bigint as differing from (select count(*) as n_docs from documents group by doc_id % 5)")
def counted_files(spark, folder):
    """The catalog of a corpus written as five files, counted, and checked against a second count."""
    path = _place(spark, "counted")
    docs = table(spark, folder, "documents").select(F.pmod("doc_id", F.lit(5)).alias("part"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("value"))
    docs.repartition("part").write.mode("overwrite").partitionBy("part").text(path)
    read = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"))
    catalog = corpus.count_documents(read)
    differing = corpus.check_catalog(catalog, corpus.count_documents(corpus.lines(spark, f"{path}/*").select("path"))).count()
    return catalog.agg(F.sum("n_docs").alias("docs"), F.count("*").alias("files")).withColumn("differing", F.lit(differing).cast("long"))


@query(f"with {experiments.METRICS} select step, block, metric, round(sum(value), 6) as value, count(*) as n from m group by all")
def metric_files(spark, folder):
    """A metric log as JSON lines, read back as a long table."""
    path = _place(spark, "metrics")
    lines = experiments.metrics(spark, folder).select(F.to_json(F.map_from_arrays(F.array(F.lit("step"), F.lit("time"), F.concat(F.lit("type/"), "block", F.lit("/"), "metric")), F.array(F.col("step").cast("double"), F.lit(1.5), "value"))).alias("value"))
    lines.write.mode("overwrite").text(path)
    found = dynamics.with_block(dynamics.long_metrics(spark.read.text(path)))
    return found.groupBy("step", "block", "metric").agg(F.round(F.sum("value"), 6).alias("value"), F.count("*").alias("n"))


@query("""select 'm' || (label % 2) as model, 'suite' as suite, 'task' as task, 'task' as key, count(*) as n, sum(label % 4)::bigint as targets, round(sum(embedding[1]::double), 4) as likelihood from embeddings group by 1
 union all select 'm' || (label % 2), 'mmlu', 'mmlu_law', 'mmlu', count(*), sum(label % 4)::bigint, round(sum(embedding[1]::double), 4) from embeddings group by 1""")
def sample_files(spark, folder):
    """Benchmark logs of two models and two suites, read from their folders."""
    path = _place(spark, "samples")
    rows = table(spark, folder, "embeddings")
    record = F.struct(F.col("vec_id").alias("doc_id"), (F.col("label") % 4).cast("string").alias("target"), F.array(F.array(F.get("embedding", F.lit(0)).cast("double").cast("string"), F.lit("True"))).alias("filtered_resps"))
    for model in (0, 1):
        for suite, task in (("suite", "task"), ("mmlu", "mmlu_law")):
            _as_file(rows.where(F.col("label") % 2 == model).select(F.to_json(record).alias("value")), f"{path}/m{model}/{suite}/run/samples_{task}_2026-01-02T03-04-05.jsonl")
    found = corpus.eval_samples(spark, path)
    likelihood = F.get(F.get("filtered_resps", F.lit(0)), F.lit(0)).cast("double")
    return found.groupBy("model", "suite", "task", "key").agg(F.count("*").alias("n"), F.sum(F.col("target").cast("long")).alias("targets"), F.round(F.sum(likelihood), 4).alias("likelihood"))


@query("select event_type as run, event_id as step, round(value, 4) as loss from events where value > 0")
def log_files(spark, folder):
    """Run logs as text, of which losses and steps are scraped; the later value of a step wins."""
    path = _place(spark, "logs")
    rows = table(spark, folder, "events").where("value > 0").select("event_type", "event_id", F.format_string("{'eval_loss': '%s', 'x': 1}\n{'eval_loss': '%s', 'total_tokens_seen': %s}", F.lit("9.5"), F.round("value", 4).cast("string"), (F.col("event_id") * 100).cast("string")).alias("value"))
    rows.select("event_type", "value").repartition("event_type").write.mode("overwrite").partitionBy("event_type").text(path)
    logs = spark.read.text(path, wholetext=True).select(F.col("event_type").alias("run"), "value")
    return corpus.eval_losses(logs, 100)


@query(f"with {base._STREAM}, f as (select doc_id, count(*) + 2 as n, sum(v) + 256001 as total from s group by doc_id) select (sum(n) + 2 * (select count(*) from documents where text is not null and trim(text, ' ') = ''))::bigint as tokens, (sum(total) + 256001 * (select count(*) from documents where text is not null and trim(text, ' ') = ''))::bigint as total, true as whole from f")
def token_files(spark, folder):
    """Framed documents as a token table, exported as one file of 32-bit numbers and read back in runs."""
    path, local = _place(spark, "tokens"), sinks.local_path(_place(spark, "stream"))
    docs = base._length_docs(spark, folder).select("doc_id", tokens.framed(F.col("ids")).alias("ids"))
    sinks.write_tokens(docs, path, ["doc_id"])
    written = sinks.export_tokens(spark, path, local)
    runs = sinks.read_token_file(spark, local, 4096)
    out = runs.agg(F.sum(F.size("ids")).alias("tokens"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    return out.withColumn("whole", F.col("tokens") == F.lit(written))


@query("select count(*) as rows, count(*) as again, count(*) as linked, 7 as reported, count(*) as noted from pool")
def sinks_round_trip(spark, folder):
    """A table made once, asked for again, linked; a report and a note of its size."""
    path = _place(spark, "sinks")
    pool = table(spark, folder, "pool").select("row_id", "source")
    first = sinks.once(spark, f"{path}/pool", lambda: pool)
    again = sinks.once(spark, f"{path}/pool", lambda: pool.limit(0))
    linked = sinks.link(spark, f"linked_{uuid.uuid4().hex}", f"{path}/pool")
    named = labels.canonical(first.withColumn("topic", F.lit("-")), table(spark, folder, "doc_counts"), vigintile=None)
    sinks.write_report(named.where("source is not null and source <> ''").groupBy("source").agg(F.count("*").alias("n")), f"{path}/report")
    note = sinks.write_meta(spark, f"{path}/meta", {"seed": 1}, rows=first.count())
    noted = note.select(F.get_json_object("value", "$.rows").cast("long").alias("n"))
    report = spark.read.option("header", "true").csv(f"{path}/report").agg(F.count("*").cast("int").alias("n"))
    return first.agg(F.count("*").alias("rows")).select("rows", again.agg(F.count("*")).scalar().alias("again"), linked.agg(F.count("*")).scalar().alias("linked"), report.scalar().alias("reported"), noted.scalar().alias("noted"))


@query("select distinct regexp_replace(regexp_extract(file_path, '([^/]+)/[^/]+$', 1), '-[0-9]{4}$', '') as source from doc_counts")
def plain_sources(spark, folder):
    """Directories without their number."""
    return table(spark, folder, "doc_counts").select(labels.source_of(labels.directory(F.col("file_path"))).alias("source")).distinct()
