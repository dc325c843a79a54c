"""Problem 1: the score up to which a target share of each source is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import cut_rows
from ..runtime import materialize, small, table
from ..operators.records import labelled_records, usable_loss


def usable_records(scores: DataFrame, catalog: DataFrame) -> DataFrame:
    """rank, source, topic, loss of the records with a usable loss, written once (a narrow table)."""
    records = labelled_records(scores, catalog, ["source", "topic", "mean_loss", "n_pred"])
    usable = records.select("rank", "source", "topic", usable_loss().alias("loss")).where("loss is not null")
    return materialize(usable, "usable")


def cutoffs(records: DataFrame, targets: DataFrame, group: str = "source", score: str = "loss", identifier: str = "rank") -> DataFrame:
    """Score cutoff per group that keeps ``keep_pct`` percent of the group.

    Rows are sorted by (group, score, identifier) in ranges, so a group that holds most of the rows is spread over all
    tasks; exact cumulative positions come from the counts of the ranges, and the cutoff is the score at position
    ceil(n * keep_pct / 100). ``targets``: group, keep_pct. Result: group, keep_pct, n, target, cutoff, and ``last``, the
    identifier at the target position (keeping (score, identifier) <= (cutoff, last) keeps exactly ``target`` rows, keeping
    score <= cutoff also keeps the ties). Groups without target, or without rows, or with keep_pct 0 have no cutoff row.
    """
    sizes = records.groupBy(group).agg(F.count("*").alias("n"))
    wanted = sizes.join(targets.select(group, "keep_pct"), group)
    wanted = wanted.withColumn("target", F.expr("(n * keep_pct + 99) div 100")).where("target > 0")
    cuts = cut_rows(records, wanted.select(group, "target"), [score, identifier], group=[group])
    return wanted.join(cuts.select(group, F.col(score).alias("cutoff"), F.col(identifier).alias("last")), group)


def kept(records: DataFrame, cuts: DataFrame, group: str = "source", score: str = "loss") -> DataFrame:
    """The records whose score does not exceed their group's cutoff (one cutoff row per group)."""
    return records.join(small(cuts.select(group, "cutoff")), group).where(F.col(score) <= F.col("cutoff"))


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = usable_records(table(spark, folder, "scores"), table(spark, folder, "doc_counts"))
    return records, materialize(cutoffs(records, table(spark, folder, "source_targets")), "cutoffs")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return kept(*_inputs(spark, folder)).select("rank")


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: wanted percent, usable records, target, cutoff, kept records (ties at the cutoff included)."""
    records, cuts = _inputs(spark, folder)
    sizes = kept(records, cuts).groupBy("source").agg(F.count("*").alias("n_kept"))
    return cuts.join(sizes, "source").select("source", "keep_pct", F.col("n").alias("n_usable"), "target", F.col("cutoff").cast("double").alias("cutoff"), "n_kept", F.round(F.col("n_kept") / F.col("n"), 6).alias("kept_share"))


def p1_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    """Per source and topic: usable and kept records under the source's cutoff."""
    records, cuts = _inputs(spark, folder)
    joined = records.join(small(cuts.select("source", "cutoff")), "source")
    return joined.groupBy("source", "topic").agg(F.count("*").alias("n_usable"), F.count_if(F.col("loss") <= F.col("cutoff")).alias("n_kept"))
