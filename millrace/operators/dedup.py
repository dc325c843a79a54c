"""Exact dedup, decontamination and repetition statistics by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import copy_bucket
from ..functions.hashing import hash64
from .prefix import cut_rows, up_to


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least ``order`` of each key. Aggregated map-side, so a key with many copies is no hot partition.

    Rows without key are each their own. Of several rows with the least ``order`` any one is kept.
    """
    others = [c for c in rows.columns if c != key]
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("__r"))
    return keyed.select(*[F.col(key) if c == key else F.col(f"__r.`{c}`").alias(c) for c in rows.columns]).unionByName(rows.where(F.col(key).isNull()))


def without_keys(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``other`` (null keys stay)."""
    return rows.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*rows.columns)


def with_keys(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return rows.join(other.select(key).distinct(), key, "left_semi").select(*rows.columns)


def deduplicated(rows: DataFrame, key: str, rank: str, eval_from: int) -> DataFrame:
    """Training rows: the copy of least rank of each key, unless a row of rank ``eval_from`` or more has the key.

    One aggregation by key decides both: if the greatest rank of a key is an evaluation rank, all its copies go.
    """
    keyed = rows.where(F.col(key).isNotNull() & F.col(rank).isNotNull())
    others = [c for c in rows.columns if c != key]
    best = keyed.groupBy(key).agg(F.min_by(F.struct(*others), F.col(rank)).alias("__r"), F.max(rank).alias("__most")).where(F.col("__most") < eval_from)
    return best.select(*[F.col(key) if c == key else F.col(f"__r.`{c}`").alias(c) for c in rows.columns])


def uniform_selection(rows: DataFrame, seed: int, identifier: str, size: Column, target: float | None = None, fraction: float | None = None) -> DataFrame:
    """A uniform selection in a fresh seeded order: the first prefix whose size reaches ``target`` (the row that crosses it
    included; all rows if there is less), or the first int(fraction * n) rows."""
    ordered = rows.withColumn("__h", hash64(seed, F.col(identifier)))
    if target is not None:
        goal, weight = rows.agg(F.least(F.lit(int(-(-target // 1))).cast("long"), F.sum(size).cast("long")).alias("target")), size
    else:
        goal, weight = rows.agg(F.floor(F.count("*") * F.lit(fraction)).cast("long").alias("target")), None
    goal = goal.where("target > 0")
    cuts = cut_rows(ordered, goal, ["__h", identifier], weight)
    return up_to(ordered, cuts, ["__h", identifier]).drop("__h")


def dedup_stats(rows: DataFrame, key: str, rank: str, size: str, eval_from: int, selected: DataFrame | None = None, chars_per_token: float | None = None) -> DataFrame:
    """One row: documents, distinct texts, training documents, kept, dropped as evaluation texts, sizes, most copies; with
    ``selected`` rows their number and size, with ``chars_per_token`` that and the estimated tokens of the kept texts."""
    train = F.col(rank) < eval_from
    per_key = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(train).alias("n_train"), F.coalesce(F.sum(F.when(train, F.col(size))), F.lit(0)).alias("train_size"),
        F.min_by(F.col(size), F.col(rank)).alias("first_size"), F.max(F.when(~train, 1).otherwise(0)).alias("in_eval"),
    )
    kept = F.col("in_eval") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = per_key.agg(
        total("n").alias("docs"), F.count("*").alias("unique_texts"), total("n_train").alias("train_docs"), F.count_if(kept).alias("train_docs_kept"),
        total(F.when(~kept, F.col("n_train"))).alias("train_docs_in_eval"), total("train_size").alias("train_chars"),
        total(F.when(kept, F.col("first_size"))).alias("train_chars_kept"), F.coalesce(F.max("n"), F.lit(0)).alias("max_copies"),
    )
    if selected is not None:
        picked = selected.agg(F.count("*").alias("n"), total(size).alias("s"))
        out = out.withColumns({"train_docs_selected": picked.select("n").scalar(), "train_chars_selected": picked.select("s").scalar()})
    if chars_per_token is not None:
        out = out.withColumns({"est_unique_train_tokens": F.floor(F.col("train_chars_kept") / F.lit(chars_per_token)).cast("long"), "chars_per_token": F.lit(float(chars_per_token))})
    return out


def copies(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Per key: copies, total size. The base of the repetition reports."""
    return rows.groupBy(key).agg(F.count("*").alias("copies"), F.sum(size).alias("size"))


def copy_histogram(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Documents and size by bucket of the number of copies."""
    per_key = copies(rows, key, size)
    out = per_key.groupBy(copy_bucket(F.col("copies")).alias("copies")).agg(F.sum("copies").alias("docs"), F.sum("size").alias("size"))
    return out.withColumn("size_pct", F.round(100 * F.col("size") / F.sum("size").over(Window.partitionBy()), 4))  # one row per bucket


def repetition_summary(rows: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """One row: documents, distinct texts, repeated copies beyond each text's first and their size, size-weighted mean copies."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("s"), F.min_by(F.col(size), F.col(order)).alias("f"))
    return per_key.agg(
        F.sum("n").alias("docs"), F.count("*").alias("texts"), F.sum(F.col("n") - 1).alias("repeated_docs"), F.sum(F.col("s") - F.col("f")).alias("repeated_size"),
        F.round(F.sum(F.col("n") * F.col("s")) / F.sum("s"), 6).alias("mean_copies"), F.max("n").alias("max_copies"),
    )


def top_repeats(rows: DataFrame, key: str, size: str, k: int = 15) -> DataFrame:
    """The k texts that take the most room in all copies."""
    return copies(rows, key, size).orderBy(F.col("size").desc(), F.col(key)).limit(k)


def overlap_counts(train: DataFrame, held_out: DataFrame, key: str, size: str) -> DataFrame:
    """One row: training rows (and size) whose key a held-out row has, held-out keys hit, held-out keys. Rows without key
    are counted in none. One aggregation of both sides by key."""
    both = train.select(key, F.lit(1).alias("t"), F.col(size).alias("s")).unionByName(held_out.select(key, F.lit(0).alias("t"), F.lit(0).cast(train.schema[size].dataType).alias("s")))
    per_key = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("t").alias("n"), F.sum("s").alias("s"), F.min("t").alias("m"))
    held = F.col("m") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_key.agg(total(F.when(held, F.col("n"))).alias("train_docs_hit"), total(F.when(held, F.col("s"))).alias("train_size_hit"), F.count_if(held & (F.col("n") > 0)).alias("held_out_hit"), F.count_if(held).alias("held_out_keys"))
