"""The records of the score and pool tables: one row per rank or row id, cleaned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical
from ..runtime import small

MAX_TOKENS = 1_000_000


def usable_loss() -> Column:
    """``mean_loss`` where it is a finite number above 0 and something was predicted, else null."""
    loss = F.col("mean_loss")
    fine = loss.isNotNull() & ~F.isnan(loss) & (loss > 0) & (loss < F.lit(float("inf"))) & (F.col("n_pred") > 0)
    return F.when(fine, loss)


def usable_count() -> Column:
    """``n_tokens`` where it lies in 1 .. MAX_TOKENS, else null."""
    return F.when(F.col("n_tokens").between(1, MAX_TOKENS), F.col("n_tokens"))


def latest_records(scores: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per ``rank``: that of the greatest ``scored_at``, with the columns ``keep``.

    Rows without rank are no records. Rows of equal ``scored_at`` are repeats; if their values differ, the later
    ``loaded_at`` and then the greater values win, so the result does not depend on the order of the rows.
    """
    columns = [c for c in dict.fromkeys(["rank", *keep])]
    slim = scores.where(F.col("rank").isNotNull()).select(*dict.fromkeys([*columns, "scored_at", "loaded_at"]))
    newest = Window.partitionBy("rank").orderBy(F.col("scored_at").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns[1:]])
    return slim.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").select(*columns)


def labelled_records(scores: DataFrame, catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``latest_records`` with source, topic and vigintile (those among ``keep``) in canonical form."""
    labels = [c for c in ("source", "topic", "vigintile") if c in keep]
    needed = [*keep, *[c for c in ("source", "topic") if labels and c not in keep]]
    found = latest_records(scores, needed)
    if labels:
        found = canonical(found, catalog, vigintile="vigintile" if "vigintile" in keep else None)
    return found.select("rank", *[c for c in keep if c != "rank"])


def usable_scores(scores: DataFrame, catalog: DataFrame) -> DataFrame:
    """rank, source, topic, ``n_tokens``, ``mean_loss`` (double) of the records with a usable loss and a usable count."""
    records = labelled_records(scores, catalog, ["source", "topic", "n_tokens", "n_pred", "mean_loss"])
    return records.select("rank", "source", "topic", usable_count().alias("n_tokens"), usable_loss().cast("double").alias("mean_loss")).where("mean_loss is not null and n_tokens is not null")


def with_row_id(pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fill a missing ``row_id``: documents of all earlier files + ``shard_offset``. The catalog has a row per file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = catalog.select("shard", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("__start"))
    known = pool.join(small(starts), "shard", "left")
    return known.withColumn("row_id", F.coalesce("row_id", F.col("__start") + F.col("shard_offset"))).select(*pool.columns)


def pool_records(pool: DataFrame, catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per ``row_id``, missing ids filled first: the row that arrived first (``added_at``; ties: the least values of
    ``keep`` in their order, nulls last), whole, with the columns ``keep``. Rows whose id can't be told are left out."""
    columns = list(dict.fromkeys(["row_id", *keep]))
    slim = with_row_id(pool.select(*dict.fromkeys([*columns, "shard", "shard_offset", "added_at"])), catalog).where("row_id is not null")
    first = Window.partitionBy("row_id").orderBy(F.col("added_at").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns[1:]])
    return slim.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(*columns)
