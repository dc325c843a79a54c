"""Selection of rows: scores within groups, weighted draws to a token budget, percentile bands, splits and seeded orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, weighted_draw_key, z_bin
from ..functions.hashing import hash64, uniform
from ..runtime import small
from .prefix import cut_rows, exact_quantiles, running_total, up_to


def z_scores(rows: DataFrame, group: str, value: str, trusted: Column, limit: float = 3.0) -> DataFrame:
    """Add ``z``: (value - mean) / sample deviation of the group's trusted rows, clipped; 0 for untrusted rows, groups of
    one, and missing values. The statistics of the groups are aggregated and joined back, so no group is sorted."""
    rows = rows.drop("z")
    fine = trusted & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    stats = rows.where(fine).groupBy(F.col(group).alias("__group")).agg(F.avg(F.col(value).cast("double")).alias("__mu"), F.stddev_samp(F.col(value).cast("double")).alias("__sd"))
    joined = rows.join(stats, F.col(group).eqNullSafe(F.col("__group")), "left")
    z = clip(F.try_divide(F.col(value).cast("double") - F.col("__mu"), F.nullif(F.col("__sd"), F.lit(0.0))), -limit, limit)
    return joined.withColumn("z", F.when(fine, F.coalesce(z, F.lit(0.0))).otherwise(0.0)).select(*rows.columns, "z")


def group_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def weighted_draw(rows: DataFrame, beta: float, budget: int, seed: int, identifier: str = "row_id", size: str = "n_tokens_full", z: str = "z") -> DataFrame:
    """Weighted draw without replacement: rows by falling log(u) / exp(beta z) while their sizes sum to at most ``budget``.

    u is a hash of the identifier, so the draw is the same in every run. The budget's cut comes from a distributed prefix sum;
    rows without size or z are not drawn.
    """
    able = rows.where(F.col(size).isNotNull() & F.col(z).isNotNull())
    keyed = able.withColumn("__key", -weighted_draw_key(uniform(seed, F.col(identifier)), F.col(z), beta))
    goal = rows.sparkSession.range(1).select(F.lit(int(budget)).cast("long").alias("target"))
    cuts = cut_rows(keyed, goal, ["__key", identifier], F.col(size).cast("long"), reach=False)
    return up_to(keyed, cuts, ["__key", identifier]).drop("__key")


def subpool(rows: DataFrame, budget: int, seed: int, identifier: str = "row_id", size: str = "n_tokens_full") -> DataFrame:
    """A uniform subset in seeded order while the sizes sum to at most ``budget``."""
    return weighted_draw(rows.withColumn("__zero", F.lit(0.0)), 0.0, budget, seed, identifier, size, "__zero").drop("__zero")


def selected_by_bin(rows: DataFrame, chosen: Column, size: str, z: str = "z") -> DataFrame:
    """Per z bin: rows, share of rows and of size that were chosen, and whether nearly all were."""
    taken = F.avg(chosen.cast("double"))
    return rows.groupBy(z_bin(F.col(z)).alias("bin")).agg(F.count("*").alias("rows"), F.round(taken, 6).alias("share_rows"), F.round(F.try_divide(F.sum(F.when(chosen, F.col(size)).otherwise(0)), F.sum(size)), 6).alias("share_size"), (taken > 0.9).alias("saturating"))


def band_cuts(rows: DataFrame, group: str | None, value: str, size: str, drop_low: float, drop_high: float) -> DataFrame:
    """Per group (or ALL): rows, size, cuts at the linear percentiles, share of rows and size kept. Missing cuts are infinite."""
    grouped = rows.withColumn("group", F.col(group) if group else F.lit("ALL"))
    low, high = drop_low / 100, 1 - drop_high / 100
    wanted = [q for q, on in ((low, drop_low), (high, drop_high)) if on]
    cuts = grouped.select("group").distinct().withColumns({"low_cut": F.lit(float("-inf")), "high_cut": F.lit(float("inf"))})
    if wanted:
        found = exact_quantiles(grouped, value, wanted, "group")
        at = lambda q, missing: F.coalesce(F.max(F.when(F.col("q") == q, F.col("quantile"))), F.lit(missing))
        cuts = found.groupBy("group").agg((at(low, float("-inf")) if drop_low else F.lit(float("-inf"))).alias("low_cut"), (at(high, float("inf")) if drop_high else F.lit(float("inf"))).alias("high_cut"))
    cuts = small(cuts)  # one row per group
    joined = grouped.join(cuts, "group").withColumn("kept", F.col(value).between(F.col("low_cut"), F.col("high_cut")))
    return joined.groupBy("group").agg(
        F.count("*").alias("docs"), F.sum(size).alias("tokens"), F.first("low_cut").alias("low_cut"), F.first("high_cut").alias("high_cut"),
        F.avg(F.col("kept").cast("double")).alias("docs_kept"), F.try_divide(F.sum(F.when(F.col("kept"), F.col(size)).otherwise(0)), F.sum(size)).alias("tokens_kept"),
    )


def in_band(rows: DataFrame, cuts: DataFrame, group: str | None, value: str) -> DataFrame:
    """Rows within their group's cuts, both included. One cut row per group."""
    keyed = rows.withColumn("__group", F.col(group) if group else F.lit("ALL"))
    bounds = small(cuts.select(F.col("group").alias("__group"), F.col("low_cut").alias("__low"), F.col("high_cut").alias("__high")))
    return keyed.join(bounds, "__group").where(F.col(value).between(F.col("__low"), F.col("__high"))).select(*rows.columns)


def kept_runs(rows: DataFrame, order: str, kept: Column) -> DataFrame:
    """Runs of consecutive kept rows as half-open ranges of ``order`` (consecutive integers): first, end, rows.

    order - (number of kept rows up to it) is constant within a run; the numbering is a distributed prefix sum.
    """
    numbered = running_total(rows.where(kept).select(order), [order], name="__n")
    return numbered.groupBy((F.col(order) - F.col("__n")).alias("__island")).agg(F.min(order).alias("first"), (F.max(order) + 1).alias("end"), F.count("*").alias("rows")).drop("__island")


def seeded_order(rows: DataFrame, seed: int, identifier: str, name: str = "rank") -> DataFrame:
    """Add ``name``: the row's place, from 0, in a permutation that depends on seed and identifiers only."""
    hashed = rows.withColumn("__h", hash64(seed, F.col(identifier)))
    return running_total(hashed, ["__h", identifier], name=name).withColumn(name, F.col(name) - 1).drop("__h")


def split_of(rank: Column, splits: dict[str, tuple[int, int]]) -> Column:
    """Name of the split whose rank range [low, high) holds the rank; null outside all."""
    out = F.lit(None).cast("string")
    for name, (low, high) in splits.items():
        out = F.when((rank >= low) & (rank < high), name).otherwise(out)
    return out


def share_difference(rows: DataFrame, chosen: DataFrame, group: str, size: str) -> DataFrame:
    """Per group: share of the size in all rows and in the chosen ones (0 if none is chosen), and their difference."""
    shares = lambda df, name: df.groupBy(group).agg(F.sum(size).alias(name)).withColumn(name, F.try_divide(name, F.sum(name).over(Window.partitionBy())))
    joined = shares(rows, "pool_share").join(shares(chosen, "chosen_share"), group, "left").fillna(0.0, ["chosen_share"])
    return joined.withColumn("difference", F.col("chosen_share") - F.col("pool_share"))


def extremes(rows: DataFrame, group: str, value: str, identifier: str, k: int = 10) -> DataFrame:
    """The k lowest and k highest rows of each group; Spark keeps k rows per task before it shuffles."""
    low = Window.partitionBy(group).orderBy(F.col(value).asc(), F.col(identifier).asc())
    high = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(identifier).desc())
    place = lambda w, name: rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("end", F.lit(name))
    return place(low, "lowest").unionByName(place(high, "highest"))
