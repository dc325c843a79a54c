"""Statistics of a corpus and of selections: weighted percentiles, cells, distances between distributions, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import PERCENTILES, digitize
from ..functions.hashing import uniform
from ..runtime import small
from .prefix import running_total


def weighted_average(value: Column, weight: Column) -> Column:
    """Sum of value x weight over the sum of the weights, of the rows that have both."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def weighted_percentiles(rows: DataFrame, group: str, value: str, weights: dict[str, Column], points: Sequence[int] = PERCENTILES) -> DataFrame:
    """Per group and in all (``ALL``), for each weighting: the smallest value at which the cumulative share of the weight
    reaches the percentile.

    Rows are first summed by (group, value), so equal values are one row. The cumulative weights are distributed prefix sums, so
    a group of any size is spread over as many ranges as it needs.
    """
    both = rows.select(F.col(group).alias("group"), F.col(value).cast("double").alias("x"), *[w.cast("double").alias(f"w_{n}") for n, w in weights.items()]).where("x is not null")
    everything = both.withColumn("group", F.explode(F.array(F.col("group"), F.lit("ALL"))))
    summed = everything.groupBy("group", "x").agg(*[F.sum(f"w_{n}").alias(f"w_{n}") for n in weights])
    stacked = summed.select("group", "x", F.inline(F.array(*[F.struct(F.lit(n).alias("weight"), F.col(f"w_{n}").alias("w")) for n in weights])))
    whole = small(stacked.groupBy(F.col("group").alias("__g"), F.col("weight").alias("__w")).agg(F.sum("w").alias("whole")))
    running = running_total(stacked, ["x"], F.col("w"), ["group", "weight"])
    joined = running.join(whole, F.col("group").eqNullSafe(F.col("__g")) & (F.col("weight") == F.col("__w")))
    cumulative = joined.withColumn("share", F.try_divide("cum", "whole"))
    reached = [F.min(F.when(F.col("share") >= F.lit(q / 100 - 1e-12), F.col("x"))).alias(f"p{q}") for q in points]
    return cumulative.groupBy("group", "weight").agg(*reached)


def cell_totals(rows: DataFrame, cells: Sequence[str], size: str) -> DataFrame:
    """Rows and size of each cell."""
    return rows.groupBy(*cells).agg(F.count("*").alias("docs"), F.coalesce(F.sum(size), F.lit(0)).alias("size"))


def dense_cells(totals: DataFrame, names: DataFrame, bins: int, name: str, column: str) -> DataFrame:
    """``totals`` with a row for every (name, bin), zeros where there is none; names and bins are small catalogs."""
    grid = names.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(totals, [name, column], "left").fillna(0)


def compare_cells(population: DataFrame, selection: DataFrame, cells: Sequence[str], size: str) -> DataFrame:
    """Per cell: rows and shares of the size in the population and in the selection; one aggregation over both."""
    both = population.select(*cells, F.lit(1).alias("p"), F.lit(0).alias("s"), F.col(size).alias("v")).unionByName(selection.select(*cells, F.lit(0).alias("p"), F.lit(1).alias("s"), F.col(size).alias("v")))
    totals = both.groupBy(*cells).agg(
        F.sum("p").alias("population_docs"), F.sum("s").alias("selection_docs"),
        F.coalesce(F.sum(F.when(F.col("p") == 1, F.col("v"))), F.lit(0)).alias("population_size"), F.coalesce(F.sum(F.when(F.col("s") == 1, F.col("v"))), F.lit(0)).alias("selection_size"),
    )
    whole = Window.partitionBy()  # over cells, a catalog
    return totals.withColumns({"p": F.try_divide("population_size", F.sum("population_size").over(whole)), "q": F.try_divide("selection_size", F.sum("selection_size").over(whole))})


def variation_distance(compared: DataFrame, factor: str | None = None) -> DataFrame:
    """Half the sum of |q - p|, over cells or over the values of one factor."""
    base = compared.groupBy(factor).agg(F.sum("p").alias("p"), F.sum("q").alias("q")) if factor else compared
    return base.agg((0.5 * F.sum(F.abs(F.coalesce("q", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))))).alias("distance"))


def cell_fit(compared: DataFrame, fraction: float, least: int = 1000) -> DataFrame:
    """One row over the cells of at least ``least`` population rows: cells, cells beyond 3 deviations, greatest |z|, chi2/dof."""
    expected = F.col("population_docs") * F.lit(fraction)
    z = (F.col("selection_docs") - expected) / F.sqrt(F.greatest(expected * F.lit(1 - fraction), F.lit(1e-9)))
    big = compared.where(F.col("population_docs") >= least).withColumn("z", z)
    return big.agg(F.count("*").alias("cells"), F.count_if(F.abs("z") > 3).alias("beyond_3"), F.max(F.abs("z")).alias("max_z"), F.try_divide(F.sum(F.col("z") * F.col("z")), F.count("*")).alias("chi2_dof"))


def distance_by_chance(compared: DataFrame, fraction: float, cells: Sequence[str], draws: int = 20, seed: int = 0) -> DataFrame:
    """Distance that sampling alone gives: mean and deviation over ``draws`` binomial resamples (normal approximation with
    hashed uniforms, rounded to whole rows) of the cells, with each cell's size per row."""
    key = F.xxhash64(*cells, "draw")
    u1, u2 = uniform(seed, key), uniform(seed + 1, key)
    normal = F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
    n, f = F.col("population_docs"), F.lit(fraction)
    drawn = F.greatest(F.lit(0.0), F.least(n.cast("double"), F.round(n * f + normal * F.sqrt(n * f * (1 - f)))))
    per_row = F.coalesce(F.try_divide(F.col("selection_size"), F.col("selection_docs")), F.try_divide(F.col("population_size"), n), F.lit(0.0))
    draws_of = compared.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("v", drawn * per_row)
    shares = draws_of.withColumn("q", F.try_divide("v", F.sum("v").over(Window.partitionBy("draw"))))
    each = shares.groupBy("draw").agg((0.5 * F.sum(F.abs(F.coalesce("q", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))))).alias("d"))
    return each.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"))


def length_bin(size: Column, edges: Sequence[float]) -> Column:
    return digitize(size, edges)


def ratio_calibration(rows: DataFrame, group: str, tokens: str, chars: str) -> DataFrame:
    """Tokens per character of each group; groups without characters get the ratio of all rows."""
    grouped = rows.groupBy(group).agg(F.sum(tokens).alias("__t"), F.sum(chars).alias("__c"))
    whole = Window.partitionBy()  # one row per group
    return grouped.select(group, F.coalesce(F.try_divide("__t", "__c"), F.try_divide(F.sum("__t").over(whole), F.sum("__c").over(whole))).alias("tokens_per_char"))


def every_nth_file(files: DataFrame, directory: str, path: str, every: int) -> DataFrame:
    """Every n-th file of each directory in path order, and how many rows of the directory each sampled row stands for."""
    ordered = Window.partitionBy(directory).orderBy(path)
    return files.withColumn("__rn", F.row_number().over(ordered)).where((F.col("__rn") - 1) % every == 0).drop("__rn")


def scaled_totals(sampled: DataFrame, full: DataFrame, directory: str, docs: str, size: str) -> DataFrame:
    """Per directory: sampled rows, all rows, weight = all / sampled, and the size scaled to all rows."""
    joined = sampled.groupBy(directory).agg(F.sum(docs).alias("sampled_docs"), F.sum(size).alias("sampled_size")).join(full.groupBy(directory).agg(F.sum(docs).alias("all_docs")), directory)
    weight = F.try_divide("all_docs", "sampled_docs")
    return joined.withColumns({"weight": weight, "scaled_size": weight * F.col("sampled_size")})


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, group: str | None = None) -> DataFrame:
    """Counts of ``bins`` equal bins on [low, high], the last one closed; values outside are left out."""
    x = F.col(value).cast("double")
    place = F.least(F.floor((x - low) * F.lit(bins) / F.lit(high - low)), F.lit(bins - 1)).cast("int")
    inside = rows.where(x.between(low, high))
    return inside.groupBy(*([group] if group else []), place.alias("bin")).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Per group: rows and size, and their shares."""
    whole = Window.partitionBy()  # one row per group
    totals = rows.groupBy(group).agg(F.count("*").alias("docs"), F.sum(size).alias("size"))
    return totals.withColumns({"docs_share": F.try_divide(F.col("docs"), F.sum("docs").over(whole)), "size_share": F.try_divide(F.col("size"), F.sum("size").over(whole))})


def bootstrap_ratio(rows: DataFrame, identifier: str, bucket: str, difference: str, count: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per bucket: sum(difference) / sum(count), and the 2.5th and 97.5th percentile over ``draws`` bootstrap samples of the
    identifiers.

    Each identifier has a Poisson(1) weight per draw, from a hash, the same in every bucket. Every row gives its weighted
    values as one array over the draws; the arrays are summed map-side, so the shuffle has draws x buckets numbers per task,
    not draws x rows.
    """
    import pandas as pd

    slim = rows.select(F.col(identifier).alias("i"), F.col(bucket).alias("b"), F.col(difference).cast("double").alias("d"), F.col(count).cast("double").alias("c")).where("i is not null")

    def draw(batches):
        import numpy as np

        sums: dict = {}
        for batch in batches:
            for b, part in batch.groupby("b", dropna=False):
                for start in range(0, len(part), 4096):
                    piece = part.iloc[start : start + 4096]
                    with np.errstate(over="ignore"):
                        z = piece["i"].to_numpy(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(draws, dtype=np.uint64) + np.uint64(seed * draws))[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
                        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
                    weights = np.searchsorted(np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]), u)
                    d, c = piece["d"].fillna(0).to_numpy(), piece["c"].fillna(0).to_numpy()
                    have = sums.setdefault(b, np.zeros((2, draws + 1)))
                    have[0, 0] += d.sum()
                    have[1, 0] += c.sum()
                    have[0, 1:] += d @ weights
                    have[1, 1:] += c @ weights
        rows_out = [(b, k, v[0, k], v[1, k]) for b, v in sums.items() for k in range(draws + 1)]
        yield pd.DataFrame(rows_out, columns=["b", "draw", "d", "c"])

    kind = slim.schema["b"].dataType.simpleString()
    parts = slim.mapInPandas(draw, f"b {kind}, draw int, d double, c double").groupBy("b", "draw").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    ratio = F.try_divide("d", F.greatest(F.col("c"), F.lit(1.0)))
    drawn = parts.withColumn("r", ratio)
    at = lambda q: F.percentile(F.when(F.col("draw") > 0, F.col("r")), q)
    return drawn.groupBy(F.col("b").alias(bucket)).agg(F.max(F.when(F.col("draw") == 0, F.col("r"))).alias("ratio"), at(0.025).alias("low"), at(0.975).alias("high"))


def paired_delta(model: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: pairs, mean difference, standard error, z of a value over the rows that both have."""
    both = model.select(*keys, F.col(value).alias("m")).join(reference.select(*keys, F.col(value).alias("r")), list(keys))
    d = both.withColumn("d", F.col("m") - F.col("r")).where("d is not null").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"))
    error = F.when(F.col("n") >= 2, F.col("sd") / F.sqrt("n"))
    return d.select("n", "delta", error.alias("stderr"), F.try_divide("delta", F.nullif(error, F.lit(0.0))).alias("z"))


def largest(groups: DataFrame, group: str, size: str, k: int = 25) -> DataFrame:
    """The k groups of the greatest size, in that order (ties by name)."""
    return groups.orderBy(F.col(size).desc(), F.col(group)).limit(k)


def document_buckets(rows: DataFrame, document: str, bucket: str, count: str, losses: Sequence[str]) -> DataFrame:
    """document x bucket: predictions and the sum of each loss; the table that breakdowns and their intervals rest on."""
    return rows.groupBy(document, bucket).agg(F.sum(count).alias(count), *[F.sum(c).alias(c) for c in losses])


def loss_breakdown(buckets: DataFrame, bucket: str, count: str, base: str, others: Sequence[str] = (), min_share: float = 0.0) -> DataFrame:
    """Per bucket: predictions, their share, the base's mean loss, and each other model's difference to it (``delta_<name>``).

    Buckets with fewer predictions than 1 or ``min_share`` of all are left out; the shares are of all predictions.
    """
    totals = buckets.groupBy(bucket).agg(F.sum(count).alias("predictions"), *[F.sum(c).alias(c) for c in (base, *others)])
    all_of = F.sum("predictions").over(Window.partitionBy())  # one row per bucket
    shown = totals.withColumn("__all", all_of).where(F.col("predictions") >= F.greatest(F.lit(1.0), F.lit(float(min_share)) * F.col("__all")))
    mean = lambda c: F.try_divide(F.col(c), F.col("predictions"))
    return shown.select(bucket, "predictions", (F.col("predictions") / F.col("__all")).alias("share"), mean(base).alias("loss"), *[(mean(c) - mean(base)).alias(f"delta_{c}") for c in others])
