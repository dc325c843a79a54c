"""Scaling fits by grid search in plain DataFrame algebra, decision rules, and matrix ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMS = ("power", "exp")


def _basis(form: str, d: str, k: str):
    return F.pow(F.col(d), -F.col(k)) if form == "power" else F.exp(-F.col(d) / F.col(k))


def scaling_fit(points: DataFrame, form: str, group: str = "run", x: str = "tokens", y: str = "loss", low: float = 0.05, high: float | None = None, steps: int = 4000) -> DataFrame:
    """Per group: the curve l + a f(x; k) of least squares, with f = x^-k (power) or exp(-x / k) (exp), l >= 0 and a > 0.

    For each k of the grid the best l and a are linear: they follow from the sums of f, f^2, y and f y; the least error wins
    (ties: the smallest k). Result: group, l, a, k, sse, rmse, n. A group without admissible fit has no row.
    """
    top = high if high is not None else (5.0 if form == "power" else 10.0)
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(low) + i * F.lit((top - low) / (steps - 1)))
    each = points.select(group, F.col(x).alias("x"), F.col(y).alias("y"), F.explode(grid).alias("k"))
    f = _basis(form, "x", "k")
    sums = each.groupBy(group, "k").agg(F.count("*").alias("n"), F.sum(f).alias("sf"), F.sum(f * f).alias("sff"), F.sum("y").alias("sy"), F.sum(f * F.col("y")).alias("sfy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    a = F.try_divide(F.col("n") * F.col("sfy") - F.col("sf") * F.col("sy"), F.col("n") * F.col("sff") - F.col("sf") * F.col("sf"))
    solved = sums.withColumn("a", a).withColumn("l", (F.col("sy") - F.col("a") * F.col("sf")) / F.col("n")).where("l >= 0 and a > 0")
    error = F.col("syy") - F.col("l") * F.col("sy") - F.col("a") * F.col("sfy")
    best = solved.withColumn("sse", F.greatest(error, F.lit(0.0))).groupBy(group).agg(F.min(F.struct("sse", "k", "l", "a", "n")).alias("b"))
    return best.select(group, "b.l", "b.a", "b.k", "b.sse", F.sqrt(F.col("b.sse") / F.col("b.n")).alias("rmse"), "b.n")


def predict(fits: DataFrame, form: str, at: list[float]) -> DataFrame:
    """Fitted values at given x: (fit columns, x, predicted)."""
    rows = fits.withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in at])))
    return rows.withColumn("predicted", F.col("l") + F.col("a") * _basis(form, "x", "k"))


def wins(results: DataFrame, group: str, loss: str, base_mean: float, base_std: float) -> DataFrame:
    """Mean loss per group, and whether it beats the base by more than two deviations."""
    return results.groupBy(group).agg(F.avg(loss).alias("mean")).withColumn("win", F.col("mean") < F.lit(base_mean - 2 * base_std))


def matrix_ranks(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Per group, the matrix of its row vectors: stable rank sum(s^2) / max(s)^2, and the effective rank exp(entropy) as a share
    of the smaller dimension, once with p ~ s and once with p ~ s^2.

    Only the Gram matrix (columns x columns) of each group is needed; it is summed over Arrow batches and then merged, so
    the number of rows of a group doesn't matter. Vectors of a group must have one length; null vectors are left out.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema[group], T.StructField("n", T.LongType()), T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def grams(batches):
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby(group, dropna=False):
                x = np.stack(part[vector].to_list()).astype(float)
                n, g = sums.get(key, (0, 0.0))
                sums[key] = (n + len(x), g + x.T @ x)
        yield pd.DataFrame([(k, n, g.ravel()) for k, (n, g) in sums.items()], columns=[group, "n", "gram"])

    parts = rows.where(F.col(vector).isNotNull()).select(group, vector).mapInPandas(grams, schema)
    out = T.StructType([rows.schema[group], *[T.StructField(c, T.DoubleType()) for c in ("stable_rank", "effective_rank", "effective_rank_sq")]])

    def spectrum(key, part):
        gram = sum(np.asarray(g) for g in part["gram"])
        width = int(round(len(gram) ** 0.5))
        s2 = np.clip(np.linalg.eigvalsh(gram.reshape(width, width)), 0, None)
        s = np.sqrt(s2)
        least = min(width, int(part["n"].sum()))

        def share(w):
            p = w / w.sum() if w.sum() > 0 else w
            return float(np.exp(-(p * np.log(np.clip(p, 1e-30, None))).sum()) / least)

        stable = float(s2.sum() / s2.max()) if s2.max() > 0 else 0.0
        return pd.DataFrame([(*key, stable, share(s), share(s2))], columns=[group, "stable_rank", "effective_rank", "effective_rank_sq"])

    return parts.groupBy(group).applyInPandas(spectrum, out)
