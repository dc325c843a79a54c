"""Exact prefix sums over a global order, without one task that sees a whole group.

``sum() over (partition by g order by k)`` puts a group, or without ``partition by`` the whole table, into one task. Here the
rows are range-partitioned by (group, key), so that a group of any size spreads over many tasks, the totals of each (group,
partition) give every partition its offset, and only the rows of one partition are ever summed in order. The ranged rows
are written to the shared folder once, since both passes must see the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, partitions, small


def ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in ranges of (group, order), written once, with the number ``__part`` of each row's range."""
    spread = df.repartitionByRange(partitions(df.sparkSession), *group, *order)
    return materialize(spread.withColumn("__part", F.spark_partition_id()), "ranged")


def _offsets(ranged: DataFrame, group: Sequence[str], weight: Column) -> DataFrame:
    """(group, __part) -> sum of the weights in earlier partitions, and in this one. At most groups x partitions rows."""
    totals = ranged.groupBy(*group, "__part").agg(F.sum(weight).alias("__here"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum("__here").over(before), F.lit(0)))


def running_total(df: DataFrame, order: Sequence[str], weight: Column | None = None, group: Sequence[str] = (), name: str = "cum") -> DataFrame:
    """Add ``name``: the inclusive running total of ``weight`` (1 by default) within ``group``, by ``order`` ascending.

    ``order`` must end in a column that makes it unique, else equal rows are ordered arbitrarily. Null weights count as 0,
    null keys come first, an empty table stays empty; a column ``name`` of ``df`` is replaced.
    """
    amount = F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0))
    ranged = ranges(df.withColumn("__w", amount), group, order)
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__local", F.sum("__w").over(inside))
    keys = [*group, "__part"]
    offsets = _offsets(ranged, group, F.col("__w"))
    same = [local[k].eqNullSafe(offsets[k]) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = local.join(offsets, condition)  # at most groups x partitions offsets: small, but joined by whatever AQE finds best
    return joined.select(*[local[c] for c in df.columns if c != name], (F.col("__local") + F.col("__before")).alias(name))


def cut_rows(df: DataFrame, targets: DataFrame, order: Sequence[str], weight: Column | None = None, group: Sequence[str] = (), reach: bool = True) -> DataFrame:
    """The row of each group at which the running total, by ``order`` ascending, meets the group's ``target``.

    ``reach``: the first row whose total is at least the target (so the row that crosses it belongs to the prefix);
    otherwise the last row whose total does not exceed it. ``targets`` has the columns ``group`` and ``target``, one row per
    group. Result: group, ``target``, the order columns, ``total`` (running total at that row); no row for a group whose
    prefix is empty or whose total stays below a target to reach.
    """
    amount = F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0))
    slim = df.select(*group, *order, amount.alias("__w"))
    ranged = ranges(slim, group, order)
    offsets = _offsets(ranged, group, F.col("__w"))
    offsets = offsets.join(targets, list(group)) if group else offsets.withColumn("target", targets.select("target").scalar())
    total = F.col("__before") + F.col("__here")
    if reach:
        hit = offsets.where((F.col("__before") < F.col("target")) & (total >= F.col("target")))
    else:  # the partition of the last row within the target: the last one that starts within it
        last = Window.partitionBy(*group).orderBy(F.col("__part").desc())
        hit = offsets.where((F.col("__before") <= F.col("target")) & (F.col("__here").isNotNull()))
        hit = hit.withColumn("__rn", F.row_number().over(last)).where("__rn <= 2").drop("__rn")
    few = hit.select(*group, "__part", "__before", "target")
    rows = ranged.join(small(few), [*group, "__part"])  # one or two rows per group
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum("__w").over(inside) + F.col("__before"))
    key = F.struct(*order)
    if reach:
        rows = rows.where(F.col("total") >= F.col("target"))
        best = F.min(F.struct(key.alias("k"), "total", "target"))
    else:
        rows = rows.where(F.col("total") <= F.col("target"))
        best = F.max(F.struct(key.alias("k"), "total", "target"))
    return rows.groupBy(*group).agg(best.alias("b")).select(*group, "b.target", *[F.col(f"b.k.{c}").alias(c) for c in order], "b.total")


def up_to(df: DataFrame, cuts: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` that do not come after their group's row in ``cuts`` (one row per group, from ``cut_rows``)."""
    bounds = cuts.select(*group, F.struct(*order).alias("__cut"))
    if not group:
        return df.where(F.struct(*order) <= bounds.scalar())
    return df.join(small(bounds), list(group)).where(F.struct(*order) <= F.col("__cut")).drop("__cut")


def rows_at(df: DataFrame, positions: DataFrame, order: Sequence[str], group: Sequence[str]) -> DataFrame:
    """The rows at given 1-based positions within their group, by ``order`` ascending: group, ``position``, order columns.

    ``positions`` has the columns ``group`` and ``position``, a few rows per group. Only the ranges that hold one of them
    are numbered row by row.
    """
    ranged = ranges(df.select(*group, *order), group, order)
    offsets = _offsets(ranged, group, F.lit(1).cast("long"))
    wanted = small(positions.select(*group, "position").distinct())
    hit = offsets.join(wanted, list(group)).where((F.col("__before") < F.col("position")) & (F.col("position") <= F.col("__before") + F.col("__here")))
    parts = small(hit.select(*group, "__part", "__before").distinct())
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    numbered = ranged.join(parts, [*group, "__part"]).withColumn("position", (F.row_number().over(inside) + F.col("__before")).cast("long"))
    return numbered.join(wanted, [*group, "position"]).select(*group, "position", *order)


IN_ONE_TASK = 100_000


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], group: str | Sequence[str]) -> DataFrame:
    """group, ``q``, ``quantile``: exact quantiles with linear interpolation, of groups of any size; null values are left out, a
    null in the group's columns is a value like any other.

    The two neighbours of each quantile are looked up by position, instead of holding a group's values in one aggregation;
    that is done only where the greatest group has at most IN_ONE_TASK values, by count.
    """
    names = [group] if isinstance(group, str) else list(group)
    clean = df.where(F.col(value).isNotNull()).select(F.struct(*names).alias("__group"), F.col(value).cast("double").alias("__x"))
    group = "__group"  # a struct is equal to another if their nulls are in the same places
    sizes = clean.groupBy(group).agg(F.count("*").alias("__n"))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= IN_ONE_TASK:  # the same result, by one aggregation
        each = clean.groupBy(group).agg(F.percentile("__x", F.array(*[F.lit(float(q)) for q in quantiles])).alias("__q"))
        pairs = F.inline(F.arrays_zip(F.array(*[F.lit(float(q)) for q in quantiles]).alias("q"), F.col("__q").alias("quantile")))
        return each.select(*[F.col(f"__group.`{n}`").alias(n) for n in names], pairs)
    points = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("__h", F.col("q") * (F.col("__n") - 1))
    low = F.floor("__h").cast("long")
    points = points.withColumns({"__lo": low + 1, "__hi": F.least(low + 2, F.col("__n")), "__f": F.col("__h") - low})
    places = points.select(group, F.explode(F.array("__lo", "__hi")).alias("position"))
    found = rows_at(clean, places, ["__x"], [group])
    at = lambda side: found.select(group, F.col("position").alias(side), F.col("__x").alias(f"{side}_x"))
    joined = points.join(at("__lo"), [group, "__lo"]).join(at("__hi"), [group, "__hi"])
    return joined.select(*[F.col(f"__group.`{n}`").alias(n) for n in names], "q", (F.col("__lo_x") + F.col("__f") * (F.col("__hi_x") - F.col("__lo_x"))).alias("quantile"))
