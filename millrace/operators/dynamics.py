"""Training-log analytics: long metric tables, medians by stage, phases, noise scale, norms of parameter groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stage
from .prefix import exact_quantiles, ranges

# The metrics of the phase tables.
PHASE_METRICS = ["grad_cos_prev", "overshoot_norm", "overshoot", "upd_grad_align", "D1>0", "upd_rel", "upd_row_cv", "upd_erank_frac", "delta_erank_frac", "w_srank"]


def long_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines with keys ``global/<metric>``, ``type/<t>/<metric>``, ``layer/<n>/<t>/<metric>``, ``lr/<group>`` ->
    (step, scope, layer, type, metric, value). Null values, ``step`` and ``time`` are left out; a broken line gives nothing."""
    parsed = lines.select(F.from_json(value, "map<string,double>").alias("m")).where("m is not null")
    each = parsed.select(F.get(F.filter(F.map_values(F.map_filter("m", lambda k, v: k == "step")), lambda v: v.isNotNull()), F.lit(0)).cast("long").alias("step"), F.explode("m").alias("key", "value"))
    part = F.split("key", "/")
    scope = F.get(part, F.lit(0))
    return each.where("value is not null and key not in ('step', 'time')").select(
        "step", scope.alias("scope"),
        F.when(scope == "layer", F.get(part, F.lit(1)).cast("int")).alias("layer"),
        F.when(scope == "type", F.get(part, F.lit(1))).when(scope == "layer", F.get(part, F.lit(2))).alias("type"),
        F.element_at(part, -1).alias("metric"), "value",
    )


def with_block(metrics: DataFrame) -> DataFrame:
    """Rows of whole-model and per-type scope, with ``block``: ``global`` or the type."""
    return metrics.where(F.col("scope").isin("type", "global")).withColumn("block", F.when(F.col("scope") == "global", "global").otherwise(F.col("type")))


def stage_medians(metrics: DataFrame, max_steps: int, runs: str | None = None, warmup: float = 0.02, decay: float = 0.1) -> DataFrame:
    """Median of each metric and block in each stage (columns warmup, stable, decay), per run if there is a run column."""
    keys = [*([runs] if runs else []), "metric", "block"]
    staged = metrics.withColumn("stage", stage(F.col("step"), max_steps, warmup, decay))
    found = exact_quantiles(staged, "value", [0.5], [*keys, "stage"])
    # the stages are known, so no pivot needs to collect them
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("stage") == s, F.col("quantile"))).alias(s) for s in ("warmup", "stable", "decay")])


def wide_metrics(metrics: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A column per metric (mean of repeated measurements)."""
    return metrics.groupBy(*keys).agg(*[F.avg(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def phases(metrics: DataFrame, windows: dict[str, tuple[int, int]], names: Sequence[str], runs: str | None = None) -> DataFrame:
    """(run, block, window, metric, value): medians over step windows; overshoot = D1 / grad_norm, overshoot_norm divided by
    the alignment, and ``D1>0``, the share of measurements with a positive D1."""
    keys = [*([runs] if runs else []), "block", "step"]
    wide = wide_metrics(metrics, list(dict.fromkeys([*names, "D1", "grad_norm", "upd_grad_align"])), keys)
    over = F.try_divide("D1", "grad_norm")
    wide = wide.withColumns({"overshoot": over, "overshoot_norm": F.try_divide(over, F.col("upd_grad_align")), "D1>0": F.when(F.col("D1").isNotNull(), (F.col("D1") > 0).cast("double"))})
    spans = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in windows.items()])
    placed = wide.withColumn("w", F.explode(F.filter(spans, lambda s: (s["lo"] <= F.col("step")) & (s["hi"] >= F.col("step")))))
    wanted = list(dict.fromkeys([*names, "overshoot", "overshoot_norm", "D1>0"]))
    stacked = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in wanted]))
    long = placed.select(*keys[:-1], F.col("w.window").alias("window"), stacked).where("value is not null")
    group = [*keys[:-1], "window", "metric"]
    shares = long.where("metric = 'D1>0'").groupBy(*group).agg(F.avg("value").alias("value"))
    return exact_quantiles(long.where("metric <> 'D1>0'"), "value", [0.5], group).select(*group, F.col("quantile").alias("value")).unionByName(shares)


def baseline_deltas(values: DataFrame, run: str, baseline: str, keys: Sequence[str]) -> DataFrame:
    """Add ``delta``: value minus the baseline run's value of the same keys; null where the baseline has none."""
    base = values.where(F.col(run) == baseline).select(*keys, F.col("value").alias("__base"))
    return values.join(base, list(keys), "left").withColumn("delta", F.col("value") - F.col("__base")).drop("__base")


def final_and_before(evals: DataFrame, run: str, step: str, loss: str, decay_start: int) -> DataFrame:
    """Per run: final loss, the last one at or before the start of the decay (and its step), the gain of the decay."""
    before = F.col(step) <= decay_start
    out = evals.groupBy(run).agg(F.max_by(loss, step).alias("final"), F.max_by(F.when(before, F.col(loss)), F.when(before, F.col(step))).alias("before"), F.max(F.when(before, F.col(step))).alias("before_step"))
    return out.withColumn("gain", F.col("before") - F.col("final"))


def noise_scale(metrics: DataFrame, window: int = 500, tolerance: float = 0.3, keys: Sequence[str] = ("block",)) -> DataFrame:
    """Per block and step window: measurements, mean(trS) / mean(G2) in all and in each half, whether the halves agree.

    The ratio is of means, never the mean of ratios; windows with fewer than two measurements are left out, and a mean of G2
    that is not positive gives null.
    """
    wide = wide_metrics(metrics, ["gns_trS", "gns_G2"], [*keys, "step"]).where("gns_trS is not null and gns_G2 is not null")
    placed = wide.withColumn("window_end", F.expr(f"((step + {window - 1}) div {window}) * {window}"))
    group = [*keys, "window_end"]
    ordered = placed.withColumns({"rn": F.row_number().over(Window.partitionBy(*group).orderBy("step")), "n": F.count("*").over(Window.partitionBy(*group))}).where("n >= 2")
    first = F.col("rn") <= F.floor(F.col("n") / 2)

    def ratio(condition: Column | None) -> Column:
        pick = (lambda c: F.avg(F.when(condition, F.col(c)))) if condition is not None else F.avg
        g2 = pick("gns_G2")
        return F.when(g2 > 0, pick("gns_trS") / g2)

    out = ordered.groupBy(*group).agg(F.count("*").alias("n"), ratio(None).alias("noise"), ratio(first).alias("first_half"), ratio(~first).alias("second_half"))
    return out.withColumn("agree", F.coalesce(F.abs(F.col("first_half") - F.col("second_half")) <= tolerance * (F.col("first_half") + F.col("second_half")) / 2, F.lit(False)))


def noise_groups(pairs: DataFrame, type_: str = "type") -> DataFrame:
    """Sums of squared norms (gg1, gg2) and products (g12) of two gradients -> G2, trS = b ((gg1 + gg2) / 2 - g12), B = trS / G2,
    for the whole and per type; ``b`` is the batch of each gradient."""
    rolled = pairs.rollup(type_).agg(F.sum("gg1").alias("gg1"), F.sum("gg2").alias("gg2"), F.sum("g12").alias("G2"), F.max("b").alias("b"), F.grouping(type_).alias("__all"))
    trs = F.col("b") * ((F.col("gg1") + F.col("gg2")) / 2 - F.col("G2"))
    return rolled.select(F.when(F.col("__all") == 1, "global").otherwise(F.col(type_)).alias("block"), "G2", trs.alias("trS"), F.when(F.col("G2") > 0, trs / F.col("G2")).alias("B"))


def group_norms(tensors: DataFrame) -> DataFrame:
    """Per-tensor sums (gg_a, gg_b, g_ab, ww, vv_a, vv_b, v_ab, ga_va, gb_va, n) and maxima (gmax_b, vmax_a) -> norms and
    cosines of the whole model, of each type, and of each layer and type (layers below 0 have no layer group)."""
    sums = ["gg_a", "gg_b", "g_ab", "ww", "vv_a", "vv_b", "v_ab", "ga_va", "gb_va", "n"]
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in ("gmax_b", "vmax_a")]
    scope = F.when(F.grouping("layer") == 0, "layer").when(F.grouping("type") == 0, "type").otherwise("global")
    sets = tensors.groupingSets([[], [F.col("type")], [F.col("layer"), F.col("type")]], F.col("layer"), F.col("type")).agg(scope.alias("scope"), *aggs)
    every = sets.where("scope <> 'layer' or layer >= 0").withColumn("layer", F.col("layer").cast("int"))
    div = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    d1 = div(c("gb_va"), F.sqrt("vv_a"))
    d2 = div(c("gb_va") - c("ga_va"), c("vv_a"))
    return every.select(
        "scope", "layer", "type", F.sqrt("gg_b").alias("grad_norm"), c("gmax_b").alias("grad_max"), div(c("g_ab"), F.sqrt(c("gg_a") * c("gg_b"))).alias("grad_cos_prev"),
        F.sqrt("ww").alias("w_norm"), F.sqrt("vv_a").alias("upd_norm"), F.sqrt(div(c("vv_a"), c("n"))).alias("upd_rms"), F.sqrt(div(c("vv_a"), c("ww"))).alias("upd_rel"),
        c("vmax_a").alias("upd_max"), div(c("v_ab"), F.sqrt(c("vv_a") * c("vv_b"))).alias("upd_cos_prev"), div(-c("ga_va"), F.sqrt(c("gg_a") * c("vv_a"))).alias("upd_grad_align"),
        d1.alias("D1"), d2.alias("dir_sharpness"), (F.abs(d2) / F.pow(1 + d1 * d1, 1.5)).alias("curvature_K"),
    )


def layer_heatmap(metrics: DataFrame, metric: str, type_: str, steps: Sequence[int]) -> DataFrame:
    """Layer x step: the mean value, a column per step."""
    rows = metrics.where((F.col("scope") == "layer") & (F.col("metric") == metric) & (F.col("type") == type_))
    return rows.groupBy("layer").pivot("step", list(steps)).agg(F.avg("value"))


def rolling_mean(rows: DataFrame, group: str, order: Sequence[str], value: str, k: int) -> DataFrame:
    """Add ``rolling``: mean of the last k values, of fewer at the head."""
    return rows.withColumn("rolling", F.avg(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(-(k - 1), 0)))


def lagged(rows: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """Add the previous measurement and the change since then."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumns({"previous": before, "change": F.col(value) - before})


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Left rows with the right side's last ``value`` at or before ``on`` (backward as-of join), per group.

    Both sides are one stream in ranges of (group, on), in which the last known value is carried forward: within each range,
    and from range to range by one row each, so a group may be of any size. Right rows come before left rows of the same key;
    of right rows of equal key the greatest value counts. Null right values are skipped; a left row before all right rows
    gets null. A column ``value`` of the left side is replaced.
    """
    kept = [c for c in left.columns if c != value]
    kind = right.schema[value].dataType
    stream = left.select(*kept).withColumns({"__v": F.lit(None).cast(kind), "__side": F.lit(1)}).unionByName(
        right.where(F.col(value).isNotNull()).select(*group, on, F.col(value).alias("__v")).withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    order = [on, "__side", "__v"]
    ranged = ranges(stream, group, order)
    keys = [*group, "__part"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__here", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    ends = ranged.groupBy(*keys).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__last"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier))  # a row per group and range
    carried = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before")
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        same = one if same is None else same & one
    return local.join(carried, same, "left").select(*kept, F.coalesce("__here", "__before").alias(value))


def step_times(log: DataFrame, step: str, seconds: str, tokens: str, skip: int = 5) -> DataFrame:
    """One row: median and mean step time after the first ``skip`` steps, tokens per second."""
    rows = log.where(F.col(step) > skip)
    middle = exact_quantiles(rows.withColumn("__all", F.lit(0)), seconds, [0.5], "__all").select("quantile")
    return rows.agg(F.avg(seconds).alias("mean_s"), F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_s")).select(middle.scalar().alias("median_s"), "mean_s", "tokens_per_s")


def parameter_table(parameters: DataFrame) -> DataFrame:
    """Parameters by block type: tensors and numbers."""
    from ..functions.exprs import block_type, layer_of

    typed = parameters.select(block_type(F.col("name"), F.col("dimensions")).alias("type"), layer_of(F.col("name")).alias("layer"), "numbers")
    return typed.groupBy("type").agg(F.count("*").alias("tensors"), F.sum("numbers").alias("numbers"), F.countDistinct("layer").alias("layers"))


def interpolated(rows: DataFrame, group: str, x: str, y: str, at: float) -> DataFrame:
    """Per group: y at ``at``, linear between the nearest measurements; a measured point is taken as it is, and outside the
    measured range the result is null. Ties in x: the mean of y."""
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, x).agg(F.avg(y).alias("__y"))
    below, above = F.col(x) <= at, F.col(x) >= at
    ends = points.groupBy(group).agg(
        F.max(F.when(below, F.col(x))).cast("double").alias("x0"), F.max_by(F.when(below, F.col("__y")), F.when(below, F.col(x))).alias("y0"),
        F.min(F.when(above, F.col(x))).cast("double").alias("x1"), F.min_by(F.when(above, F.col("__y")), F.when(above, F.col(x))).alias("y1"),
    )
    between = F.col("y0") + (F.lit(float(at)) - F.col("x0")) * F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return ends.select(group, F.when(F.col("x0") == F.col("x1"), F.col("y0")).otherwise(between).alias("value"))


def loss_curves(history: DataFrame, run: str, tokens: str, loss: str, k: int = 5) -> DataFrame:
    """Per run, by tokens: the loss, its rolling mean over the last k points, and the perplexity of that mean."""
    smooth = rolling_mean(history.where(F.col(loss).isNotNull()), run, [tokens], loss, k)
    return smooth.select(run, tokens, loss, F.col("rolling").alias("smoothed"), F.exp("rolling").alias("perplexity"))
