"""Queries over experiment records: metric logs, benchmark questions, fits, schedules. The ``events`` table stands in for a
metric log (an event type per metric, the event id as step), ``lineitem`` for per-tensor sums, ``embeddings`` for answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.hashing import sql_hash64
from ..operators import dynamics, fits, stats
from ..runtime import table
from ..streaming import ingest
from . import schedule

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


NAMES = {"view": "D1", "click": "grad_norm", "purchase": "upd_grad_align", "signup": "gns_trS", "error": "gns_G2"}
STEPS = 2000


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """events as a metric log: run, step, scope, layer, type, block, metric, value."""
    name = F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col("event_type"))
    value = F.when(F.col("event_type") == "view", F.col("value") - 20).otherwise(F.col("value"))
    return table(spark, folder, "events").select(
        F.concat(F.lit("run"), F.col("user_id") % 2).alias("run"), (F.col("event_id") % STEPS).alias("step"), F.lit("type").alias("scope"), F.lit(None).cast("int").alias("layer"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("type"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("block"), name.alias("metric"), value.alias("value"),
    )


METRICS = f"""m as (select 'run' || (user_id % 2) as run, event_id % {STEPS} as step, 't' || (user_id % 3) as block, case event_type when 'view' then 'D1' when 'click' then 'grad_norm' when 'purchase' then 'upd_grad_align' when 'signup' then 'gns_trS' else 'gns_G2' end as metric,
 case when event_type = 'view' then value - 20 else value end as value from events)"""


@query(f"""with {METRICS}, s as (select *, case when step <= 40 then 'warmup' when step <= 1800 then 'stable' else 'decay' end as stage from m)
select run, metric, block, round(median(value) filter (stage = 'warmup'), 6) as warmup, round(median(value) filter (stage = 'stable'), 6) as stable, round(median(value) filter (stage = 'decay'), 6) as decay from s group by all""")
def stage_medians(spark, folder):
    return dynamics.stage_medians(metrics(spark, folder), STEPS, "run").select("run", "metric", "block", *[r(c).alias(c) for c in ("warmup", "stable", "decay")])


_PHASES = f"""{METRICS}, w as (select run, block, step, avg(value) filter (metric = 'D1') as d1, avg(value) filter (metric = 'grad_norm') as g, avg(value) filter (metric = 'upd_grad_align') as u from m group by all),
o as (select *, d1 / g as ov, d1 / g / u as ovn, case when d1 is not null then (d1 > 0)::int::double end as pos from w),
p as (select *, unnest(list_filter([case when step between 100 and 600 then 'gate' end, case when step between 300 and 1750 then 'stable' end, case when step between 1801 and 2000 then 'decay' end], lambda x: x is not null)) as "window" from o),
a as (select run, block, "window", median(d1) as a1, median(g) as a2, median(u) as a3, median(ov) as a4, median(ovn) as a5, avg(pos) as a6 from p group by all),
phase as (select run, block, "window", unnest(['D1', 'grad_norm', 'upd_grad_align', 'overshoot', 'overshoot_norm', 'D1>0']) as metric, unnest([a1, a2, a3, a4, a5, a6]) as value from a)"""
WINDOWS = {"gate": (100, 600), "stable": (300, 1750), "decay": (1801, 2000)}


def _phases(spark, folder):
    return dynamics.phases(metrics(spark, folder), WINDOWS, ["D1", "grad_norm", "upd_grad_align"], "run")


@query(f'with {_PHASES} select run, block, "window", metric, round(value, 6) as value from phase where value is not null')
def phases(spark, folder):
    return _phases(spark, folder).withColumn("value", r("value"))


@query(f'with {_PHASES}, v as (select * from phase where value is not null) select a.run, a.block, a."window", a.metric, round(a.value - b.value, 6) as delta from v a left join v b on b.run = \'run0\' and a.block = b.block and a."window" = b."window" and a.metric = b.metric')
def phase_deltas(spark, folder):
    found = dynamics.baseline_deltas(_phases(spark, folder), "run", "run0", ["block", "window", "metric"])
    return found.select("run", "block", "window", "metric", r("delta").alias("delta"))


@query(f"""with {METRICS}, w as (select block, step, avg(value) filter (metric = 'gns_trS') as t, avg(value) filter (metric = 'gns_G2') as g from m group by all), c as (select *, ((step + 249) // 250) * 250 as window_end from w where t is not null and g is not null),
n as (select *, row_number() over (partition by block, window_end order by step) as rn, count(*) over (partition by block, window_end) as n from c), a as (select block, window_end, count(*) as n, avg(t) / avg(g) as noise, avg(t) filter (rn <= n // 2) / avg(g) filter (rn <= n // 2) as h1, avg(t) filter (rn > n // 2) / avg(g) filter (rn > n // 2) as h2 from n where n >= 2 group by all)
select block, window_end, n, round(noise, 6) as noise, round(h1, 6) as first_half, round(h2, 6) as second_half, abs(h1 - h2) <= 0.3 * (h1 + h2) / 2 as agree from a""")
def noise_windows(spark, folder):
    found = dynamics.noise_scale(metrics(spark, folder), 250, 0.3)
    return found.select("block", "window_end", "n", *[r(c).alias(c) for c in ("noise", "first_half", "second_half")], "agree")


def tensors(spark, folder):
    line = table(spark, folder, "lineitem")
    q, p, d, t = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount"), F.col("l_tax")
    return line.select(
        (F.col("l_linenumber") - 1).alias("layer"), F.col("l_returnflag").alias("type"), (q * q).alias("gg_a"), (p * p).alias("gg_b"), (q * p).alias("g_ab"), (q + p).alias("ww"), (d * d).alias("vv_a"), (t * t).alias("vv_b"),
        (d * t).alias("v_ab"), (-q * d).alias("ga_va"), (p * d * 0.1).alias("gb_va"), F.lit(1).alias("n"), p.alias("gmax_b"), d.alias("vmax_a"),
    )


_TENSORS = """t as (select l_linenumber - 1 as layer, l_returnflag as type, l_quantity as q, l_extendedprice / 1000 as p, l_discount as d, l_tax as x from lineitem),
g as (select case when grouping(layer) = 0 then 'layer' when grouping(type) = 0 then 'type' else 'global' end as scope, layer, type, sum(q * q) as gga, sum(p * p) as ggb, sum(q * p) as gab, sum(q + p) as ww, sum(d * d) as vva, sum(-q * d) as gava, sum(p * d * 0.1) as gbva, count(*) as n, max(p) as gm from t group by grouping sets ((), (type), (layer, type)))"""


@query(f"""with {_TENSORS} select scope, layer, type, round(sqrt(ggb), 3) as grad_norm, round(gm, 6) as grad_max, round(gab / sqrt(gga * ggb), 6) as grad_cos_prev, round(sqrt(vva / ww), 6) as upd_rel, round(sqrt(vva / n), 6) as upd_rms,
 round(-gava / sqrt(gga * vva), 6) as upd_grad_align, round(gbva / sqrt(vva), 3) as "D1" from g""")  # fmt: skip
def group_norms(spark, folder):
    found = dynamics.group_norms(tensors(spark, folder))
    return found.select("scope", "layer", "type", r("grad_norm", 3).alias("grad_norm"), r("D1", 3).alias("D1"), *[r(c).alias(c) for c in ("grad_max", "grad_cos_prev", "upd_rel", "upd_rms", "upd_grad_align")])


@query("""with g as (select case when grouping(l_returnflag) = 1 then 'global' else l_returnflag end as block, sum(l_quantity * l_quantity) as a, sum(l_quantity * l_quantity * 1.4) as b, sum(l_quantity * 10) as c from lineitem group by rollup (l_returnflag))
select block, round(c, 3) as "G2", round(8 * ((a + b) / 2 - c), 3) as "trS", round(8 * ((a + b) / 2 - c) / c, 6) as "B" from g""")
def noise_groups(spark, folder):
    q = F.col("l_quantity")
    pairs = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("type"), (q * q).alias("gg1"), (q * q * 1.4).alias("gg2"), (q * 10).alias("g12"), F.lit(8).alias("b"))
    return dynamics.noise_groups(pairs).select("block", r("G2", 3).alias("G2"), r("trS", 3).alias("trS"), r("B").alias("B"))


@query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as rolling from events")
def rolling_mean(spark, folder):
    return dynamics.rolling_mean(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", 5).select("event_id", r("rolling").alias("rolling"))


@query("select event_id, lag(value) over (partition by user_id, event_type order by event_id) as previous, round(value - lag(value) over (partition by user_id, event_type order by event_id), 6) as change from events")
def step_changes(spark, folder):
    found = dynamics.lagged(table(spark, folder, "events"), ["user_id", "event_type"], "event_id", "value")
    return found.select("event_id", "previous", r("change").alias("change"))


@query("""with s as (select user_id, event_id, ts, event_type, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as v from events)
select event_id, v as last_view from s where event_type = 'purchase'""")
def as_of_last(spark, folder):
    events = table(spark, folder, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id")
    right = events.where("event_type = 'view'").select("user_id", "event_id", F.col("value").alias("last_view"))
    return dynamics.as_of(left, right, "event_id", "last_view", ["user_id"]).select("event_id", "last_view")


@query("select event_type as run, arg_max(value, event_id) as final, arg_max(value, event_id) filter (event_id <= 5000) as before, max(event_id) filter (event_id <= 5000) as before_step, round(arg_max(value, event_id) filter (event_id <= 5000) - arg_max(value, event_id), 6) as gain from events group by 1")
def final_and_before(spark, folder):
    found = dynamics.final_and_before(table(spark, folder, "events"), "event_type", "event_id", "value", 5000)
    return found.select(F.col("event_type").alias("run"), "final", "before", "before_step", r("gain").alias("gain"))


@query("select round(median(value), 6) as median_s, round(avg(value), 6) as mean_s, round(sum(user_id) / sum(value), 6) as tokens_per_s from events where event_id > 5")
def step_times(spark, folder):
    found = dynamics.step_times(table(spark, folder, "events"), "event_id", "value", "user_id")
    return found.select(*[r(c).alias(c) for c in found.columns])


@query("select user_id % 4 as layer, round(avg(value) filter (event_id % 5 = 0), 6) as \"0\", round(avg(value) filter (event_id % 5 = 1), 6) as \"1\", round(avg(value) filter (event_id % 5 = 2), 6) as \"2\" from events where event_type = 'view' group by 1")
def layer_heatmap(spark, folder):
    rows = table(spark, folder, "events").select(F.lit("layer").alias("scope"), F.col("event_type").alias("metric"), F.lit("t").alias("type"), (F.col("user_id") % 4).alias("layer"), (F.col("event_id") % 5).alias("step"), "value")
    found = dynamics.layer_heatmap(rows, "view", "t", [0, 1, 2])
    return found.select("layer", *[r(f"`{c}`").alias(c) for c in ("0", "1", "2")])


# --- benchmark questions


CHOICES = ["yes", "no way", "perhaps", "b"]


def questions(spark, folder):
    rows = table(spark, folder, "embeddings").where("size(embedding) >= 4")
    likelihoods = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    return rows.select("vec_id", "label", exprs.question_metrics(likelihoods, F.array(*[F.lit(c) for c in CHOICES]), F.col("label") % 4).alias("m")).select("vec_id", "label", "m.*")


_QUESTIONS = """q as (select vec_id, label, list_transform(embedding[1:4], lambda v: v::double) as l, (label % 4)::int as g from embeddings), c as (select *, [l[1] / 3, l[2] / 6, l[3] / 7, l[4] / 1] as e from q),
m as (select vec_id, label, (list_position(l, list_max(l)) - 1 = g)::int::double as acc, (list_position(e, list_max(e)) - 1 = g)::int::double as acc_norm, e[g + 1] as logp_char, exp(l[g + 1] - list_max(l)) / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) as prob_norm,
 e[g + 1] - list_max(list_filter(e, lambda v, i: i <> g + 1)) as margin_char from c)"""


@query(f"with {_QUESTIONS} select vec_id, acc, acc_norm, round(logp_char, 6) as logp_char, round(prob_norm, 6) as prob_norm, round(margin_char, 6) as margin_char from m")
def question_metrics(spark, folder):
    return questions(spark, folder).select("vec_id", "acc", "acc_norm", *[r(c).alias(c) for c in ("logp_char", "prob_norm", "margin_char")])


@query(f"with {_QUESTIONS} select label, count(*) as n, round(avg(acc), 6) as acc, round(avg(prob_norm), 6) as prob_norm from m group by label")
def question_report(spark, folder):
    return questions(spark, folder).groupBy("label").agg(F.count("*").alias("n"), r(F.avg("acc")).alias("acc"), r(F.avg("prob_norm")).alias("prob_norm"))


@query(f"""with {_QUESTIONS}, d as (select prob_norm - acc as d from m) select count(*) as n, round(avg(d), 6) as delta, round(stddev_samp(d) / sqrt(count(*)), 6) as stderr, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) as z from d""")
def paired_delta(spark, folder):
    rows = questions(spark, folder)
    found = stats.paired_delta(rows.select("vec_id", F.col("prob_norm").alias("v")), rows.select("vec_id", F.col("acc").alias("v")), ["vec_id"], "v")
    return found.select("n", r("delta").alias("delta"), r("stderr").alias("stderr"), r("z", 4).alias("z"))


@query()
def bootstrap_interval(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", (F.col("value") - 20).alias("d"), F.lit(1).alias("c"))
    return stats.bootstrap_ratio(rows, "user_id", "event_type", "d", "c", 1000)


# --- fits, schedules


# Final losses of runs by training tokens in billions.
RUNS = {
    "sophia": [(0.5, 4.021), (1.0, 3.387), (1.1, 3.320), (1.1, 3.323), (1.5, 3.176), (2.0, 3.047), (3.0, 2.897)],
    "adamw": [(0.5, 4.256), (1.0, 3.730), (1.1, 3.637), (1.5, 3.497), (2.0, 3.354)],
}
_POINTS = ", ".join(f"('{n}', {t}::double, {v}::double)" for n, p in RUNS.items() for t, v in p)


def points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, float(t), float(v)) for n, p in RUNS.items() for t, v in p], "run string, tokens double, loss double")


def _fits_sql(form: str, top: float, points_: str) -> str:
    """Tables p .. e of a fit, as SQL; e has the curve of every k."""
    f = "pow(x, -k)" if form == "power" else "exp(-x / k)"
    return f"""p(run, x, y) as (values {points_}), g as (select 0.05 + range * {(top - 0.05) / 3999!r} as k from range(4000)), s as (select run, k, count(*) as n, sum({f}) as sf, sum({f} * {f}) as sff, sum(y) as sy, sum({f} * y) as sfy, sum(y * y) as syy from p, g group by all),
 a as (select *, (n * sfy - sf * sy) / (n * sff - sf * sf) as a from s), l as (select *, (sy - a * sf) / n as l from a), e as (select *, greatest(syy - l * sy - a * sfy, 0) as sse from l where l >= 0 and a > 0)"""


def _fit_sql(form: str, top: float, points_: str) -> str:
    return f"""with {_fits_sql(form, top, points_)}
 select run, round(arg_min(l, sse), 2) as l, round(arg_min(a, sse), 2) as a, round(arg_min(k, sse), 2) as k, round(sqrt(min(sse) / any_value(n)), 4) as rmse from e group by run"""


def _fit(spark, form):
    return fits.scaling_fit(points(spark), form).select("run", r("l", 2).alias("l"), r("a", 2).alias("a"), r("k", 2).alias("k"), r("rmse", 4).alias("rmse"))


@query(_fit_sql("power", 5.0, _POINTS))
def scaling_power(spark, folder):
    return _fit(spark, "power")


@query(_fit_sql("exp", 10.0, _POINTS))
def scaling_exp(spark, folder):
    return _fit(spark, "exp")


_HELD = ", ".join(f"('{n}', {t}::double, {v}::double)" for n, p in RUNS.items() for t, v in p if t <= 2)


def _forecast_sql(form: str, top: float) -> str:
    f = "pow(v, -k)" if form == "power" else "exp(-v / k)"
    return f"""select run, '{form}' as form, v as x, round(l + a * {f}, 2) as predicted from (with {_fits_sql(form, top, _HELD)} select run, arg_min(l, sse) as l, arg_min(a, sse) as a, arg_min(k, sse) as k from e group by run), (values (3.0::double), (6.0::double)) t(v)"""


@query(f"{_forecast_sql('power', 5.0)} union all {_forecast_sql('exp', 10.0)}")
def scaling_forecast(spark, folder):
    """Fits on runs of at most 2 billion tokens, and what they predict for 3 and 6."""
    held = points(spark).where("tokens <= 2")
    both = [fits.predict(fits.scaling_fit(held, f), f, [3.0, 6.0]).withColumn("form", F.lit(f)) for f in fits.FORMS]
    return both[0].unionByName(both[1]).select("run", "form", "x", r("predicted", 2).alias("predicted"))


# Losses after a decay from given steps (in thousands) of the stable run.
BRANCHES = {
    "normuon": [(3.0, 3.0726), (5.5, 3.0216), (8.0, 2.9959), (10.3, 2.9820)],
    "adamw": [(3.0, 3.1660), (5.5, 3.0841), (8.0, 3.0408), (10.3, 3.0167)],
}
_BRANCHES = ", ".join(f"('{n}', {t}::double, {v}::double)" for n, p in BRANCHES.items() for t, v in p)


@query(_fit_sql("power", 5.0, _BRANCHES))
def branch_fit(spark, folder):
    """The floor of decayed losses: a + b S^-c over the steps S of the stable run."""
    rows = spark.createDataFrame([(n, t, v) for n, p in BRANCHES.items() for t, v in p], "run string, tokens double, loss double")
    return fits.scaling_fit(rows, "power").select("run", r("l", 2).alias("l"), r("a", 2).alias("a"), r("k", 2).alias("k"), r("rmse", 4).alias("rmse"))


@query()
def matrix_ranks(spark, folder):
    return fits.matrix_ranks(table(spark, folder, "embeddings"), "label", "embedding")


@query("select label, avg(embedding[1]::double) < 0.0 - 2 * 0.05 as win from embeddings group by label")
def wins(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return fits.wins(rows, "label", "v", 0.0, 0.05).select("label", "win")


STAGES = schedule.ramp_stages("32:0.5,64", 6e9, 8192, 64)
_STEPS = sum(n for _, n in STAGES)
_SEEN = "(least(step, {n0}) * {b0} + greatest(step - {n0}, 0) * {b1}) * 8192".format(n0=STAGES[0][1], b0=STAGES[0][0], b1=STAGES[1][0])


@query(f"""select step, case when step <= {STAGES[0][1]} then 32 else 64 end as batch, ({_SEEN})::bigint as tokens_seen, round(case when step - 1 < {int(0.02 * _STEPS)} then (step - 1) / {int(0.02 * _STEPS)} when step - 1 < {_STEPS - int(0.1 * _STEPS)} then 1.0
 else greatest(0.0, ({_STEPS} - (step - 1)) / {int(0.1 * _STEPS)}) end, 6) as lr_factor from (select range as step from range(1, {_STEPS + 1}))""")  # fmt: skip
def plan_table(spark, folder):
    return schedule.plan_table(spark, STAGES, 8192).withColumn("lr_factor", r("lr_factor"))


@query(f"with p as (select range as step, ({_SEEN.replace('step', 'range')})::bigint as seen from range(1, {_STEPS + 1})) select mark, max(step) as step from p, (values ('1B', 1000000000), ('3B', 3000000000), ('5B', 5000000000)) m(mark, t) where seen <= t group by mark")
def checkpoint_steps(spark, folder):
    return schedule.checkpoint_steps(schedule.plan_table(spark, STAGES, 8192), {"1B": 1e9, "3B": 3e9, "5B": 5e9})


@query("""select range as step, round(case when range < 20 then range / 20 else greatest(0.0, 0.5 * (1 + cos(pi() * (range - 20) / 980)) * 0.9 + 0.1) end, 6) as cosine,
 round(case when range < 20 then range / 20 when range < 600 then 1.0 when range < 700 then 1 - 0.7 * (range - 600) / 100 when range < 900 then 0.3 else 0.3 * greatest(0.0, (1000 - range) / 100) end, 6) as wsd2 from range(1000)""")
def lr_schedules(spark, folder):
    steps = spark.range(1000).select(F.col("id").alias("step"))
    cosine = schedule.lr_factor(F.col("step"), "cosine", 1000, 20, 100)
    wsd2 = schedule.lr_factor(F.col("step"), "wsd2", 1000, 20, 100, decay1_steps=100, stable2_steps=200)
    return steps.select("step", r(cosine).alias("cosine"), r(wsd2).alias("wsd2"))


@query(f"""with h as (select *, row_number() over (order by case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end, event_id) - 1 as p from {sql_hash64(3, '(select event_id from events)', 'event_id')})
select event_id, case when p < 128 then 1 + p // 32 when p < 512 then 5 + (p - 128) // 64 end as step, case when p < 128 then ((p % 32 + 1) * 4 - 1) // 32 when p < 512 then (((p - 128) % 64 + 1) * 4 - 1) // 64 end as micro from h""")
def batch_sampler(spark, folder):
    return schedule.batches(table(spark, folder, "events"), "event_id", [(32, 4), (64, 6)], 3, world=2, accumulate=2)


@query(f"""with h as (select *, row_number() over (order by case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end, event_id) - 1 - 512 as t from {sql_hash64(3, '(select event_id from events)', 'event_id')}),
m as (select event_id, t // 64 as measurement, (t // 32) % 2 as rank, t % 32 as o, case when (t // 64) * 5 <= 4 then 8 else 16 end as m from h where t >= 0)
select event_id, measurement::int as measurement, rank::int as rank, (o // m)::int as pair from m where measurement < 3 and o < 2 * m""")
def noise_blocks(spark, folder):
    """Blocks that the plan leaves, dealt to noise measurements, ranks and pairs."""
    return schedule.noise_blocks(table(spark, folder, "events"), "event_id", [(32, 4), (64, 6)], 3, 5, world=2, accumulate=2)


@query(f"""with {_QUESTIONS}, s as (select case when label % 2 = 0 then 'proxy-' else 'full-' end || label as run, avg(prob_norm) as v from m group by 1)
select a.run, b.run as reference, round(a.v - b.v, 6) as delta from s a join s b on b.run in ('proxy-0', 'full-1') and a.run <> b.run and starts_with(a.run, 'proxy') = starts_with(b.run, 'proxy')""")
def comparable_runs(spark, folder):
    """Each run against the references of its own kind."""
    run = F.concat(F.when(F.col("label") % 2 == 0, "proxy-").otherwise("full-"), F.col("label"))
    means = questions(spark, folder).groupBy(run.alias("run")).agg(F.avg("prob_norm").alias("v"))
    references = means.select(F.col("run").alias("reference"), F.col("v").alias("__v"))
    pairs = means.withColumn("reference", F.explode(F.array(F.lit("proxy-0"), F.lit("full-1")))).where(exprs.comparable(F.col("run"), F.col("reference")) & (F.col("run") != F.col("reference")))
    both = pairs.join(references, "reference")
    return both.select("run", "reference", r(F.col("v") - F.col("__v")).alias("delta"))


@query("select event_id, ((event_id % 3) * 86400 + (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59)::bigint as seconds from events")
def durations(spark, folder):
    """Durations written with and without days."""
    part = lambda k: (F.col("event_id") % k).cast("int")
    clock = F.format_string("%02d:%02d:%02d", part(24), part(60), part(59))
    text = F.when(F.col("event_id") % 3 == 0, clock).otherwise(F.concat((F.col("event_id") % 3).cast("string"), F.lit("-"), clock))
    return table(spark, folder, "events").select("event_id", exprs.duration_seconds(text).alias("seconds"))


@query("select event_id, case event_id % 4 when 0 then (event_id % 900 + 2) * 1e3 when 1 then (event_id % 900 + 2) * 1e6 when 2 then (event_id % 900 + 2) * 1e9 else 0.25 * 6e9 end as tokens from events")
def stage_amounts(spark, folder):
    """Token amounts written with suffixes, and as a share of the budget."""
    n = (F.col("event_id") % 900 + 2).cast("string")
    text = F.when(F.col("event_id") % 4 == 3, "0.25").otherwise(F.concat(n, F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("b")), (F.least(F.col("event_id") % 4, F.lit(2)) + 1).cast("int"))))
    return table(spark, folder, "events").select("event_id", exprs.stage_tokens(text, F.lit(6e9)).alias("tokens"))


_TENSORS_OF = {"self_attn.q_proj.weight": ("attn_q", 2), "self_attn.o_proj.weight": ("attn_o", 2), "mlp.gate_proj.weight": ("mlp_gate", 2), "input_layernorm.weight": ("norm", 1), "self_attn.q_proj.bias": ("bias", 1)}


@query(f"""with n(type) as (values {', '.join(f"('{t}')" for t, _ in _TENSORS_OF.values())}), l as (select range as layer from range(32)), every as (select type, layer from n, l union all select 'embed', -1 union all select 'lm_head', -1)
select type, count(*) as tensors, sum(layer + 2)::bigint as numbers, count(distinct layer) as layers from every group by type""")
def parameter_groups(spark, folder):
    """Parameters of a model by block type and layer, from their names."""
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(dims).alias("dimensions")) for name, (_, dims) in _TENSORS_OF.items()])
    layers = spark.range(32).select((F.col("id") + 2).alias("numbers"), F.concat(F.lit("model.layers."), "id").alias("prefix"), F.explode(kinds).alias("k"))
    named = layers.select(F.concat("prefix", F.lit("."), "k.name").alias("name"), "k.dimensions", "numbers")
    ends = spark.createDataFrame([("model.embed_tokens.weight", 2, 1), ("lm_head.weight", 2, 1)], "name string, dimensions int, numbers long")
    return dynamics.parameter_table(named.unionByName(ends))


# --- streams


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, folder):
    """Daily windows of the stream of events, run as a batch."""
    return ingest.window_totals(table(spark, folder, "events"), "ts", "1 day", ["event_type"], "value").select("start", "event_type", "n", r("total", 4).alias("total"))


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval '6 hours' then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, i""")
def event_sessions(spark, folder):
    return ingest.sessions(table(spark, folder, "events"), "ts", "6 hours", "user_id").select("user_id", "start", "n")


@query("select event_id, first_value(value) over (partition by user_id order by ts, event_id) as first_value from events")
def first_values(spark, folder):
    first = F.first("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, folder, "events").select("event_id", first.alias("first_value"))


@query("""with b as (select event_type, max(event_id) filter (event_id <= 5000) as x0, min(event_id) filter (event_id >= 5000) as x1 from events group by 1), v as (select b.*, a.value as y0, c.value as y1 from b left join events a on a.event_id = x0 left join events c on c.event_id = x1)
select event_type as run, round(case when x0 = x1 then y0 else y0 + (5000 - x0) * (y1 - y0) / (x1 - x0) end, 6) as value from v""")
def interpolated(spark, folder):
    found = dynamics.interpolated(table(spark, folder, "events"), "event_type", "event_id", "value", 5000)
    return found.select(F.col("event_type").alias("run"), r("value").alias("value"))


@query("""with h as (select event_type as run, event_id as tokens, value / 100 as loss from events), s as (select *, avg(loss) over (partition by run order by tokens rows between 4 preceding and current row) as m from h)
select run, tokens, round(m, 6) as smoothed, round(exp(m), 4) as perplexity from s""")
def loss_curves(spark, folder):
    history = table(spark, folder, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("tokens"), (F.col("value") / 100).alias("loss"))
    found = dynamics.loss_curves(history, "run", "tokens", "loss")
    return found.select("run", "tokens", r("smoothed").alias("smoothed"), r("perplexity", 4).alias("perplexity"))
