"""Scalar functions of the pipeline as column expressions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket edges of the reports.
Z_EDGES = [-2.5, -2.0, -1.5, -1.0, -0.5, -1e-9, 1e-9, 0.5, 1.0, 1.5, 2.0, 2.5]
COPY_BUCKETS = [(1, 1), (2, 2), (3, 4), (5, 16), (17, 100), (101, 1000), (1001, None)]
FREQUENCY_EDGES = [1e3, 1e4, 1e5, 1e6, 1e7]
PERCENTILES = [1, 2, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 98, 99]

# Parameter name patterns and their block types, in order of precedence; layer numbers; norms.
BLOCK_PATTERNS = [
    ("pos_embed", r"(?:^|\.)(wpe|position_embeddings|pos_embed)\.weight$"),
    ("embed", r"(?:^|\.)(embed_tokens|wte|word_embeddings|tok_embeddings|embed)\.weight$"),
    ("lm_head", r"(?:^|\.)(lm_head|unembed|output)\.weight$"),
    ("attn_qkv", r"(?:^|\.)(qkv_proj|c_attn|query_key_value|Wqkv)\."),
    ("attn_q", r"(?:^|\.)(q_proj|query|wq)\."),
    ("attn_k", r"(?:^|\.)(k_proj|key|wk)\."),
    ("attn_v", r"(?:^|\.)(v_proj|value|wv)\."),
    ("attn_o", r"(?:^|\.)(o_proj|out_proj|wo|dense)\.|attn\.c_proj\."),
    ("mlp_gate", r"(?:^|\.)(gate_proj|w1)\."),
    ("mlp_up", r"(?:^|\.)(up_proj|c_fc|w3|fc1|dense_h_to_4h)\."),
    ("mlp_down", r"(?:^|\.)(down_proj|w2|fc2|dense_4h_to_h)\.|mlp\.c_proj\."),
]
LAYER_PATTERN = r"(?:^|\.)(?:layers|layer|h|blocks|block)\.(\d+)\."
NORM_PATTERN = r"(?i)norm|(?:^|\.)ln_|layernorm"


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges that x reaches: 0 below the first, k for edges[k-1] <= x < edges[k]. NaN and null give null."""
    out = F.lit(0)
    for k, edge in enumerate(edges, 1):
        out = F.when(x >= F.lit(float(edge)), k).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), out)


def clip(x: Column, low: float, high: float) -> Column:
    """x within low .. high; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def copy_bucket(copies: Column) -> Column:
    """The label of a number of copies: ``1-1``, ``2-2``, ``3-4``, ... ``1001-inf``."""
    out = F.lit(None).cast("string")
    for low, high in reversed(COPY_BUCKETS):
        inside = (copies >= low) & (copies <= high) if high else copies >= low
        out = F.when(inside, f"{low}-{high or 'inf'}").otherwise(out)
    return out


def z_bin(z: Column) -> Column:
    """Label of a z-score's bin; scores within 1e-9 of 0 (untrusted, or at the mean) have a bin of their own."""
    names = ["z = 0" if lo == -1e-9 else f"[{lo:+.1f}, {hi:+.1f})" for lo, hi in zip([float("-inf"), *Z_EDGES], [*Z_EDGES, float("inf")])]
    names = [n.replace("-0.0", "+0.0") for n in names]
    place = digitize(z, Z_EDGES)
    return F.when(place.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), place + 1))


def weighted_draw_key(uniform: Column, z: Column, beta: float) -> Column:
    """log(u) / exp(beta z): the largest keys are drawn first in a weighted draw without replacement."""
    return F.log(uniform) / F.exp(F.lit(float(beta)) * z)


def qc_passes(score: Column, limit: float) -> Column:
    """Documents without a score are kept, others if it lies below the limit; NaN counts as no score."""
    return score.isNull() | F.isnan(score) | (score < limit)


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last match of a pattern; null without a match."""
    return F.element_at(F.nullif(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")), -1)


def stage(step: Column, max_steps: int, warmup: float = 0.02, decay: float = 0.1) -> Column:
    """warmup, stable or decay."""
    return F.when(step <= int(warmup * max_steps), "warmup").when(step <= max_steps - int(decay * max_steps), "stable").otherwise("decay")


def stage_tokens(amount: Column, budget: Column) -> Column:
    """``300M``, ``1B``, ``1e9`` -> tokens; a number of at most 1 is a share of the budget. Null if it is no number."""
    suffix = F.upper(F.right(F.trim(amount), F.lit(1)))
    factor = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).otherwise(1.0)
    number = F.regexp_replace(F.trim(amount), "[KMBkmb]$", "")
    tokens = number.try_cast("double") * factor
    return F.when(tokens <= 1, tokens * budget).otherwise(tokens)


def duration_seconds(text: Column) -> Column:
    """``[D-]HH:MM:SS`` -> seconds; null if it has another form."""
    pattern = r"^(?:(\d+)-)?(\d+):(\d+):(\d+)$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def layer_of(name: Column) -> Column:
    """Layer index of a parameter, -1 outside layers."""
    return F.coalesce(F.nullif(F.regexp_extract(name, LAYER_PATTERN, 1), F.lit("")).cast("int"), F.lit(-1))


def block_type(name: Column, dimensions: Column) -> Column:
    """Block type of a parameter: norm, bias or vector below two dimensions, else the first pattern that fits, else other_<part>."""
    parts = F.split(name, r"\.")
    out = F.concat(F.lit("other_"), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.get(parts, F.lit(0))))
    for kind, pattern in reversed(BLOCK_PATTERNS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    flat = F.when(name.rlike(NORM_PATTERN), "norm").when(name.endswith("bias"), "bias").otherwise("vector")
    return F.when(dimensions < 2, flat).otherwise(out)


def simplify(text: Column) -> Column:
    """Lower case, without anything but letters, digits and white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")


def word_list(text: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def flops_utilization(tokens_per_second: Column, flops_per_token: float, devices: int, peak_flops: float) -> Column:
    return tokens_per_second * F.lit(flops_per_token) / F.lit(devices * peak_flops)


def gold_index(target: Column, choices: Column) -> Column:
    """0-based index of the right answer: a number, or the choice equal to the target, with or without a leading space."""
    text = F.trim(target)
    found = F.array_position(choices, target)
    spaced = F.array_position(choices, F.concat(F.lit(" "), target))
    place = F.when(found > 0, found - 1).when(spaced > 0, spaced - 1)
    return F.when(text.rlike(r"^-*\d+$"), text.try_cast("long")).otherwise(place)


def question_metrics(likelihoods: Column, choices: Column, gold: Column, greedy: Column | None = None) -> Column:
    """struct(acc, acc_norm, logp_char, prob_norm, margin_char) of one question.

    With a single choice acc says whether it was the greedy continuation, and only logp_char is defined besides. Ties in the
    likelihoods go to the first choice. A gold index outside the choices gives nulls.
    """
    one = F.size(likelihoods) == 1
    lengths = F.transform(choices, lambda c: F.greatest(F.length(c), F.lit(1)).cast("double"))
    each = F.zip_with(likelihoods, lengths, lambda a, b: a / b)
    top = F.array_max(likelihoods)
    softened = F.transform(likelihoods, lambda v: F.exp(v - top))
    total = F.aggregate(softened, F.lit(0.0), lambda a, b: a + b)
    g = gold.cast("int")
    inside = (g >= 0) & (g < F.size(likelihoods))
    wrong = F.filter(F.transform(each, lambda v, i: F.when(i != g, v)), lambda v: v.isNotNull())
    hit = lambda values: (F.array_position(values, F.array_max(values)) - 1 == g).cast("double")
    said = greedy.cast("double") if greedy is not None else F.lit(None).cast("double")
    many = F.when(inside & ~one, True)
    return F.struct(
        F.when(one, said).when(many, hit(likelihoods)).alias("acc"),
        F.when(many, hit(each)).alias("acc_norm"),
        F.when(one, F.get(likelihoods, F.lit(0)) / F.length(F.get(choices, F.lit(0)))).when(many, F.get(each, g)).alias("logp_char"),
        F.when(many, F.get(softened, g) / total).alias("prob_norm"),
        F.when(many, F.get(each, g) - F.array_max(wrong)).alias("margin_char"),
    )


def reached(x: Column, edges: Sequence[float]) -> Column:
    """As ``digitize``, for many ascending edges: a binary search over a literal array."""
    table, steps = F.array(*[F.lit(float(e)) for e in edges]), [1 << k for k in reversed(range(len(edges).bit_length()))]
    place = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, step: F.when((at + step <= len(edges)) & (F.get(table, at + step - 1) <= x), at + step).otherwise(at))
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), place)


def logit_thresholds(n: int = 2001, eps: float = 1e-6) -> list[float]:
    """n thresholds in (0, 1) with equal steps of their log odds."""
    import math

    top = math.log((1 - eps) / eps)
    return [1 / (1 + math.exp(top - 2 * top * k / (n - 1))) for k in range(n)]


def comparable(run: Column, reference: Column, prefix: str = "proxy") -> Column:
    """Runs are compared with their like only: both of the kind that the prefix names, or neither."""
    return run.startswith(prefix) == reference.startswith(prefix)
