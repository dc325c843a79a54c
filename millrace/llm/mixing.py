"""Problem 7: mix sources to target shares of the tokens, repeating a source at most so many times.

Weights. Let s be the natural token shares. ``tempered(s, t)`` exponentiates them: w ~ s^t, from uniform (t = 0) to natural (t = 1);
``entropy_exponent`` bisects t so that the weights have a wanted entropy. With target shares m the path leads from s to m,
w ~ s * (m / s)^t, and ``target_weights`` bisects the largest t at which no source is repeated more often than allowed.
Sources that can't reach their target at all are held at their limit, and the others share the rest of the mix.

Realisation. A source that is used r times gives floor(r) whole blocks, each a permutation of all its texts, and of one more
permutation the longest prefix within the remaining token budget; the prefix comes from a distributed prefix sum.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import canonical
from ..operators.prefix import cut_rows, up_to
from ..runtime import materialize, table
from .budget import VOCABULARY, token_counts

MAX_SOURCES = 10_000  # bound of what the driver sees: one row per source
SEED = 7


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    powers = np.where(shares > 0, np.maximum(shares, 1e-300) ** exponent, 0.0)
    return powers / powers.sum() if powers.sum() > 0 else powers


def entropy(weights: np.ndarray) -> float:
    return float(-sum(w * math.log(w) for w in weights if w > 0))


def entropy_exponent(shares: np.ndarray, wanted: float) -> float:
    """The exponent in 0 .. 64 at which the tempered shares have the entropy ``wanted`` (entropy falls as it grows)."""
    low, high = 0.0, 64.0
    for _ in range(100):
        middle = (low + high) / 2
        if entropy(tempered(shares, middle)) > wanted:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def target_weights(tokens: np.ndarray, targets: np.ndarray, repeats: np.ndarray, size: float) -> tuple[np.ndarray, float]:
    """Weights of a mix of ``size`` tokens, and the exponent of the path from natural to target shares.

    They sum to less than 1 only if all sources together, each at its limit, can't fill the mix.
    """
    limits = np.where(tokens > 0, repeats * tokens / size, 0.0)
    held = (limits < targets) | (targets <= 0)
    natural = tokens / max(tokens.sum(), 1)
    while True:
        free = ~held
        rest = 1.0 - np.minimum(limits, targets)[held].sum()
        weights = np.where(held, np.minimum(limits, targets), 0.0)
        if not free.any():
            return weights, 0.0

        def path(exponent: float) -> np.ndarray:
            steps = natural[free] * (targets[free] / natural[free]) ** exponent
            return rest * steps / steps.sum()

        fits = lambda exponent: bool((path(exponent) <= limits[free] * (1 + 1e-12)).all())
        if fits(1.0):
            weights[free] = path(1.0)
            return weights, 1.0
        if fits(0.0):
            low, high = 0.0, 1.0
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if fits(middle) else (low, middle)
            weights[free] = path(low)
            return weights, low
        over = np.flatnonzero(free)[path(1.0) > limits[free]]
        if len(over) == 0:
            over = np.flatnonzero(free)[path(0.0) > limits[free]]
        held[over] = True
        targets = targets.copy()
        targets[over] = limits[over]


def distinct_texts(docs: DataFrame, catalog: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens): each distinct text of a source once, as its least ``doc_id``; null and blank texts not at
    all; written once. Copies collapse map-side by a 128-bit hash of the text, so a much copied text is no hot key."""
    filled = docs.where("text is not null").where(~F.col("text").rlike(r"(?U)\A\s*\z"))
    named = canonical(filled.select("source", "topic", "doc_id", "text"), catalog, vigintile=None)
    named = named.select(F.coalesce("source", F.lit("-")).alias("source"), "doc_id", F.md5("text").alias("hash"), "text")
    counted = token_counts(named, ["source", "doc_id", "hash"], vocabulary)
    once = counted.groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    return materialize(once.select("source", "doc_id", "n_tokens"), "texts")


def shares(texts: DataFrame, targets: DataFrame) -> list[dict]:
    """Per source: tokens, target, limit, reachable, weight, repeats. Sources without target have target 0; a target
    without texts can't be reached."""
    totals = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_texts"))
    rows = totals.join(targets.select("source", "mix_pct", "max_repeats"), "source", "full").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: r.source)
    tokens = np.array([r.tokens or 0 for r in rows], dtype=float)
    wanted = np.array([r.mix_pct or 0 for r in rows], dtype=float) / 100
    repeats = np.array([r.max_repeats or 0 for r in rows], dtype=float)
    size = tokens.sum()
    weights, exponent = target_weights(tokens, wanted, repeats, size) if size > 0 else (np.zeros(len(rows)), 0.0)
    out = []
    for i, r in enumerate(rows):
        # in integers, as a limit may be met exactly
        reachable = 100 * int(repeats[i]) * int(tokens[i]) >= int(r.mix_pct or 0) * int(size)
        out.append(
            {
                "source": r.source, "n_texts": r.n_texts or 0, "tokens": int(tokens[i]), "natural_share": float(tokens[i] / size) if size else 0.0, "mix_share": float(wanted[i]),
                "max_repeats": int(repeats[i]), "reachable": reachable, "weight": float(weights[i]), "exponent": float(exponent), "repeats": float(weights[i] * size / tokens[i]) if tokens[i] else 0.0,
            }
        )
    return out


_SCHEMA = "source string, n_texts long, tokens long, natural_share double, mix_share double, max_repeats int, reachable boolean, weight double, exponent double, repeats double"


def mix(texts: DataFrame, plan: list[dict], seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, copies, place): the texts of the mix. ``copies`` - 1 or all of a text's copies come from
    whole blocks; ``place`` orders the texts of the partial block (and of any block, with its number as seed)."""
    spark = texts.sparkSession
    blocks = [(p["source"], int(p["repeats"] + 1e-9), int((p["repeats"] - int(p["repeats"] + 1e-9)) * p["tokens"] + 1e-6)) for p in plan]
    whole = spark.createDataFrame(blocks, "source string, blocks int, target long")
    placed = texts.join(F.broadcast(whole), "source").withColumn("place", F.xxhash64("doc_id", F.lit(seed), "blocks"))
    partial = placed.where("target > 0")
    cuts = cut_rows(partial, whole.select("source", "target"), ["place", "doc_id"], F.col("n_tokens"), ["source"], reach=False)
    extra = up_to(partial.select("source", "doc_id", "place"), cuts, ["place", "doc_id"], ["source"]).select("source", "doc_id", F.lit(1).alias("extra"))
    copies = placed.join(extra, ["source", "doc_id"], "left").withColumn("copies", F.col("blocks") + F.coalesce("extra", F.lit(0)))
    return copies.where("copies > 0").select("source", "doc_id", "n_tokens", "copies", "place")


def placed_blocks(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, block, place): one row for every copy of ``mix``, at most the size of the mix in all. The
    block's number is in the hash, so each block of a source is a permutation of its own; by it the partial block is cut."""
    each = mixed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select("source", "doc_id", "n_tokens", "block", F.xxhash64("doc_id", F.lit(seed), "block").alias("place"))


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, list[dict]]:
    texts = distinct_texts(table(spark, folder, "documents", spread=True), table(spark, folder, "doc_counts"))
    return texts, shares(texts, table(spark, folder, "source_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that the weights of the mix leave below their target share; those at it by rounding are told in integers."""
    _, plan = _inputs(spark, folder)
    below = [p for p in plan if p["weight"] <= p["mix_share"] * (1 + 1e-9)]
    return spark.createDataFrame([(p["source"],) for p in below if not p["reachable"]], "source string")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: natural and target share, repeats, and the tokens and share it has in the realised mix."""
    texts, plan = _inputs(spark, folder)
    used = mix(texts, plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    joined = spark.createDataFrame([tuple(p.values()) for p in plan], _SCHEMA).join(used, "source", "left").fillna({"mix_tokens": 0, "most_copies": 0}).toPandas()
    joined["actual_share"] = joined["mix_tokens"] / max(1, joined["mix_tokens"].sum())  # one row per source
    return spark.createDataFrame(joined, _SCHEMA + ", mix_tokens long, most_copies int, actual_share double")


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The mix in order: every use of a text, with its block and its place in that."""
    return placed_blocks(mix(*_inputs(spark, folder)))


def p7_tempered(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: natural share, and its weight in the temperature mix whose entropy is that of the target shares."""
    _, plan = _inputs(spark, folder)
    shares_ = np.array([p["natural_share"] for p in plan])
    wanted = np.array([p["mix_share"] for p in plan])
    exponent = entropy_exponent(shares_, entropy(wanted / wanted.sum())) if wanted.sum() > 0 else 1.0
    weights = tempered(shares_, exponent)
    return spark.createDataFrame([(p["source"], float(s), float(w), exponent) for p, s, w in zip(plan, shares_, weights)], "source string, natural_share double, weight double, exponent double")


def p7_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Per source with texts, of the realised mix: its distinct texts, whether every block but the last has each of them once, whether
    no text is used more often than the source's limit and the mix exceeds no source's weight, and whether the blocks' orders differ."""
    texts, plan = _inputs(spark, folder)
    limits = spark.createDataFrame([(p["source"], p["n_texts"], p["max_repeats"], p["weight"] * sum(q["tokens"] for q in plan) + 1) for p in plan], "source string, of long, most int, budget double")
    used = placed_blocks(mix(texts, plan))
    blocks = used.groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("different"), F.sum("n_tokens").alias("tokens"), F.min_by("doc_id", "place").alias("first"))
    each = blocks.groupBy("source").agg(F.max("block").alias("last"), F.max_by("n", "block").alias("n_last"), F.sum("n").alias("n"), F.bool_and(F.col("n") == F.col("different")).alias("once"), F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"), F.countDistinct("first").alias("firsts"))
    known = limits.where("of > 0").join(each, "source", "left")
    none = F.col("n").isNull()
    return known.select(
        "source", F.col("of").alias("n_texts"), (none | (F.col("once") & (F.col("n") - F.col("n_last") == F.col("last") * F.col("of")))).alias("whole_blocks"),
        (none | ((F.col("last") < F.col("most")) & (F.col("tokens") <= F.col("budget")))).alias("within_limit"), (none | (F.col("blocks") == 1) | (F.col("firsts") > 1)).alias("own_orders"),
    )


SQL_FOUND = r"""with {catalog}, pieces as (select source, text, len(regexp_extract_all(text, '[\pL]+|[\pN]+|[^\s\pL\pN]+')) as n from {documents} where trim(text, E' \n\t\r') <> '' group by all),
totals as (select source, sum(n) as tokens from pieces group by source)
select source from source_targets left join totals using (source)
where 100 * max_repeats * coalesce(tokens, 0) < mix_pct * (select sum(tokens) from totals)"""

SQL_BLOCKS = r"""with {catalog}, t as (select distinct source, text from {documents} where not regexp_full_match(text, '\s*'))
select source, count(*) as n_texts, true as whole_blocks, true as within_limit, true as own_orders from t group by source"""
