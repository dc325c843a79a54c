"""Problem 5: a reproducible sample that keeps its members as the data grows.

A keyed Feistel network permutes the fixed identifier domain 0 .. 2^62 - 1, whatever identifiers exist in it. An identifier
is selected if its permuted value lies below rate x domain size. The decision depends on the identifier, the key and the
rate only: no state, no order, no counts; it is the same in every run and layout, new rows never push out old ones, a higher
rate keeps all of a lower rate's sample, and distinct identifiers never collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical
from ..operators.records import with_row_id
from ..plans.sql import KNOWN
from ..runtime import table

HALF = 31
MASK = (1 << HALF) - 1
ROUNDS = 6
SEED = 20261015


def round_keys(seed: int = SEED) -> list[tuple[int, int]]:
    """(added key, odd multiplier), both below 2^31, for every round; from a linear congruence of the seed."""
    state, keys = seed & ((1 << 64) - 1), []
    for _ in range(ROUNDS):
        state = (state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        keys.append(((state >> 33) & MASK, (state >> 2) & MASK | 1 | 1 << 30))
    return keys


def permuted(identifier: Column, seed: int = SEED) -> Column:
    """The place of an identifier in 0 .. 2^62 - 1; null outside the domain. JVM arithmetic that can't overflow."""
    left, right = F.shiftright(identifier, HALF), identifier.bitwiseAND(F.lit(MASK))
    for key, factor in round_keys(seed):
        mixed = F.shiftright(right.bitwiseXOR(F.lit(key)) * F.lit(factor), 17).bitwiseAND(F.lit(MASK))
        left, right = right, left.bitwiseXOR(mixed)
    return F.when(identifier.between(0, (1 << 2 * HALF) - 1), F.shiftleft(left, HALF).bitwiseOR(right))


def in_sample(identifier: Column, rate: float, seed: int = SEED) -> Column:
    """True if the identifier belongs to the sample of this rate; null and negative identifiers never do."""
    return F.coalesce(permuted(identifier, seed) < F.lit(int(rate * (1 << 2 * HALF))), F.lit(False))


def stable_sample(rows: DataFrame, rate: float, identifier: str = "row_id", arrived: str = "added_at", seed: int = SEED) -> DataFrame:
    """One row per selected identifier: the one that arrived first (ties: the least of the other values), so that repeats in
    later batches change nothing. Rows are selected before anything is shuffled."""
    chosen = rows.where(in_sample(F.col(identifier), rate, seed))
    first = Window.partitionBy(identifier).orderBy(F.col(arrived).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rows.columns if c not in (identifier, arrived)])
    return chosen.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


RATE = 0.1


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "doc_counts")
    return with_row_id(table(spark, folder, "pool").select("row_id", "shard", "shard_offset", "rank", "source", "topic", "added_at"), catalog)


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stable_sample(_pool(spark, folder), RATE).select("row_id", "rank", "added_at")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the pool and of the sample by source; a document counts once, at its first arrival."""
    first = stable_sample(_pool(spark, folder), 1.0)
    named = canonical(first, table(spark, folder, "doc_counts"), vigintile=None)
    picked = F.count_if(in_sample(F.col("row_id"), RATE))
    return named.groupBy("source").agg(F.count("*").alias("n_docs"), picked.alias("n_sampled")).withColumn("rate", F.round(F.col("n_sampled") / F.col("n_docs"), 6))


def _sql_permuted(identifier: str, seed: int = SEED) -> str:
    left, right = f"(({identifier}) >> {HALF})", f"(({identifier}) & {MASK})"
    for key, factor in round_keys(seed):
        left, right = right, f"xor({left}, ((xor({right}, {key}::bigint) * {factor}::bigint) >> 17) & {MASK}::bigint)"
    return f"((({left}) << {HALF}) | ({right}))"


SQL_IN = f"{_sql_permuted('row_id')} < {int(RATE * (1 << 2 * HALF))}"
SQL_SAMPLE = f"""with {KNOWN},
picked as (select * from known where row_id >= 0 and {SQL_IN})
select row_id, min_by(rank, added_at) as rank, min(added_at) as added_at from picked group by row_id"""
