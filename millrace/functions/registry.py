"""Functions of the pipeline under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .hashing import blake2_key


def register(spark: SparkSession) -> None:
    """Register the functions that SQL lacks: ``blake2_key(text)`` and, over built-ins only, ``copy_bucket(n)``, ``qc_passes(score, t)``."""
    spark.udf.register("blake2_key", blake2_key)
    spark.sql("create or replace temporary function qc_passes(score double, t double) returns boolean return score is null or isnan(score) or score < t")
    spark.sql(
        "create or replace temporary function copy_bucket(n bigint) returns string return case when n = 1 then '1-1' when n = 2 then '2-2' when n <= 4 then '3-4' when n <= 16 then '5-16' "
        "when n <= 100 then '17-100' when n <= 1000 then '101-1000' else '1001-inf' end"
    )
