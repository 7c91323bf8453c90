"""Spark's own sketches under one roof: the fast neighbours of this library's structures.

They live in one aggregate buffer a group and merge in Spark's shuffle. Use them where any sketch of the kind will do; use
the cells where the state must be read, rolled up, compared or the same in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def approx_distinct(key: Column, error: float = 0.01) -> Column:
    return F.approx_count_distinct(key, error)


def hll(key: Column, log_k: int = 12) -> Column:
    return F.hll_sketch_agg(key, F.lit(log_k))


def theta(key: Column, log_k: int = 12) -> Column:
    return F.theta_sketch_agg(key, F.lit(log_k))


def kll(value: Column) -> Column:
    return F.kll_sketch_agg_double(value)


def top_k(key: Column, k: int) -> Column:
    return F.approx_top_k(key, F.lit(k)) if hasattr(F, "approx_top_k") else F.call_function("approx_top_k", key, F.lit(k))


def quantiles(value: Column, qs: list[float], accuracy: int = 10_000) -> Column:
    return F.percentile_approx(value, qs, accuracy)


def prefiltered_join(left: DataFrame, right: DataFrame, key: str, fp_rate: float = 0.01) -> DataFrame:
    """``left`` and ``right`` joined by ``key``; rows of ``left`` that a Bloom filter of the right keys refuses never reach
    the shuffle. Worth it if the right side is far smaller and few left rows have a partner; the result is exact."""
    from ..operators.membership import BloomFilter

    n = right.select(F.approx_count_distinct(key)).first()[0]
    spec = BloomFilter.sized(max(n, 1), fp_rate, "xxhash64")
    kept = BloomFilter.build(right, key, spec).test(left, key, "__m").where("__m").drop("__m")
    return kept.join(right, key)
