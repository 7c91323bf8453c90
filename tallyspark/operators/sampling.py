"""Weighted samples of fixed size: every subset's weight is estimated without bias, the total exactly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards


def var_opt(df: DataFrame, weight: str, k: int, id_col: str, seed: int = 1, out: str = "adjusted", buckets: int = 256) -> DataFrame:
    """At most k rows of ``df`` with ``out``, the weight that each stands for.

    With tau such that the sum of min(1, w / tau) is k, rows heavier than tau are kept as they are. The others are laid out
    in a seeded order, each as long as its share w / tau; those that cover a mark, one for each unit of length, are taken and
    stand for tau. So the sample has k rows and the total is exact. Lengths are added up by buckets of the order, then within.
    Rows whose weight is null are left out; weights must be finite and above zero. Merging: sample the union of two
    samples by ``out``.
    """
    guards.positive("k", k)
    w = F.col(weight).cast("double")
    bad = (w <= 0) | F.isnan(w) | (w == float("inf"))
    rows = df.where(F.col(weight).isNotNull()).withColumn("__w", F.when(bad, F.raise_error(F.lit("weights must be finite and above zero"))).otherwise(w))
    n, total = rows.agg(F.count("*"), F.sum("__w")).first()
    if n <= k:
        return rows.withColumn(out, F.col("__w")).drop("__w")
    top = [r["__w"] for r in rows.select("__w").orderBy(F.col("__w").desc()).limit(k).collect()]  # k numbers
    rest, t = total, 0
    while t < k - 1 and top[t] * (k - t) >= rest:
        rest -= top[t]
        t += 1
    tau = rest / (k - t)
    heavy = top[t - 1] if t else math.inf
    named = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    light = rows.where(F.col("__w") < heavy).withColumn("__key", named)
    light = light.withColumn("__bucket", F.pmod(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    sums = light.groupBy("__bucket").agg(F.sum("__w").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select(F.col("__bucket").alias("__b"), before.alias("__before"))  # ``buckets`` rows
    inside = F.coalesce(F.sum("__w").over(Window.partitionBy("__bucket").orderBy("__key", id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    light = light.withColumn("__in", inside).join(F.broadcast(sums), F.col("__bucket") == F.col("__b"))
    from_ = (F.col("__before") + F.col("__in")) / tau
    start = int.from_bytes(str(seed).encode(), "little") % 1009 / 1009 * 0.998 + 0.001
    marks = F.floor(from_ + F.col("__w") / tau + start) - F.floor(from_ + start)
    light = light.where(marks > 0).withColumn(out, F.lit(tau)).select(*df.columns, out)
    if not t:
        return light
    return rows.where(F.col("__w") >= heavy).withColumn(out, F.col("__w")).select(*df.columns, out).unionByName(light)


def merge_samples(a: DataFrame, b: DataFrame, k: int, id_col: str, seed: int = 1, out: str = "adjusted") -> DataFrame:
    """One sample of at most k rows from two, whose rows stand for the weights ``out``: the total of both is kept."""
    both = a.unionByName(b).withColumnRenamed(out, "__stood")
    return var_opt(both, "__stood", k, id_col, seed, out).drop("__stood")


def estimate_subset(sample: DataFrame, predicate: str, out: str = "adjusted") -> DataFrame:
    """The weight of the rows for which ``predicate`` (SQL) holds, in one row."""
    return sample.where(predicate).agg(F.coalesce(F.sum(out), F.lit(0.0)).alias("weight"))
