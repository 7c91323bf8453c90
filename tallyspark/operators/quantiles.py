"""Quantiles of a bounded relative error: DDSketch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards
from .cells import Sketch


class DDSketch(Sketch):
    """Cells (sign, bucket, cnt, low, high): values by the logarithm of their size, zeros in a cell of their own."""

    KEYS = ("sign", "bucket")
    FOLD = (("cnt", "sum"), ("low", "min"), ("high", "max"))
    KIND = "ddsketch"

    @staticmethod
    def sized(accuracy: float) -> dict:
        guards.fraction("accuracy", accuracy)
        return {"accuracy": accuracy}

    @staticmethod
    def gamma(spec: dict) -> float:
        return (1 + spec["accuracy"]) / (1 - spec["accuracy"])

    @classmethod
    def build(cls, df: DataFrame, value: str, spec: dict, by: tuple[str, ...] = ()) -> DDSketch:
        """Nulls are left out; NaN and infinities are refused when they are read."""
        x = F.col(value).cast("double")
        bad = F.isnan(x) | (F.abs(x) == float("inf"))
        x = F.when(bad, F.raise_error(F.lit("values must be finite"))).otherwise(x)
        rows = df.where(F.col(value).isNotNull()).select(*by, x.alias("x"))
        bucket = F.when(F.col("x") == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs("x")) / F.lit(math.log(cls.gamma(spec)))))
        rows = rows.select(*by, F.signum("x").cast("int").alias("sign"), bucket.cast("long").alias("bucket"), F.lit(1).cast("long").alias("cnt"), F.col("x").alias("low"), F.col("x").alias("high"))
        return cls(spec, cls.fold(rows, by), by)

    def value(self) -> Column:
        g = self.gamma(self.spec)
        return F.col("sign") * F.when(F.col("sign") == 0, 0.0).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))

    def quantiles(self, qs: list[float]) -> DataFrame:
        """(by, q, sign, bucket, value): of each group the first bucket whose running count exceeds q (n - 1).

        A group has as many rows as buckets, a few thousand at most, so the window is over cells, not values.
        """
        for q in qs:
            guards.within("q", 0 if 0 <= q <= 1 else -1, 0, 0)
        w = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        order = w.orderBy("sign", F.col("sign") * F.col("bucket"))
        rows = self.cells.withColumn("upto", F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("cnt").over(w))
        rows = rows.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        rank = F.col("q") * (F.col("n") - 1)
        hit = (F.col("upto") > rank) & (F.col("upto") - F.col("cnt") <= rank)
        return rows.where(hit).select(*self.by, "q", "sign", "bucket", self.value().alias("value"))

    def summary(self) -> DataFrame:
        """(by, n, low, high): exact."""
        return self.cells.groupBy(*self.by).agg(F.sum("cnt").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
