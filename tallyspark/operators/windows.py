"""Any mergeable sketch over a sliding window of time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from .cells import Sketch


class SlidingWindow:
    """A sketch for each bucket of time; a window is the merge of the last N buckets, the current one among them.

    Buckets are of event time (from the epoch on), so a late row goes to the bucket of its own time.
    """

    def __init__(self, seconds: int, buckets: int) -> None:
        guards.positive("seconds", seconds)
        guards.within("buckets", buckets, 1, 1 << 20)
        self.width, self.buckets = max(1, seconds // buckets), buckets

    def bucket(self, ts: Column) -> Column:
        return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(self.width * 1_000_000)).cast("long")

    def build(self, kind: type[Sketch], df: DataFrame, ts: str, key: str, spec: dict, by: tuple[str, ...] = ()) -> Sketch:
        """A sketch by bucket and the other columns of ``by``."""
        rows = df.where(F.col(ts).isNotNull()).withColumn("bucket", self.bucket(F.col(ts)))
        return kind.build(rows, key, spec, ("bucket", *by))

    def merged(self, sketch: Sketch) -> Sketch:
        """The sketch of the window that ends with each bucket: cells go to the windows they are in, and merge as the sketch
        does."""
        ends = F.explode(F.sequence(F.col("bucket"), F.col("bucket") + self.buckets - 1))
        live = sketch.cells.select("bucket").distinct()
        cells = sketch.cells.withColumn("__end", ends).drop("bucket").withColumnRenamed("__end", "bucket").join(live, "bucket", "left_semi")
        return replace(sketch, cells=sketch.combined(cells, sketch.by))

    def at(self, sketch: Sketch, end_bucket: int) -> Sketch:
        """The sketch of one window, without the bucket."""
        cells = sketch.cells.where(F.col("bucket").between(end_bucket - self.buckets + 1, end_bucket))
        by = tuple(b for b in sketch.by if b != "bucket")
        return replace(sketch, cells=sketch.combined(cells, by), by=by)


