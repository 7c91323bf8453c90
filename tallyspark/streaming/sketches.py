"""Sketches of streams: cells by window with a watermark, and duplicates in a state of fixed size.

The cells of a window are an ordinary streaming aggregate, so late rows within the watermark fold into their window, and
what the sink gets can be merged, rolled up and read like the cells of a table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import hashing
from ..operators.cells import Sketch
from ..operators.folds import StableTable


def windowed_cells(stream: DataFrame, kind: type[Sketch], key: str, spec: dict, ts: str, late: str, width: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of ``kind`` by event-time window, as a streaming aggregate: (window, by, keys and folds of the kind).

    Kinds whose cells come from one aggregate over rows can be used: filters by position, counters, registers, quantiles.
    """
    span = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    rows = stream.withWatermark(ts, late).withColumn("window", span)
    return kind.build(rows, key, spec, ("window", *by)).cells


def session_counts(stream: DataFrame, ts: str, late: str, gap: str, by: tuple[str, ...]) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("session"), *by).agg(F.count("*").alias("n"))


def first_of_each(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Exact neighbour of the stable filter: the first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stable_duplicates(stream: DataFrame, key: str, order: str, spec: dict, out: str = "member", seed: int = 1) -> DataFrame:
    """``stream`` with ``out``: whether the stable filter of the key's shard had it. The state is one filter a shard, of
    fixed size however long the stream; rows of a micro-batch are taken by ``order``."""
    names = stream.columns
    rows = stream.where(F.col(key).isNotNull()).withColumn("__shard", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("shard")), F.lit(spec["shards"])).cast("int"))
    rows = rows.withColumn("__bytes", hashing.key_bytes(F.col(key)))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in stream.dtypes), f"`{out}` boolean"])

    def step(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = pickle.loads(state.get[0]) if state.exists else StableTable(spec, seed + shard[0])  # noqa: S301  our own state
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        pdf[out] = [table.test_and_add(bytes(b)) for b in pdf["__bytes"]]
        state.update((pickle.dumps(table),))
        yield pdf[[*names, out]]

    return rows.groupBy("__shard").applyInPandasWithState(step, schema, "table binary", "append", GroupStateTimeout.NoTimeout)
