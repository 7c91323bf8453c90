"""Shared pieces of the training-data operators: lineage cuts, scratch tables, column handling, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import scratch


shared_folder = scratch


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy; Spark's cleaner removes it when nothing refers to it."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one call in the shared folder. They are read from their files, so Spark plans with their true sizes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{scratch(spark)}/scratch-{uuid.uuid4().hex}"
        self.numbers = itertools.count()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.folder)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{next(self.numbers)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for name in {name.rpartition("/")[0] for t in tables for name in t.inputFiles()}:
            remove(self.spark, name)


BATCH_BYTES = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """Let batches to Python hold no more than BATCH_BYTES (or one row); a smaller bound of the session's stays.

    The bound is a setting of the session, which is only ever lowered: it changes how rows travel, not what they are.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(key)).removesuffix("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def released(f):  # noqa: ANN001, ANN201
    """A function over batches that, at the end of its task, gives the worker's free memory back to the machine."""

    @functools.wraps(f)
    def run(batches):  # noqa: ANN001, ANN202
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Return this process's free memory to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def runs_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, one table after the other, from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        columns = [b.column(k).to_pylist() for k in keys]
        at = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > at:
                    held.append(b.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, key
        if b.num_rows > at:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add (names compare without case, as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_of(df: DataFrame, *names: str) -> Column:
    """The columns of ``df`` but ``names`` in one struct, so that no name of theirs can meet one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in without(df, *names).columns]).alias("row")


def text_of(col: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Connected components of the edge list (a, b): rows (node, root) for every node that has an edge to another.

    The root is one node of the component. In each round every node hooks to the neighbour whose hash is the smallest, if that is
    smaller than its own; two jumps shorten the paths, and the edges are contracted. In the order of a hash at
    least half of the nodes hook, however ids run along a chain, so rounds grow with the logarithm of the
    component. Each round works on tables read from files: estimates of sizes start anew, and as both sides of each
    join are shuffled or broadcast by size, AQE can split hot nodes. ``rounds`` gets the number of edges of each round.
    """
    spark = edges.sparkSession
    with Scratch(spark) as s:
        e = s.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        maps: list[DataFrame] = []
        while n := e.count():
            if rounds is not None:
                rounds.append(n)
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
            before = F.struct(F.xxhash64("v"), "v") < F.struct(F.xxhash64("u"), "u")
            hook = s.table(least.select("u", F.when(before, F.col("v")).otherwise(F.col("u")).alias("p")))
            up = hook.select(F.col("u").alias("q"), F.col("p").alias("p2"))
            jumped = hook.join(up, F.col("p") == F.col("q")).select("u", F.col("p2").alias("p"))
            maps.append(s.table(jumped.join(up, F.col("p") == F.col("q")).select("u", F.col("p2").alias("p"))))
            fa, fb = (maps[-1].select(F.col("u").alias(f"u{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
            near = e.join(fa, F.col("a") == F.col("ua")).select("pa", "b").join(fb, F.col("b") == F.col("ub"))
            spent, e = e, s.table(near.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
            s.drop(spent, hook)
        if not maps:
            return spark.createDataFrame([], e.withColumnsRenamed({"a": "node", "b": "root"}).schema)
        out = maps[-1]  # from the last map, the smallest, to the first
        for m in reversed(maps[:-1]):
            later = out.select(F.col("u").alias("q"), F.col("p").alias("p2"))
            out = s.table(m.join(later, F.col("p") == F.col("q"), "left").select("u", F.coalesce("p2", "p").alias("p")))
        return cut(out.select(F.col("u").alias("node"), F.col("p").alias("root")))
