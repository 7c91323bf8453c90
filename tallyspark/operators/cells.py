"""A sketch as a relation: rows of cells that are built, merged and rolled up by one associative fold.

Partial aggregation builds the cells of each partition, the exchange moves cells and not rows, the final aggregate is the merge.
So merging the sketches of two tables gives the cells of their union, a sketch by group is the same with more keys, and
dropping a group column folds once more.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import shl

#: Bits of a filter that may be sent whole to every executor; beyond, probes are joined to the cells.
BROADCAST_BITS = 1 << 27


@dataclass(frozen=True)
class Sketch:
    """``cells`` has the columns ``by``, KEYS and those of FOLD; ``spec`` are the numbers that must agree to merge."""

    spec: dict
    cells: DataFrame
    by: tuple[str, ...] = ()

    KEYS = ()
    FOLD = ()  # (column, name of an aggregate function)
    KIND = "sketch"

    @classmethod
    def folds(cls) -> list[Column]:
        return [getattr(F, f)(c).alias(c) for c, f in cls.FOLD]

    @classmethod
    def fold(cls, rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return rows.groupBy(*by, *cls.KEYS).agg(*cls.folds()) if cls.FOLD else rows.select(*by, *cls.KEYS).distinct()

    def combined(self, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """Cells of several sketches of this spec as those of one; kinds that clamp or trim do so here."""
        return self.fold(cells, by)

    def like(self, cells: DataFrame) -> Sketch:
        return replace(self, cells=cells)

    def merge(self, other: Sketch) -> Sketch:
        if type(other) is not type(self) or other.spec != self.spec or other.by != self.by:
            raise ValueError(f"can't merge {self.KIND} {self.spec} {self.by} with {other.KIND} {other.spec} {other.by}")
        return self.like(self.combined(self.cells.unionByName(other.cells), self.by))

    def rollup(self, *by: str) -> Sketch:
        """The sketch by fewer group columns."""
        if not set(by) <= set(self.by):
            raise ValueError(f"{by} are not all among {self.by}")
        return replace(self, cells=self.combined(self.cells, by), by=by)

    def reset(self) -> Sketch:
        return self.like(self.cells.limit(0))

    def write(self, path: str) -> None:
        """Cells as Parquet, and the numbers beside them."""
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        head = json.dumps({"kind": self.KIND, "spec": self.spec, "by": list(self.by)})
        self.cells.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Sketch:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        if head["kind"] != cls.KIND:
            raise ValueError(f"{path} holds a {head['kind']}, not a {cls.KIND}")
        return cls(head["spec"], spark.read.parquet(f"{path}/cells"), tuple(head["by"]))


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` to be joined by an exchange of both sides, for what grows with the input. By its packed size Spark would call it small
    and build it as a hash table on the driver, where it is many times as large."""
    return rows.hint("merge")


def bit_words(rows: DataFrame, by: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """Bits set at ``pos`` as (by, word, mask), 64 to a word: cells are few and fold with bit_or."""
    bit = shl(F.lit(1).cast("long"), F.col(pos).bitwiseAND(F.lit(63).cast("long")))
    return rows.select(*by, F.shiftright(F.col(pos), 6).alias("word"), bit.alias("mask")).groupBy(*by, "word").agg(F.bit_or("mask").alias("mask"))


def bit_positions(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The set bits, one row each."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    return cells.select(*by, "word", F.explode(bits).alias("i")).select(*by, (F.col("word") * 64 + F.col("i")).alias("pos"))


def dense_words(cells: DataFrame, bits: int) -> DataFrame:
    """One row: the words of the whole filter in order."""
    n = (bits + 63) // 64
    spark = cells.sparkSession
    every = spark.range(n).withColumnRenamed("id", "word").join(cells.select("word", "mask"), "word", "left")
    packed = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("w"))
    return packed.select(F.col("w.mask").alias("words"))


def all_bits_set(words: Column, positions: list[Column]) -> Column:
    test = F.lit(True)
    for p in positions:
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        test = test & (F.call_function("getbit", word, p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return test
