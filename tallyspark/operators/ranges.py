"""Filters over ordered keys: may there be a key in this range?

Range probes never scan the cells: cells and probes are dealt to buckets at least as wide as the widest range, so a range
touches two buckets at most and the join is by equality.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards, hashing
from .cells import Sketch, apart
from .membership import with_place

P61 = (1 << 61) - 1


class Grafite(Sketch):
    """Cells (code): keys hashed by a function that keeps neighbours of a block of r keys together.

    A range of at most ``length`` keys that holds none is answered rightly with chance 1 - epsilon, whatever the keys are.
    """

    KEYS = ("code",)
    KIND = "grafite"

    @staticmethod
    def sized(n: int, length: int, epsilon: float, seed: int = 1) -> dict:
        guards.positive("n", n)
        guards.positive("length", length)
        guards.fraction("epsilon", epsilon)
        random = hashing.SplitMix64(seed)
        r = min(max(math.ceil(n * length / epsilon), 2), (1 << 61) - 2)
        return {"n": n, "r": r, "length": length, "c1": 1 + random.below(P61 - 1), "c2": random.below(P61)}

    @staticmethod
    def code(spec: dict, key: Column) -> Column:
        d = lambda c: c.cast("decimal(38,0)")
        block = F.call_function("div", key, F.lit(spec["r"]).cast("long"))
        h = (d(F.lit(spec["c1"]).cast("decimal(19,0)")) * d(block) + d(F.lit(spec["c2"]).cast("decimal(19,0)"))) % d(F.lit(P61).cast("decimal(19,0)"))
        return ((h + d(key)) % d(F.lit(spec["r"]).cast("decimal(19,0)"))).cast("long")

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> Grafite:
        rows = df.where(F.col(key).isNotNull()).select(*by, cls.code(spec, F.col(key).cast("long")).alias("code"))
        return cls(spec, rows.distinct(), by)

    def false_positive_rate(self, size: int) -> float:
        """The chance that a range of ``size`` keys that holds none is said to hold one."""
        guards.positive("size", size)
        return min(1.0, self.cells.count() * size / self.spec["r"])

    def may_hold(self, ranges: DataFrame, low: str, high: str, out: str = "may_hold") -> DataFrame:
        """``ranges`` with ``out``. A range as wide as the code space may always hold a key; one with high < low never."""
        r, names = self.spec["r"], [*self.by, low, high]
        asked = ranges.select(*names).distinct()
        lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
        block = lambda c: F.call_function("div", c, F.lit(r).cast("long"))
        span = lambda a, b: F.struct(self.code(self.spec, a).alias("a"), self.code(self.spec, b).alias("b"))
        last = block(lo) * r + (r - 1)
        parts = F.when(block(lo) == block(hi), F.array(span(lo, hi))).otherwise(F.array(span(lo, last), span(last + 1, hi)))
        pieces = asked.where((hi >= lo) & (hi - lo < r - 1)).withColumn("__s", F.explode(parts))
        wrap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        a, b = F.col("__s.a"), F.col("__s.b")
        flat = F.when(a <= b, F.array(wrap(a, b))).otherwise(F.array(wrap(a, F.lit(r - 1).cast("long")), wrap(F.lit(0).cast("long"), b)))
        pieces = pieces.withColumn("__s", F.explode(flat))
        width = max(self.spec["length"], 1024)
        bucket = lambda c: F.call_function("div", c, F.lit(width).cast("long"))
        pieces = pieces.withColumn("__b", F.explode(F.sequence(bucket(F.col("__s.a")), bucket(F.col("__s.b")))))
        cells = self.cells.withColumn("__b", bucket(F.col("code")))
        hit = pieces.join(apart(cells), [*self.by, "__b"]).where(F.col("code").between(F.col("__s.a"), F.col("__s.b"))).select(*names).distinct().withColumn("__hit", F.lit(True))
        full = (hi - lo) >= r - 1
        return ranges.join(apart(hit), names, "left").withColumn(out, F.when(hi < lo, F.lit(False)).when(full, F.lit(True)).otherwise(F.coalesce("__hit", F.lit(False)))).drop("__hit")


class InfiniFilter(Sketch):
    """A filter that doubles as keys come. Cells (width, value, cnt).

    A key that comes while there are 2^q slots keeps the low q + f bits of its hash for good: of those, more and more become
    address and fewer fingerprint as the filter doubles. So the cells hold for each width the values of that many bits, and
    a key may be there if its hash has one of them. The filter doubles when three quarters of the slots are taken.
    """

    KEYS = ("width", "value")
    FOLD = (("cnt", "sum"),)
    KIND = "infini"
    LOAD = 0.75

    @staticmethod
    def sized(capacity: int = 1024, fingerprint: int = 8, hash_name: str = "md5") -> dict:
        guards.positive("capacity", capacity)
        guards.within("fingerprint", fingerprint, 1, 32)
        return {"q": max(1, math.ceil(math.log2(capacity))), "f": fingerprint, "hash": hash_name}

    @classmethod
    def widths(cls, spec: dict, n: int) -> list[tuple[int, int]]:
        """(first place, width) of the steps that n keys take."""
        out, q, at = [], spec["q"], 0
        while True:
            out.append((at, min(62, q + spec["f"])))
            at = math.ceil(cls.LOAD * (1 << q))
            if at >= n:
                return out
            q += 1

    @staticmethod
    def low_bits(hi: Column, lo: Column, width: Column) -> Column:
        whole = F.shiftleft(hi.bitwiseAND(F.lit((1 << 30) - 1).cast("long")), 32).bitwiseOR(lo)
        return whole.bitwiseAND(hashing.shl(F.lit(1).cast("long"), width) - 1)

    @classmethod
    def stepped(cls, rows: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        width = F.lit(steps[0][1])
        for first, w in steps[1:]:
            width = F.when(F.col("place") >= first, F.lit(w)).otherwise(width)
        return rows.withColumn("width", width)

    @classmethod
    def build(cls, df: DataFrame, key: str, order: str, spec: dict) -> InfiniFilter:
        rows = with_place(df.where(F.col(key).isNotNull()).select(*{key: 0, order: 0}), order)
        steps = cls.widths(spec, rows.count())
        hi, lo = hashing.words(F.col(key), spec["hash"])
        rows = cls.stepped(rows, steps).select("width", cls.low_bits(hi, lo, F.col("width")).alias("value"), F.lit(1).cast("long").alias("cnt"))
        return cls(spec | {"widths": [w for _, w in steps]}, cls.fold(rows, ()))

    def _asked(self, df: DataFrame, key: str) -> DataFrame:
        hi, lo = hashing.words(F.col(key), self.spec["hash"])
        keys = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("width", F.explode(F.array(*[F.lit(w) for w in sorted(set(self.spec["widths"]))])))
        return keys.withColumn("value", self.low_bits(hi, lo, F.col("width"))).join(apart(self.cells), ["width", "value"])

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        hit = self._asked(df, key).select(key).distinct().withColumn(out, F.lit(True))
        return df.join(apart(hit), key, "left").withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce(out, F.lit(False))))

    @property
    def expansions(self) -> int:
        """How often the filter has doubled."""
        return len(self.spec["widths"]) - 1

    def test_and_remove(self, df: DataFrame, key: str, out: str = "member") -> tuple[DataFrame, InfiniFilter]:
        """``df`` with ``out``, as ``test``, and the filter without the members among its keys."""
        return self.test(df, key, out), self.remove(df, key)

    def remove(self, df: DataFrame, key: str) -> InfiniFilter:
        """Take out one entry for each distinct key that is a member: of those it matches, the one of most bits."""
        best = self._asked(df, key).groupBy(key).agg(F.max_by(F.struct("width", "value"), "width").alias("c"))
        gone = best.groupBy("c.width", "c.value").agg(F.count("*").alias("gone"))
        left = self.cells.join(apart(gone), ["width", "value"], "left").withColumn("cnt", F.col("cnt") - F.coalesce("gone", F.lit(0))).drop("gone")
        return self.like(left.where("cnt > 0"))


class MementoFilter(Sketch):
    """A range filter that grows and forgets. Cells (width, prefix, memento, cnt).

    A key is a prefix and its low bits, the memento. The prefix is kept as an InfiniFilter keeps a key, the memento whole. A
    range of at most ``max_range`` keys touches two prefixes: the end of the one and the beginning of the next.
    """

    KEYS = ("width", "prefix", "memento")
    FOLD = (("cnt", "sum"),)
    KIND = "memento"

    @staticmethod
    def sized(max_range: int, capacity: int = 1024, fingerprint: int = 10, hash_name: str = "md5") -> dict:
        guards.positive("max_range", max_range)
        return InfiniFilter.sized(capacity, fingerprint, hash_name) | {"bits": max(1, math.ceil(math.log2(max_range)))}

    @classmethod
    def _prefix(cls, spec: dict, prefix: Column, width: Column) -> Column:
        return InfiniFilter.low_bits(*hashing.words(prefix, spec["hash"]), width)

    @classmethod
    def build(cls, df: DataFrame, key: str, order: str, spec: dict) -> MementoFilter:
        rows = with_place(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__k"), order), order)
        steps = InfiniFilter.widths(spec, rows.count())
        rows = InfiniFilter.stepped(rows, steps).withColumn("p", F.shiftright("__k", spec["bits"]))
        memento = F.col("__k").bitwiseAND(F.lit((1 << spec["bits"]) - 1).cast("long"))
        rows = rows.select("width", cls._prefix(spec, F.col("p"), F.col("width")).alias("prefix"), memento.alias("memento"), F.lit(1).cast("long").alias("cnt"))
        return cls(spec | {"widths": [w for _, w in steps]}, cls.fold(rows, ()))

    def may_hold(self, ranges: DataFrame, low: str, high: str, out: str = "may_hold") -> DataFrame:
        bits, top = self.spec["bits"], (1 << self.spec["bits"]) - 1
        lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
        asked = ranges.select(low, high).distinct().where(hi >= lo)
        first, last = F.shiftright(lo, bits), F.shiftright(hi, bits)
        asked = asked.withColumn("__p", F.explode(F.sequence(first, last)))
        rest = lambda c: c.bitwiseAND(F.lit(top).cast("long"))
        asked = asked.withColumn("__a", F.when(F.col("__p") == first, rest(lo)).otherwise(F.lit(0))).withColumn("__z", F.when(F.col("__p") == last, rest(hi)).otherwise(F.lit(top)))
        asked = asked.withColumn("width", F.explode(F.array(*[F.lit(w) for w in sorted(set(self.spec["widths"]))])))
        asked = asked.withColumn("prefix", self._prefix(self.spec, F.col("__p"), F.col("width")))
        hit = asked.join(apart(self.cells), ["width", "prefix"]).where(F.col("memento").between(F.col("__a"), F.col("__z"))).select(low, high).distinct().withColumn(out, F.lit(True))
        return ranges.join(apart(hit), [low, high], "left").withColumn(out, F.coalesce(out, F.lit(False)))

    def remove(self, df: DataFrame, key: str) -> MementoFilter:
        """Take out one entry for each distinct key that is there, the one of most bits."""
        k = F.col(key).cast("long")
        keys = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__p", F.shiftright(k, self.spec["bits"])).withColumn("memento", k.bitwiseAND(F.lit((1 << self.spec["bits"]) - 1).cast("long")))
        keys = keys.withColumn("width", F.explode(F.array(*[F.lit(w) for w in sorted(set(self.spec["widths"]))]))).withColumn("prefix", self._prefix(self.spec, F.col("__p"), F.col("width")))
        best = keys.join(apart(self.cells), list(self.KEYS)).groupBy(key).agg(F.max_by(F.struct(*self.KEYS), "width").alias("c"))
        gone = best.groupBy(*[F.col(f"c.{x}").alias(x) for x in self.KEYS]).agg(F.count("*").alias("gone"))
        left = self.cells.join(apart(gone), list(self.KEYS), "left").withColumn("cnt", F.col("cnt") - F.coalesce("gone", F.lit(0))).drop("gone")
        return replace(self, cells=left.where("cnt > 0"))
