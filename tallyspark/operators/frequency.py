"""How often keys come: Count-Min and its relatives, and the most frequent keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards, hashing, sizing
from .cells import Sketch
from .membership import with_place


def _columns(hi: Column, lo: Column, width: int, depth: int) -> Column:
    """(row, col) of a key: by double hashing."""
    at = lambda i: (lo + hi * i).bitwiseAND(F.lit(hashing.MASK32).cast("long")) % width
    return F.array(*[F.struct(F.lit(i).alias("row"), at(i).alias("col")) for i in range(depth)])


class CountMinSketch(Sketch):
    """Cells (row, col, cnt). Estimates are never below the truth, and above it by at most epsilon n for most keys."""

    KEYS = ("row", "col")
    FOLD = (("cnt", "sum"),)
    KIND = "count_min"

    @classmethod
    def sized(cls, epsilon: float, delta: float, hash_name: str = "md5") -> dict:
        width, depth = sizing.count_min_shape(epsilon, delta)
        return {"width": width, "depth": depth, "hash": hash_name}

    @classmethod
    def placed(cls, df: DataFrame, key: str, spec: dict) -> DataFrame:
        hi, lo = hashing.words(F.col(key), spec["hash"])
        rows = df.withColumn("__hi", hi).withColumn("__lo", lo)
        return rows.withColumn("__c", F.explode(_columns(F.col("__hi"), F.col("__lo"), spec["width"], spec["depth"]))).select(*df.columns, "__c.row", "__c.col")

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), weight: str | None = None) -> CountMinSketch:
        """Keys are counted first, so each distinct key is hashed and spread once."""
        n = F.sum(F.col(weight)) if weight else F.count("*")
        keys = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(n.alias("cnt"))
        rows = cls.placed(keys, key, spec).select(*by, "row", "col", "cnt")
        return cls(spec, cls.fold(rows, by), by)

    def fold_rows(self, estimates: DataFrame, key: str, out: str) -> DataFrame:
        return estimates.groupBy(*self.by, key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias(out))

    def estimate(self, keys: DataFrame, key: str, out: str = "estimate") -> DataFrame:
        """(by, key, estimate) of the distinct keys; the cells are as many as width times depth and are joined."""
        asked = keys.where(F.col(key).isNotNull()).select(*self.by, key).distinct()
        rows = self.placed(asked, key, self.spec).join(self.cells, [*self.by, "row", "col"], "left")
        return self.fold_rows(rows, key, out)

    def total(self) -> DataFrame:
        return self.cells.where("row = 0").groupBy(*self.by).agg(F.sum("cnt").alias("n"))


class CountSketch(CountMinSketch):
    """Cells (row, col, cnt) with signs: estimates are the median of the rows and err to both sides."""

    KIND = "count_sketch"

    @classmethod
    def sized(cls, epsilon: float, delta: float, hash_name: str = "md5") -> dict:
        width, depth = sizing.count_sketch_shape(epsilon, delta)
        return {"width": width, "depth": depth, "hash": hash_name}

    @classmethod
    def placed(cls, df: DataFrame, key: str, spec: dict) -> DataFrame:
        """Each row has a hash of its own, of the row's number before the key."""
        def one(i: int) -> Column:
            hi, lo = hashing.words(F.concat(F.lit(f"{i}:"), F.col(key).cast("string")), spec["hash"])
            return F.struct(F.lit(i).alias("row"), (hi % spec["width"]).alias("col"), (1 - 2 * (lo % 2)).alias("sign"))

        rows = df.withColumn("__c", F.explode(F.array(*[one(i) for i in range(spec["depth"])])))
        return rows.select(*df.columns, "__c.row", "__c.col", "__c.sign")

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), weight: str | None = None) -> CountSketch:
        n = F.sum(F.col(weight)) if weight else F.count("*")
        keys = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(n.alias("cnt"))
        rows = cls.placed(keys, key, spec).select(*by, "row", "col", (F.col("cnt") * F.col("sign")).alias("cnt"))
        return cls(spec, cls.fold(rows, by), by)

    def fold_rows(self, estimates: DataFrame, key: str, out: str) -> DataFrame:
        """The median; of an even number of rows the mean of the middle two, towards zero."""
        a = F.sort_array(F.collect_list(F.coalesce("cnt", F.lit(0)) * F.col("sign")))
        d = self.spec["depth"]
        rows = estimates.groupBy(*self.by, key).agg(a.alias("__a"))
        middle = F.col("__a")[d // 2] if d % 2 else F.expr(f"(__a[{d // 2 - 1}] + __a[{d // 2}]) div 2")
        return rows.select(*self.by, key, middle.cast("long").alias(out))


class SublimeCountMinSketch(Sketch):
    """A Count-Min sketch that doubles its width as keys come. Cells (epoch, row, col, cnt).

    When the number of keys reaches the width to the power 1 / growth, each row is copied into a new half. A counter so
    begins with the counts of the one it was copied from; that is the sum over the epochs of the cells the key had in each, by its
    column modulo the epoch's width. No cell is ever copied.
    """

    KEYS = ("epoch", "row", "col")
    FOLD = (("cnt", "sum"),)
    KIND = "sublime"

    @staticmethod
    def sized(depth: int = 4, width: int = 64, growth: float = 0.5, factor: float = 1.0, hash_name: str = "md5") -> dict:
        guards.power_of_two("width", width)
        guards.positive("growth", growth)
        guards.positive("factor", factor)
        return {"depth": depth, "width": width, "growth": growth, "factor": factor, "hash": hash_name}

    @staticmethod
    def limit(spec: dict, width: int) -> int:
        return math.ceil((width * spec["factor"]) ** (1 / spec["growth"]))

    @classmethod
    def shrinks_below(cls, spec: dict, epoch: int) -> int:
        """The number of keys below which an epoch ends again: the middle between the limits of a half and a quarter of its width."""
        half = spec["width"] << (epoch - 1)
        return cls.limit(spec, half) // 2 + cls.limit(spec, max(1, half // 2)) // 2

    @staticmethod
    def limits(spec: dict, n: int) -> list[int]:
        """Numbers of keys at which the width doubles, up to n."""
        out, width = [], spec["width"]
        while (limit := SublimeCountMinSketch.limit(spec, width)) <= n:
            out.append(max(limit, out[-1] + 1 if out else limit))
            width *= 2
        return out

    @classmethod
    def build(cls, df: DataFrame, key: str, order: str, spec: dict) -> SublimeCountMinSketch:
        rows = with_place(df.where(F.col(key).isNotNull()).select(*{key: 0, order: 0}), order)
        limits = cls.limits(spec, rows.count())
        epoch = F.lit(0)
        for e, limit in enumerate(limits):
            epoch = F.when(F.col("place") >= limit, F.lit(e + 1)).otherwise(epoch)
        keys = rows.withColumn("epoch", epoch).groupBy("epoch", key).agg(F.count("*").alias("cnt"))
        spec = spec | {"epochs": len(limits) + 1}
        return cls(spec, cls.fold(cls.placed(keys, key, spec).select("epoch", "row", "col", "cnt"), ()))

    @classmethod
    def placed(cls, df: DataFrame, key: str, spec: dict) -> DataFrame:
        hi, lo = hashing.words(F.col(key), spec["hash"])
        mask = hashing.shl(F.lit(spec["width"]).cast("long"), F.col("epoch")) - 1
        at = lambda i: (F.col("__lo") + F.col("__hi") * i).bitwiseAND(mask)
        rows = df.withColumn("__hi", hi).withColumn("__lo", lo)
        rows = rows.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(i).alias("row"), at(i).alias("col")) for i in range(spec["depth"])])))
        return rows.select(*df.columns, "__c.row", "__c.col")

    def estimate(self, keys: DataFrame, key: str, out: str = "estimate") -> DataFrame:
        asked = keys.where(F.col(key).isNotNull()).select(key).distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(self.spec["epochs"] - 1))))
        rows = self.placed(asked, key, self.spec).join(self.cells, ["epoch", "row", "col"], "left")
        sums = rows.groupBy(key, "row").agg(F.greatest(F.sum(F.coalesce("cnt", F.lit(0))), F.lit(0)).alias("cnt"))
        return sums.groupBy(key).agg(F.min("cnt").alias(out))

    def total(self) -> int:
        """The number of keys held."""
        return self.cells.where("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]

    def remove(self, df: DataFrame, key: str) -> SublimeCountMinSketch:
        """Take the keys of ``df`` out, as often as they come: they are counted down in the last epoch. Keys that were never added leave
        counts too low. The sketch then contracts as far as the keys that are left allow."""
        last = self.spec["epochs"] - 1
        keys = df.where(F.col(key).isNotNull()).groupBy(key).agg((-F.count("*")).alias("cnt")).withColumn("epoch", F.lit(last))
        gone = self.placed(keys, key, self.spec).select("epoch", "row", "col", "cnt")
        return self.like(self.fold(self.cells.select(*gone.columns).unionAll(gone), ())).contracted()

    def contracted(self) -> SublimeCountMinSketch:
        """Without the epochs whose width is no longer called for.

        A row that folds back in half keeps what both halves gathered since they were doubled. These are the cells of the last epoch,
        which go to the epoch before by their column modulo its width.
        """
        n = self.total()
        left = self.spec["epochs"] - 1
        while left and n < self.shrinks_below(self.spec, left):
            left -= 1
        if left == self.spec["epochs"] - 1:
            return self
        epoch = F.least("epoch", F.lit(left))
        col = F.col("col").bitwiseAND(hashing.shl(F.lit(self.spec["width"]).cast("long"), epoch) - 1)
        cells = self.fold(self.cells.select(epoch.alias("epoch"), "row", col.alias("col"), "cnt"), ())
        return SublimeCountMinSketch(self.spec | {"epochs": left + 1}, cells)


def top_k(df: DataFrame, key: str, k: int, spec: dict) -> DataFrame:
    """(key, estimate) of the k most frequent keys by a Count-Min sketch, ties by key. Every distinct key is scored."""
    guards.positive("k", k)
    made = CountMinSketch.build(df, key, spec)
    return made.estimate(df, key).orderBy(F.col("estimate").desc(), F.col(key).asc()).limit(k)


def merge_top_k(a: CountMinSketch, b: CountMinSketch, keys: DataFrame, key: str, k: int) -> DataFrame:
    """(key, estimate) of the k most frequent of ``keys`` in two streams together, from their merged sketches; ties by key.

    ``keys`` are the candidates, as both sides' distinct keys or their own lists of frequent ones."""
    guards.positive("k", k)
    return a.merge(b).estimate(keys, key).orderBy(F.col("estimate").desc(), F.col(key).asc()).limit(k)


class PrivateCountMinSketch(CountMinSketch):
    """A Count-Min sketch under rho-zCDP: every cell begins with Gaussian noise of variance depth / rho."""

    KIND = "private_count_min"

    @classmethod
    def sized(cls, epsilon: float, delta: float, rho: float, seed: int, hash_name: str = "md5") -> dict:
        guards.positive("rho", rho)
        return CountMinSketch.sized(epsilon, delta, hash_name) | {"rho": rho, "seed": seed}

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), weight: str | None = None) -> PrivateCountMinSketch:
        """All cells exist, those without keys too, since an absent one would tell that no key came."""
        if by:
            raise ValueError("noise is drawn for one sketch; build one for each group")
        true = CountMinSketch.build(df, key, spec, by, weight).cells
        spark = df.sparkSession
        every = spark.range(spec["width"] * spec["depth"]).select((F.col("id") % spec["depth"]).cast("int").alias("row"), F.floor(F.col("id") / spec["depth"]).cast("long").alias("col"), "id")
        noise = gaussian(F.concat(F.lit(f"{spec['seed']}:"), F.col("id").cast("string"))) * math.sqrt(spec["depth"] / spec["rho"])
        cells = every.withColumn("noise", noise).join(true, ["row", "col"], "left")
        return cls(spec, cells.select("row", "col", (F.coalesce("cnt", F.lit(0)) + F.col("noise")).alias("cnt")), by)

    def fold_rows(self, estimates: DataFrame, key: str, out: str) -> DataFrame:
        return estimates.groupBy(*self.by, key).agg(F.min("cnt").alias(out))

    @staticmethod
    def epsilon(rho: float, delta: float) -> float:
        return sizing.zcdp_epsilon(rho, delta)


class WindowSketch:
    """Counts in the last ``window`` keys of a stream, with the privacy budget shared by segments of the stream.

    The stream is cut in sub-streams of ceil(window^beta) keys. Each has a segment of all its keys and, for checkpoints that
    thin out geometrically, segments from its start and to its end. A query adds up, for each sub-stream that the
    window touches, the segment within the window that begins first, the longer of two. Noise of a segment has the variance of its
    share of the budget; without a budget the counts are plain.
    """

    @staticmethod
    def sized(window: int, alpha: float = 0.5, beta: float = 0.7, width: int = 512, depth: int = 5, hash_name: str = "md5") -> dict:
        guards.positive("window", window)
        guards.fraction("alpha", alpha)
        guards.fraction("beta", beta)
        return {"window": window, "alpha": alpha, "size": math.ceil(window**beta), "width": width, "depth": depth, "hash": hash_name}

    @staticmethod
    def segments(spec: dict) -> list[tuple[int, int, float]]:
        """(first, end, share of the budget) within a sub-stream: all of it, and the pieces before and after each checkpoint."""
        size, alpha = spec["size"], spec["alpha"]
        out, at, j = {(0, size): 2 * alpha - alpha**2}, float(size), 2
        while at > 1:
            at *= 1 - alpha
            cut = math.floor(at)
            if 0 < cut < size:
                for piece in ((0, cut), (size - cut, size)):
                    out.setdefault(piece, alpha ** (j - 2) * (1 - alpha) ** 3 / 2)
                j += 1
        return sorted((a, b, x) for (a, b), x in out.items())

    @classmethod
    def chosen(cls, spec: dict, n: int) -> list[tuple[int, int, float]]:
        """The pieces of the stream, as (first, end, share), that a query after n keys adds up."""
        out, low = [], max(0, n - spec["window"])
        size = spec["size"]
        for s in range(low // size, (n - 1) // size + 1):
            live = [(s * size + a, min(s * size + b, n), x) for a, b, x in cls.segments(spec) if s * size + a >= low and (s * size + b <= n or a == 0)]
            if live:
                out.append(min(live, key=lambda x: (x[0], -x[1])))
        return out

    @classmethod
    def estimate(cls, df: DataFrame, key: str, order: str, spec: dict, out: str = "estimate", rho: float | None = None, seed: int = 0) -> DataFrame:
        """(key, estimate) for the keys of the pieces that a query at the stream's end adds up.

        With ``rho``, a cell's noise is a function of the seed and the cell, so only the cells asked for are drawn.
        """
        rows = with_place(df.where(F.col(key).isNotNull()).select(*{key: 0, order: 0}), order)
        pieces = cls.chosen(spec, rows.count())
        if not pieces:
            return rows.select(key, F.lit(0.0 if rho else 0).alias(out))
        which, share = F.lit(None).cast("int"), F.lit(1.0)
        for i, (a, b, x) in enumerate(pieces):
            which = F.when((F.col("place") >= a) & (F.col("place") < b), F.lit(i)).otherwise(which)
            share = F.when(F.col("segment") == i, F.lit(x)).otherwise(share)
        live = rows.withColumn("segment", which).where("segment is not null")
        made = CountMinSketch.build(live, key, {k: spec[k] for k in ("width", "depth", "hash")}, ("segment",))
        every = live.select(key).distinct().withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(len(pieces) - 1))))
        cells = made.placed(every, key, made.spec).join(made.cells, ["segment", "row", "col"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        if rho is not None:
            guards.positive("rho", rho)
            name = F.concat_ws(":", F.lit(str(seed)), F.col("segment").cast("string"), F.col("row").cast("string"), F.col("col").cast("string"))
            cells = cells.withColumn("cnt", F.col("cnt") + gaussian(name) * F.sqrt(F.lit(float(spec["depth"])) / (share * rho)))
        return cells.groupBy("segment", key).agg(F.min("cnt").alias("cnt")).groupBy(key).agg(F.sum("cnt").alias(out))

    @classmethod
    def heavy_hitters(cls, df: DataFrame, key: str, order: str, share: float, spec: dict, **noise: float) -> DataFrame:
        guards.fraction("share", share)
        n = df.where(F.col(key).isNotNull()).count()
        return cls.estimate(df, key, order, spec, **noise).where(F.col("estimate") >= share * min(spec["window"], n)).orderBy(F.col("estimate").desc(), key)


def gaussian(name: Column) -> Column:
    """A draw from N(0, 1) that is a function of the name."""
    unit = lambda side: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{side}:"), name)), 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52 + 1)
    return F.sqrt(-2 * F.log(unit("a"))) * F.cos(2 * math.pi * unit("b"))


def sliding_counts(df: DataFrame, key: str, order: str, window: int, out: str = "seen") -> DataFrame:
    """Exact neighbour: how often the row's key came among the ``window`` rows up to it."""
    placed = with_place(df, order)
    w = Window.partitionBy(key).orderBy("place").rangeBetween(-(window - 1), 0)
    return placed.withColumn(out, F.count("*").over(w))
