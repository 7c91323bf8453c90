"""Filters that answer whether a key was added, and the sketches that remember positions."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards, hashing, sizing
from .cells import BROADCAST_BITS, Sketch, all_bits_set, apart, bit_positions, bit_words, dense_words


def kernel_positions(hi: Column, lo: Column, k: int, m: int) -> list[Column]:
    """Probes by double hashing: (lo + hi * i mod 2^32) mod m."""
    return [(lo + hi * i).bitwiseAND(F.lit(hashing.MASK32).cast("long")) % m for i in range(k)]


class BloomFilter(Sketch):
    """Cells (word, mask). No false negatives; a share of about ``fp_rate`` false positives at ``n`` keys."""

    KEYS = ("word",)
    FOLD = (("mask", "bit_or"),)
    KIND = "bloom"

    @classmethod
    def sized(cls, n: int, fp_rate: float, hash_name: str = "md5") -> dict:
        return {"m": sizing.bloom_bits(n, fp_rate), "k": sizing.bloom_probes(fp_rate), "hash": hash_name}

    @classmethod
    def probes(cls, spec: dict, key: Column) -> list[Column]:
        return kernel_positions(*hashing.words(key, spec["hash"]), spec["k"], spec["m"])

    @classmethod
    def bits(cls, spec: dict) -> int:
        return spec["m"]

    @classmethod
    def hashed(cls, df: DataFrame, key: str, spec: dict) -> DataFrame:
        """``df`` with the probes of ``key``; the hash is computed once a row, below the probes. Null keys are left out."""
        return df.where(F.col(key).isNotNull()).withColumn("__p", F.array(*cls.probes(spec, F.col(key))))

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> BloomFilter:
        rows = cls.hashed(df, key, spec).select(*by, F.explode("__p").alias("pos"))
        return cls(spec, bit_words(rows, by), by)

    def positions(self) -> DataFrame:
        return bit_positions(self.cells, self.by)

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        """``df`` with ``out``: whether the key may have been added (null for a null key).

        A filter without groups of at most BROADCAST_BITS is read as one array; else probes meet the words in a join.
        """
        if not self.by and self.bits(self.spec) <= BROADCAST_BITS:
            words = dense_words(self.cells, self.bits(self.spec)).scalar()
            return df.withColumn(out, F.when(F.col(key).isNotNull(), all_bits_set(words, self.probes(self.spec, F.col(key)))))
        # Each distinct key (by group) is probed once, then answers go back to the rows.
        keys = df.where(F.col(key).isNotNull()).select(*self.by, key).distinct()
        probes = self.hashed(keys, key, self.spec).select(*self.by, key, F.explode("__p").alias("pos"))
        probes = probes.withColumn("word", F.shiftright("pos", 6))
        hit = F.call_function("getbit", F.coalesce("mask", F.lit(0).cast("long")), F.col("pos").bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        answers = probes.join(apart(self.cells), [*self.by, "word"], "left").groupBy(*self.by, key).agg(F.bool_and(hit).alias(out))
        return df.join(apart(answers), [*self.by, key], "left")

    def fill_ratio(self) -> DataFrame:
        return self.cells.groupBy(*self.by).agg((F.sum(F.bit_count("mask")) / self.bits(self.spec)).alias("fill_ratio"))

    def estimated_fill(self, count: int) -> float:
        return 1 - math.exp(-count * self.spec["k"] / self.spec["m"])

    @classmethod
    def test_and_add(cls, df: DataFrame, key: str, order: str, spec: dict, out: str = "member") -> DataFrame:
        """``df`` with ``out``: whether the key was a member when its row was added, rows taken by ``order`` (unique).

        A position is set before a row if some row that sets it comes first; so the row is a member if the first setter of
        each of its positions is earlier. After its first row a key is always a member, so only first rows are probed: the distinct
        keys, not the rows, meet at the positions.
        """
        firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__at"))
        rows = cls.hashed(firsts, key, spec).select(key, "__at", F.explode("__p").alias("pos"))
        setters = rows.groupBy("pos").agg(F.min("__at").alias("__first"))
        asked = rows.join(apart(setters), "pos").groupBy(key, "__at").agg((F.max("__first") < F.col("__at")).alias("__was"))
        return df.join(apart(asked), key, "left").withColumn(out, (F.col(order) > F.col("__at")) | F.col("__was")).drop("__at", "__was")


class BloomFilter64(BloomFilter):
    """More than 2^32 bits: probes by two 64-bit hashes, (lo + hi * i mod 2^64) mod m."""

    KIND = "bloom64"

    @classmethod
    def probes(cls, spec: dict, key: Column) -> list[Column]:
        if spec["hash"] == "md5":
            h = F.md5(hashing.key_bytes(key))
            lo, hi = (F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
        else:
            pairs = [hashing.words(key, spec["hash"]), hashing.words(F.concat(F.lit("\x00"), key.cast("string")), spec["hash"])]
            lo, hi = (a.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + b.cast("decimal(20,0)") for a, b in pairs)
        wide = lambda c: c.cast("decimal(38,0)")
        wrap = hashing.whole(1 << 64).cast("decimal(38,0)")
        return [((wide(lo) + wide(hi) * F.lit(i).cast("decimal(6,0)")) % wrap % F.lit(spec["m"]).cast("decimal(38,0)")).cast("long") for i in range(spec["k"])]


class PartitionedBloomFilter(BloomFilter):
    """A slice of bits for each probe; the slice's bits stand after one another."""

    KIND = "partitioned"

    @classmethod
    def sized(cls, n: int, fp_rate: float, hash_name: str = "md5") -> dict:
        k = sizing.bloom_probes(fp_rate)
        return {"m": sizing.bloom_bits(n, fp_rate), "k": k, "slice": math.ceil(sizing.bloom_bits(n, fp_rate) / k), "hash": hash_name}

    @classmethod
    def bits(cls, spec: dict) -> int:
        return spec["slice"] * spec["k"]

    @classmethod
    def probes(cls, spec: dict, key: Column) -> list[Column]:
        hi, lo = hashing.words(key, spec["hash"])
        return [p + i * spec["slice"] for i, p in enumerate(kernel_positions(hi, lo, spec["k"], spec["slice"]))]

    def parts(self) -> DataFrame:
        """(part, pos) of the set bits."""
        return self.positions().select(*self.by, F.floor(F.col("pos") / self.spec["slice"]).cast("int").alias("part"), (F.col("pos") % self.spec["slice"]).alias("pos"))

    def estimated_fill(self, count: int) -> float:
        return 1 - math.exp(-count / self.spec["slice"])


class CountingBloomFilter(Sketch):
    """Cells (pos, cnt): counters of ``bits`` bits that stick at their largest number. Keys can be taken out."""

    KEYS = ("pos",)
    FOLD = (("cnt", "sum"),)
    KIND = "counting"

    @classmethod
    def sized(cls, n: int, fp_rate: float, bits: int = 4, hash_name: str = "md5") -> dict:
        guards.within("bits", bits, 1, 8)
        return BloomFilter.sized(n, fp_rate, hash_name) | {"top": (1 << bits) - 1}

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> CountingBloomFilter:
        """Keys are counted first, so each distinct key is hashed and spread once."""
        keys = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("__n"))
        rows = BloomFilter.hashed(keys, key, spec).select(*by, F.explode("__p").alias("pos"), "__n")
        cells = rows.groupBy(*by, "pos").agg(F.least(F.sum("__n"), F.lit(spec["top"])).alias("cnt"))
        return cls(spec, cells, by)

    def combined(self, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return self.fold(cells, by).withColumn("cnt", F.least("cnt", F.lit(self.spec["top"])))

    def _asked(self, df: DataFrame, key: str) -> DataFrame:
        keys = df.where(F.col(key).isNotNull()).select(*self.by, key).distinct()
        return BloomFilter.hashed(keys, key, self.spec).select(*self.by, key, F.explode(F.array_distinct("__p")).alias("pos")).join(apart(self.cells), [*self.by, "pos"], "left")

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        answers = self._asked(df, key).groupBy(*self.by, key).agg(F.bool_and(F.coalesce("cnt", F.lit(0)) > 0).alias(out))
        return df.join(apart(answers), [*self.by, key], "left")

    def remove(self, df: DataFrame, key: str) -> CountingBloomFilter:
        """Take each distinct key of ``df`` out once if it is a member. Counters at the top stay there."""
        member = self.test(df.select(*self.by, key).distinct(), key).where("member").drop("member")
        gone = BloomFilter.hashed(member, key, self.spec).select(*self.by, F.explode("__p").alias("pos")).groupBy(*self.by, "pos").agg(F.count("*").alias("gone"))
        left = F.when(F.col("cnt") >= self.spec["top"], F.col("cnt")).otherwise(F.col("cnt") - F.coalesce("gone", F.lit(0)))
        cells = self.cells.join(apart(gone), [*self.by, "pos"], "left").select(*self.by, "pos", left.alias("cnt")).where("cnt > 0")
        return self.like(cells)


class DeletableBloomFilter(Sketch):
    """Cells (pos, hits). The bits lie in regions; a region where a bit was set twice is collided and never gives bits back."""

    KEYS = ("pos",)
    FOLD = (("hits", "sum"),)
    KIND = "deletable"

    @classmethod
    def sized(cls, n: int, fp_rate: float, regions: int, hash_name: str = "md5") -> dict:
        m = sizing.bloom_bits(n, fp_rate)
        if not 0 < regions < m:
            raise ValueError(f"regions must be from 1 to {m - 1}, not {regions}")
        return {"m": m - regions, "k": sizing.bloom_probes(fp_rate), "region": math.ceil((m - regions) / regions), "hash": hash_name}

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> DeletableBloomFilter:
        rows = BloomFilter.hashed(df, key, spec).select(*by, F.explode("__p").alias("pos"))
        return cls(spec, rows.groupBy(*by, "pos").agg(F.count("*").alias("hits")), by)

    def regions(self) -> DataFrame:
        """(region, collided) of the regions that have bits."""
        region = F.floor(F.col("pos") / self.spec["region"]).cast("long")
        return self.cells.groupBy(*self.by, region.alias("region")).agg((F.max("hits") > 1).alias("collided"))

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        keys = df.where(F.col(key).isNotNull()).select(*self.by, key).distinct()
        asked = BloomFilter.hashed(keys, key, self.spec).select(*self.by, key, F.explode("__p").alias("pos")).join(apart(self.cells), [*self.by, "pos"], "left")
        return df.join(asked.groupBy(*self.by, key).agg(F.count_if(F.col("hits").isNull()).alias("n")).select(*self.by, key, (F.col("n") == 0).alias(out)), [*self.by, key], "left")

    def remove(self, df: DataFrame, key: str) -> DeletableBloomFilter:
        """Clear the bits of member keys that lie in regions without collision."""
        member = self.test(df.select(*self.by, key).distinct(), key).where("member").drop("member")
        region = F.floor(F.col("pos") / self.spec["region"]).cast("long")
        free = self.regions().where("not collided").select(*self.by, "region")
        gone = BloomFilter.hashed(member, key, self.spec).select(*self.by, F.explode("__p").alias("pos")).distinct().withColumn("region", region)
        gone = gone.join(free, [*self.by, "region"], "left_semi").select(*self.by, "pos")
        return self.like(self.cells.join(gone, [*self.by, "pos"], "left_anti"))


class QuotientFilter(Sketch):
    """Cells (quotient, remainder, cnt): the multiset of fingerprints of the first bits of the hash. Repeats are kept."""

    KEYS = ("quotient", "remainder")
    FOLD = (("cnt", "sum"),)
    KIND = "quotient"

    @classmethod
    def sized(cls, n: int, fp_rate: float, hash_name: str = "md5") -> dict:
        q, r = sizing.quotient_bits(n, fp_rate)
        return {"q": q, "r": r, "hash": hash_name}

    @classmethod
    def fingerprint(cls, spec: dict, key: Column) -> tuple[Column, Column]:
        f = hashing.top_bits(*hashing.words(key, spec["hash"]), spec["q"] + spec["r"])
        return F.shiftright(f, spec["r"]), f.bitwiseAND(F.lit((1 << spec["r"]) - 1).cast("long"))

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> QuotientFilter:
        q, r = cls.fingerprint(spec, F.col(key))
        cells = df.where(F.col(key).isNotNull()).select(*by, q.alias("quotient"), r.alias("remainder")).groupBy(*by, "quotient", "remainder").agg(F.count("*").alias("cnt"))
        return cls(spec, cells, by)

    def full(self) -> DataFrame:
        """By group, whether more fingerprints are held than there are slots: the filter must be sized anew."""
        return self.cells.groupBy(*self.by).agg((F.sum("cnt") > (1 << self.spec["q"])).alias("full"))

    def checked(self) -> QuotientFilter:
        """The filter itself, or an error if a group holds more fingerprints than it has slots."""
        if not self.full().where("full").isEmpty():
            raise ValueError(f"more fingerprints than the {1 << self.spec['q']} slots; size the filter anew")
        return self

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        q, r = self.fingerprint(self.spec, F.col(key))
        mine = self.cells.select(*self.by, F.col("quotient").alias("__q"), F.col("remainder").alias("__r"), F.lit(True).alias(out))
        rows = df.withColumn("__q", q).withColumn("__r", r)
        return rows.join(apart(mine), [*self.by, "__q", "__r"], "left").withColumn(out, F.when(F.col("__q").isNotNull(), F.coalesce(out, F.lit(False)))).drop("__q", "__r")

    def remove(self, df: DataFrame, key: str) -> QuotientFilter:
        """Take out one fingerprint for each row of ``df``, as many as there are."""
        gone = QuotientFilter.build(df, key, self.spec, self.by).cells.withColumnRenamed("cnt", "gone")
        left = self.cells.join(apart(gone), [*self.by, *self.KEYS], "left").withColumn("cnt", F.col("cnt") - F.coalesce("gone", F.lit(0))).drop("gone")
        return self.like(left.where("cnt > 0"))


class ScalableBloomFilter(Sketch):
    """A list of partitioned filters, each of a rate ``r`` times the one before; cells (filter, word, mask).

    A filter is left for the next when its estimated fill reaches a half, that is after ceil(slice ln 2) keys. So a row's
    filter follows from its place, which is found by counting in ranges and not in one task.
    """

    KEYS = ("filter", "word")
    FOLD = (("mask", "bit_or"),)
    KIND = "scalable"

    @staticmethod
    def sized(hint: int = 10_000, fp_rate: float = 0.01, r: float = 0.8, hash_name: str = "md5") -> dict:
        guards.positive("hint", hint)
        guards.fraction("r", r)
        guards.fraction("fp_rate", fp_rate)
        return {"hint": hint, "fp": fp_rate, "r": r, "hash": hash_name}

    @staticmethod
    def filters(spec: dict, n: int) -> list[tuple[dict, int, int]]:
        """(spec, first place, end) of the filters that n keys need."""
        out, at = [], 0
        while at < n or not out:
            rate = max(spec["fp"] * spec["r"] ** len(out), sys.float_info.min)  # after thousands of filters, the least there is
            one = PartitionedBloomFilter.sized(spec["hint"], rate, spec["hash"])
            size = math.ceil(one["slice"] * math.log(2))
            out.append((one, at, at + size))
            at += size
        return out

    @classmethod
    def placed(cls, df: DataFrame, key: str, order: str, spec: dict) -> tuple[DataFrame, list[tuple[dict, int, int]]]:
        """``df`` with its place, its filter and that filter's __slice and __k, by a join with the table of the filters: however
        many there are, the plan stays the same. And the filters."""
        rows = df.where(F.col(key).isNotNull())
        made = cls.filters(spec, rows.count())
        step = min(end - first for _, first, end in made)
        cells = [(c, j, first, end, one["slice"], one["k"]) for j, (one, first, end) in enumerate(made) for c in range(first // step, (end - 1) // step + 1)]
        of = df.sparkSession.createDataFrame(cells, "__cell long, filter int, __from long, __end long, __slice long, __k int")
        rows = with_place(rows, order).withColumn("__cell", F.floor(F.col("place") / step).cast("long"))
        rows = rows.join(of, "__cell").where((F.col("__from") <= F.col("place")) & (F.col("place") < F.col("__end")))
        return rows.drop("__cell", "__from", "__end"), made

    @staticmethod
    def _probe(h: Column, i: Column, size: Column) -> Column:
        """Position of probe i of a hash (hi, lo) in a partitioned filter of this slice."""
        return (h["lo"] + h["hi"] * i).bitwiseAND(F.lit(hashing.MASK32).cast("long")) % size + i * size

    @classmethod
    def _probes(cls, key: str, hash_name: str) -> Column:
        """All positions of ``key`` by the columns __slice and __k; the hash is computed once."""
        each = F.sequence(F.lit(0).cast("long"), F.col("__k").cast("long") - 1)
        return once(hashing.words(F.col(key), hash_name), lambda h: F.transform(each, lambda i: cls._probe(h, i, F.col("__slice"))))

    @classmethod
    def build(cls, df: DataFrame, key: str, order: str, spec: dict) -> ScalableBloomFilter:
        rows, made = cls.placed(df, key, order, spec)
        cells = bit_words(rows.select("filter", F.explode(cls._probes(key, spec["hash"])).alias("pos")), ("filter",))
        return cls(spec | {"filters": [one for one, _, _ in made]}, cells)

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        """A key is a member if one of the filters has it.

        Filters of at most BROADCAST_BITS in all are read as one array, in which a key stops at the first clear bit of a filter and at
        the first filter that has it; else the probes of distinct keys meet the words in a join.
        """
        made = self.spec["filters"]
        sizes = [(PartitionedBloomFilter.bits(one) + 63) // 64 for one in made]
        if 64 * sum(sizes) > BROADCAST_BITS:
            return self._joined(df, key, out)
        shape = [(j, base, one["slice"], one["k"]) for j, (base, one) in enumerate(zip(itertools.accumulate(sizes, initial=0), made, strict=False))]
        table = self.cells.sparkSession.createDataFrame(shape, "filter int, base long, slice long, k int")
        one_row = table.agg(F.sort_array(F.collect_list(F.struct("base", "slice", "k"))).alias("shape")).select("shape").scalar()
        flat = self.cells.join(table, "filter").select((F.col("base") + F.col("word")).alias("word"), "mask")
        words = F.col("__words")

        def has(h: Column, f: Column) -> Column:
            def is_set(i: Column) -> Column:
                pos = self._probe(h, i, f["slice"])
                word = F.get(words, (f["base"] + F.shiftright(pos, 6)).cast("int"))
                return F.call_function("getbit", word, pos.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

            return F.forall(F.sequence(F.lit(0).cast("long"), f["k"].cast("long") - 1), is_set)

        answer = once(hashing.words(F.col(key), self.spec["hash"]), lambda h: F.exists("__shape", lambda f: has(h, f)))
        rows = df.withColumn("__words", dense_words(flat, 64 * sum(sizes)).scalar()).withColumn("__shape", one_row)
        return rows.withColumn(out, F.when(F.col(key).isNotNull(), answer)).drop("__words", "__shape")

    def _joined(self, df: DataFrame, key: str, out: str) -> DataFrame:
        keys = df.where(F.col(key).isNotNull()).select(key).distinct()
        shape = [(j, one["slice"], one["k"]) for j, one in enumerate(self.spec["filters"])]
        asked = keys.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(len(shape) - 1)))).join(keys.sparkSession.createDataFrame(shape, "filter int, __slice long, __k int"), "filter")
        asked = asked.select(key, "filter", F.explode(self._probes(key, self.spec["hash"])).alias("pos")).withColumn("word", F.shiftright("pos", 6))
        hit = F.call_function("getbit", F.coalesce("mask", F.lit(0).cast("long")), F.col("pos").bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        found = asked.join(self.cells, ["filter", "word"], "left").groupBy(key, "filter").agg(F.bool_and(hit).alias(out))
        return df.join(found.groupBy(key).agg(F.bool_or(out).alias(out)), key, "left")


def once(hash_words: tuple[Column, Column], f: Callable[[Column], Column]) -> Column:
    """f(h) of a hash h with fields hi and lo, computed once for a row although f's lambdas name it for each element."""
    hi, lo = hash_words
    return F.get(F.transform(F.array(F.struct(hi.alias("hi"), lo.alias("lo"))), f), 0)


#: Ranges that places are counted in, at most.
RANGES = 4096


def with_place(df: DataFrame, order: str, name: str = "place", rows: int = 100_000) -> DataFrame:
    """``df`` with the row's place (from 0) by ``order``, a number without repeats, found by ranges and not in one task.

    Rows are counted by ranges of the order's values, the counts are added up, and rows are numbered within their range. The
    ranges end at quantiles, so they hold about equally many rows however the numbers bunch (snowflake ids, bursts);
    quantiles only balance: places are exact whatever they are. Nulls come first.
    """
    from pyspark.ml.feature import Bucketizer

    n = df.count()
    ranges = min(RANGES, max(1, n // rows))
    cuts: list[float] = []
    if ranges > 1:
        at = [(i + 1) / ranges for i in range(ranges - 1)]
        found = df.agg(F.percentile_approx(F.col(order).cast("double"), at, 10 * RANGES)).first()[0]
        cuts = sorted({float(x) for x in found or [] if math.isfinite(x)})
    if cuts:
        value = F.coalesce(F.col(order).cast("double"), F.lit(-math.inf))
        cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__value", outputCol="__cut")
        rows_ = cutter.transform(df.withColumn("__value", value)).withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(F.col("__cut").cast("int"))).drop("__value", "__cut")
    else:
        rows_ = df.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(0))
    sums = rows_.groupBy("__range").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return rows_.withColumn("__n", within).join(sums, "__range").withColumn(name, (F.col("__n") + F.col("__before")).cast("long")).drop("__n", "__before", "__range")


class InverseBloomFilter:
    """The last key of each slot: no false positives, false negatives once another key took the slot."""

    @staticmethod
    def slot(key: Column, capacity: int, hash_name: str) -> Column:
        return hashing.words(key, hash_name)[1] % capacity

    @classmethod
    def test_and_add(cls, df: DataFrame, key: str, order: str, capacity: int, hash_name: str = "md5", out: str = "member") -> DataFrame:
        """``df`` with ``out``: whether the slot held this very key when the row came."""
        guards.positive("capacity", capacity)
        w = Window.partitionBy("__slot").orderBy(order)
        rows = df.withColumn("__slot", cls.slot(F.col(key), capacity, hash_name))
        return rows.withColumn(out, F.coalesce(F.lag(key).over(w) == F.col(key), F.lit(False))).drop("__slot")

    @classmethod
    def build(cls, df: DataFrame, key: str, order: str, capacity: int, hash_name: str = "md5") -> DataFrame:
        """(slot, key): what the slots hold in the end."""
        rows = df.where(F.col(key).isNotNull()).withColumn("slot", cls.slot(F.col(key), capacity, hash_name))
        return rows.groupBy("slot").agg(F.max_by(key, order).alias(key))

    @classmethod
    def test(cls, state: DataFrame, df: DataFrame, key: str, capacity: int, hash_name: str = "md5", out: str = "member") -> DataFrame:
        rows = df.withColumn("slot", cls.slot(F.col(key), capacity, hash_name))
        held = state.select("slot", F.col(key).alias("__held"))
        return rows.join(held, "slot", "left").withColumn(out, F.coalesce(F.col("__held") == F.col(key), F.lit(False))).drop("slot", "__held")


