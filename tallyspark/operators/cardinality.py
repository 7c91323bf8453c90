"""Distinct counts and set algebra: HyperLogLog, its improved form, UltraLogLog, Theta and Tuple sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards, hashing, sizing
from .cells import Sketch


def _bits(x: Column) -> Column:
    """Length of a number in binary; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


class HyperLogLog(Sketch):
    """Cells (idx, reg) over the low 32 bits of the hash: 2^b registers, each the longest run of zeros seen and one."""

    KEYS = ("idx",)
    FOLD = (("reg", "max"),)
    KIND = "hll"

    @staticmethod
    def sized(m: int, hash_name: str = "md5") -> dict:
        guards.power_of_two("m", m)
        guards.within("m", m, 2, 1 << 30)
        return {"m": m, "hash": hash_name}

    @classmethod
    def for_error(cls, error: float, hash_name: str = "md5") -> dict:
        return cls.sized(sizing.hll_registers(error), hash_name)

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> HyperLogLog:
        rest = 32 - (spec["m"].bit_length() - 1)
        _, lo = hashing.words(F.col(key), spec["hash"])
        tail = F.col("__lo").bitwiseAND(F.lit((1 << rest) - 1).cast("long"))
        rows = df.where(F.col(key).isNotNull()).select(*by, lo.alias("__lo"))
        rows = rows.select(*by, F.shiftright("__lo", rest).alias("idx"), (rest + 1 - _bits(tail)).alias("reg"))
        return cls(spec, cls.fold(rows, by), by)

    def count(self, out: str = "estimate") -> DataFrame:
        """By group: harmonic mean of the registers, linear counting while it is small, corrected towards 2^32."""
        m = self.spec["m"]
        alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
        seen = self.cells.groupBy(*self.by).agg(F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("s"), F.count("*").alias("n"))
        empty = F.lit(m) - F.col("n")
        raw = F.lit(alpha * m * m) / (F.col("s") + empty)
        top = float(1 << 32)
        small = F.when(empty > 0, m * F.log(F.lit(float(m)) / empty)).otherwise(raw)
        large = -top * F.log(1 - raw / top)
        return seen.select(*self.by, F.when(raw <= 2.5 * m, small).when(raw > top / 30, large).otherwise(raw).cast("long").alias(out))


class HyperLogLogPlus(Sketch):
    """Cells (idx, reg) over all 64 bits. Few keys are counted exactly by their hashes, many by the registers."""

    KEYS = ("idx",)
    FOLD = (("reg", "max"),)
    KIND = "hllp"

    @staticmethod
    def sized(precision: int, hash_name: str = "md5") -> dict:
        guards.within("precision", precision, 4, 18)
        return {"p": precision, "hash": hash_name}

    @classmethod
    def hashes(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...]) -> DataFrame:
        hi, lo = hashing.words(F.col(key), spec["hash"])
        return df.where(F.col(key).isNotNull()).select(*by, hi.alias("hi"), lo.alias("lo"))

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> HyperLogLogPlus:
        p = spec["p"]
        rows = cls.hashes(df, key, spec, by)
        head = F.col("hi").bitwiseAND(F.lit((1 << (32 - p)) - 1).cast("long"))
        zeros = F.when(head > 0, 32 - p - _bits(head)).otherwise(32 - p + 32 - _bits(F.col("lo")))
        return cls(spec, cls.fold(rows.select(*by, F.shiftright("hi", 32 - p).alias("idx"), (zeros + 1).alias("reg")), by), by)

    def count(self, out: str = "estimate") -> DataFrame:
        """The dense estimate: Ertl's corrected raw estimator, written as sums over the register histogram."""
        p = self.spec["p"]
        m, q = 1 << p, 64 - p
        seen = self.cells.groupBy(*self.by).agg(
            F.sum(F.when(F.col("reg") <= q, F.pow(F.lit(2.0), -F.col("reg"))).otherwise(0.0)).alias("s"),
            F.count("*").alias("n"), F.count_if(F.col("reg") == q + 1).alias("full"),
        )
        steps = F.sequence(F.lit(1), F.lit(60))
        x0 = (F.lit(m) - F.col("n")) / F.lit(float(m))
        sigma = F.when(x0 == 1, float("inf")).otherwise(x0 + F.aggregate(steps, F.lit(0.0), lambda a, k: a + F.pow(x0, F.pow(F.lit(2.0), k)) * F.pow(F.lit(2.0), k - 1)))
        x1 = (F.lit(m) - F.col("full")) / F.lit(float(m))
        loss = F.aggregate(steps, F.lit(0.0), lambda a, k: a + F.pow(1 - F.pow(x1, F.pow(F.lit(2.0), -k)), F.lit(2.0)) * F.pow(F.lit(2.0), -k))
        tau = F.when((x1 == 0) | (x1 == 1), 0.0).otherwise((1 - x1 - loss) / 3)
        z = F.col("s") + m * tau * 2.0**-q + m * sigma
        return seen.select(*self.by, F.bround(F.lit(0.5 / math.log(2) * m * m) / z).cast("long").alias(out))

    @classmethod
    def distinct(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), out: str = "estimate") -> DataFrame:
        """Counts of ``df``: exact while a group has at most max(4, m/8) hashes, estimated beyond.

        A group with that few hashes has at most as many registers, so only the hashes of such groups are gathered.
        """
        sketch = cls.build(df, key, spec, by)
        limit = max(4, (1 << spec["p"]) // 8)
        dense = sketch.count("__dense").join(sketch.cells.groupBy(*by).agg(F.count("*").alias("__regs")), [*by]) if by else sketch.count("__dense").withColumn("__regs", F.lit(sketch.cells.count()))
        rows = cls.hashes(df, key, spec, by)
        if by:
            rows = rows.join(dense.where(F.col("__regs") <= limit).select(*by), [*by], "left_semi")
        elif sketch.cells.count() > limit:
            rows = rows.limit(0)
        sparse = rows.distinct().groupBy(*by).agg(F.count("*").alias("__exact"))
        both = dense.join(sparse, [*by], "left") if by else dense.crossJoin(sparse)  # one row each
        exact = (F.col("__exact") > 0) & (F.col("__exact") <= limit)
        return both.select(*by, F.when(exact, F.col("__exact")).otherwise(F.col("__dense")).alias(out))


    @classmethod
    def exact(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), out: str = "estimate") -> DataFrame:
        """Counts of ``df`` that stay sparse at any size: keys are dealt by hash to as many shards as keep every sketch sparse, and
        as no key is in two of them, their counts add up. The dense estimates tell how many shards that takes."""
        most = cls.build(df, key, spec, by).count("n").agg(F.max("n")).first()[0] or 0
        share = (math.sqrt(16 + max(4, (1 << spec["p"]) // 8)) - 4) ** 2  # eight deviations of a share below the limit
        shards = math.ceil(most * (1 + 4 * 1.04 / math.sqrt(1 << spec["p"])) / share)
        if shards <= 1:
            return cls.distinct(df, key, spec, by, out)
        parts = cls.distinct(df.withColumn("__shard", shard(F.col(key), shards)), key, spec, (*by, "__shard"), out)
        return parts.groupBy(*by).agg(F.sum(out).alias(out))


def shard(key: Column, shards: int) -> Column:
    """A number below ``shards`` by a hash of its own, so what a shard holds is a fair share under the sketch's hash."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("shard")), F.lit(shards)).cast("int")


class UltraLogLog(Sketch):
    """Cells (idx, posmask): which update values each of 2^p registers has seen. A register shows its largest value and the
    two below it, so fewer registers reach the error of HyperLogLog."""

    KEYS = ("idx",)
    FOLD = (("posmask", "bit_or"),)
    KIND = "ull"

    @staticmethod
    def sized(precision: int, hash_name: str = "md5") -> dict:
        guards.within("precision", precision, 3, 26)
        return {"p": precision, "hash": hash_name}

    @classmethod
    def for_error(cls, error: float, hash_name: str = "md5") -> dict:
        guards.positive("error", error)
        return cls.sized(min(26, max(3, math.ceil(math.log2(VARIANCE / error**2)))), hash_name)

    @staticmethod
    def relative_error(precision: int) -> float:
        return math.sqrt(VARIANCE / (1 << precision))

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> UltraLogLog:
        p = spec["p"]
        hi, lo = hashing.words(F.col(key), spec["hash"])
        rows = df.where(F.col(key).isNotNull()).select(*by, hi.alias("hi"), lo.alias("lo"))
        head = F.col("hi").bitwiseAND(F.lit((1 << (32 - p)) - 1).cast("long"))
        zeros = F.when(head > 0, 32 - p - _bits(head)).otherwise(32 - p + 32 - _bits(F.col("lo")))  # at most 64 - p
        pos = (zeros + p - 1).cast("int")
        rows = rows.select(*by, F.shiftright("hi", 32 - p).alias("idx"), hashing.shl(F.lit(1).cast("long"), pos).alias("posmask"))
        return cls(spec, cls.fold(rows, by), by)

    def coarser(self, precision: int) -> UltraLogLog:
        """The sketch of a smaller precision. Only the first registers of a group keep the run of zeros going into the
        old index bits; other values stay."""
        p, d = self.spec["p"], self.spec["p"] - precision
        if d < 0:
            raise ValueError("a coarse sketch can't be made finer")
        low = F.col("idx").bitwiseAND(F.lit((1 << d) - 1).cast("long"))
        # Behind fewer index bits, the run of zeros of a hash ends in the dropped bits unless all of them are zero.
        zeros = d - _bits(low)
        one = hashing.shl(F.lit(1).cast("long"), zeros + precision - 1)
        mask = F.when(low == 0, F.col("posmask")).otherwise(one) if d else F.col("posmask")
        rows = self.cells.select(*self.by, F.shiftright("idx", d).alias("idx"), mask.alias("posmask"))
        return UltraLogLog(self.spec | {"p": precision}, self.fold(rows, self.by), self.by)

    def registers(self) -> DataFrame:
        """(idx, register): four times the largest update value, and two bits for the two values below."""
        top = F.when(F.col("posmask") < 0, F.lit(63)).otherwise(F.length(F.bin("posmask")) - 1)
        two = F.when(top >= 2, hashing.shru(F.col("posmask"), top - 2)).otherwise(hashing.shl(F.col("posmask"), 2 - top)).bitwiseAND(F.lit(3).cast("long"))
        return self.cells.select(*self.by, "idx", (top * 4 + two).cast("int").alias("register"))

    def merge(self, other: Sketch) -> UltraLogLog:
        """Sketches of unequal precision merge at the coarser one."""
        if isinstance(other, UltraLogLog) and other.spec | {"p": 0} == self.spec | {"p": 0}:
            p = min(self.spec["p"], other.spec["p"])
            return super(UltraLogLog, self.coarser(p)).merge(other.coarser(p))
        return super().merge(other)

    def count(self, out: str = "estimate") -> DataFrame:
        """By group, from the histogram of registers (at most 256 rows a group)."""
        p = self.spec["p"]
        by = list(self.by)
        rows = self.registers().groupBy(*by, "register").agg(F.count("*").alias("n"))
        hist = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("register", "n"))).alias("h"))

        @F.udf("long")  # one call a group
        def estimate(h: dict) -> int:
            return int(ull_estimate(dict(h), p) + 0.5)

        return hist.select(*by, estimate("h").alias(out))


#: Fixed value: the variance constant of the register by its author; the relative error is sqrt(VARIANCE / 2^p).
VARIANCE = 0.6118931496978437


def ull_estimate(h: dict[int, int], p: int) -> float:
    """Maximum likelihood under Poisson arrivals, from the histogram of registers.

    An update value j comes with chance 2^-j (the last one as often as the one before). A register tells that its largest value came,
    whether the two below came, and that none above did. The rate a register sees is where the derivative of the logarithm of all that is zero.
    """
    m, last = 1 << p, 65 - p
    chance = lambda j: 2.0 ** -min(j, last - 1)
    quiet = float(m - sum(h.values()))  # registers never touched: nothing came at all
    came = dict.fromkeys(range(1, last + 1), 0)
    for register, n in h.items():
        top = register // 4 - p + 2
        quiet += n * sum(chance(j) for j in range(top + 1, last + 1))
        came[top] += n
        for below, bit in ((top - 1, register & 2), (top - 2, register & 1)):
            if below >= 1:
                if bit:
                    came[below] += n
                else:
                    quiet += n * chance(below)
    if quiet <= 0:
        return float(2**64)
    slope = lambda rate: sum(n * chance(j) / math.expm1(rate * chance(j)) for j, n in came.items() if n and rate * chance(j) < 700) - quiet
    low, high = 1e-12, 2.0**64
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return m * math.sqrt(low * high) if any(came.values()) else 0.0


TWO64 = 1 << 64


class ThetaSketch(Sketch):
    """Cells (h, theta): the distinct hashes below theta; their number over theta's share of 2^64 is the count.

    With less than 2k distinct hashes all are kept and counts are exact; else theta is the (k+1)-th smallest hash.
    """

    KEYS = ("h",)
    FOLD = (("theta", "min"),)
    KIND = "theta"
    SALTS = 64

    @staticmethod
    def sized(k: int, hash_name: str = "md5") -> dict:
        guards.within("k", k, 16, 1 << 26)
        return {"k": k, "hash": hash_name}

    @classmethod
    def hashed(cls, df: DataFrame, key: str, spec: dict) -> DataFrame:
        hi, lo = hashing.words(F.col(key), spec["hash"])
        d = lambda c: c.cast("decimal(20,0)")
        return df.where(F.col(key).isNotNull()).withColumn("h", (d(hi) * F.lit(1 << 32).cast("decimal(10,0)") + d(lo)).cast("decimal(20,0)"))

    @classmethod
    def trim(cls, rows: DataFrame, spec: dict, by: tuple[str, ...]) -> DataFrame:
        """Distinct (by, h, theta and others) to the sketch. First the smallest of each salt, then those of all."""
        k, most = spec["k"], hashing.whole(TWO64 - 1).cast("decimal(20,0)")
        salt = (F.col("h") % cls.SALTS).cast("int").alias("__salt")
        first = Window.partitionBy(*by, "__salt").orderBy("h")
        rows = rows.withColumn("__salt", salt).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= 2 * k)
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        rows = rows.withColumn("__low", F.min("theta").over(group)).where(F.col("h") < F.col("__low"))
        rows = rows.withColumn("__n", F.row_number().over(group.orderBy("h"))).withColumn("__all", F.count("*").over(group))
        cut = F.max(F.when(F.col("__n") == k + 1, F.col("h"))).over(group)
        rows = rows.withColumn("theta", F.when(F.col("__all") >= 2 * k, cut).otherwise(F.least("__low", most)))
        return rows.where(F.col("h") < F.col("theta")).drop("__salt", "__n", "__low", "__all")

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> ThetaSketch:
        rows = cls.hashed(df, key, spec).select(*by, "h").distinct().withColumn("theta", hashing.whole(TWO64 - 1).cast("decimal(20,0)"))
        return cls(spec, cls.trim(rows, spec, by), by)

    def combined(self, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """Distinct hashes below the least theta, trimmed again."""
        return self.trim(self.fold(cells, by), self.spec, by)

    def _same(self, other: Sketch) -> None:
        if type(other) is not type(self) or other.spec != self.spec or other.by != self.by:
            raise ValueError("set operations need sketches of one kind, size, hash and grouping")

    def merge(self, other: Sketch) -> ThetaSketch:
        return self.union(other)

    def union(self, other: Sketch) -> ThetaSketch:
        self._same(other)
        return self.like(self.combined(self.cells.unionByName(other.cells), self.by))

    def _both(self, other: Sketch, how: str) -> DataFrame:
        self._same(other)
        low = lambda c, n: c.groupBy(*self.by).agg(F.min("theta").alias(n))
        a, b = low(self.cells, "__a"), low(other.cells, "__b")
        theta = a.join(b, [*self.by], "left") if self.by else a.crossJoin(b)  # a row for each group
        theta = theta.select(*self.by, F.least("__a", "__b").alias("__theta"))
        rows = self.cells.join(other.cells.select(*self.by, "h"), [*self.by, "h"], how)
        rows = rows.join(theta, [*self.by]) if self.by else rows.crossJoin(theta)
        return rows.where(F.col("h") < F.col("__theta")).withColumn("theta", F.col("__theta")).drop("__theta")

    def intersect(self, other: Sketch) -> ThetaSketch:
        return self.like(self._both(other, "left_semi"))

    def difference(self, other: Sketch) -> ThetaSketch:
        return self.like(self._both(other, "left_anti"))

    def count(self, out: str = "estimate") -> DataFrame:
        n, theta = F.count("*"), F.min("theta")
        exact = theta == hashing.whole(TWO64 - 1).cast("decimal(20,0)")
        return self.cells.groupBy(*self.by).agg(F.coalesce(F.when(exact, n).otherwise(F.bround(n * F.lit(float(TWO64)) / theta.cast("double"))), F.lit(0)).cast("long").alias(out))


class TupleSketch(ThetaSketch):
    """A Theta sketch whose hashes carry a number: the sum, least or largest of a key's values."""

    KIND = "tuple"

    @staticmethod
    def sized(k: int, policy: str = "sum", hash_name: str = "md5") -> dict:
        if policy not in ("sum", "min", "max"):
            raise ValueError(f"policy must be sum, min or max, not {policy}")
        return ThetaSketch.sized(k, hash_name) | {"policy": policy}

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), value: str = "value") -> TupleSketch:
        """Values are folded by key before the trim, so what survives is whole. Null values count as nothing, NaN is refused."""
        v = F.when(F.isnan(F.col(value).cast("double")), F.raise_error(F.lit("NaN has no place in a tuple sketch"))).otherwise(F.col(value).cast("double"))
        rows = cls.hashed(df, key, spec).select(*by, "h", v.alias("summary")).groupBy(*by, "h").agg(getattr(F, spec["policy"])("summary").alias("summary"))
        return cls(spec, cls.trim(rows.withColumn("theta", hashing.whole(TWO64 - 1).cast("decimal(20,0)")), spec, by), by)

    def combined(self, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
        folded = cells.groupBy(*by, "h").agg(F.min("theta").alias("theta"), getattr(F, self.spec["policy"])("summary").alias("summary"))
        return self.trim(folded, self.spec, by)

    def total(self, out: str = "total") -> DataFrame:
        """The sum of the summaries, scaled from theta's share to all keys."""
        share = F.min("theta").cast("double") / F.lit(float(TWO64 - 1))
        return self.cells.groupBy(*self.by).agg((F.sum("summary") / share).alias(out))
