"""Filters and maps that are built once: binary fuse and Bloomier.

Keys are dealt to shards by their hash; each shard is peeled on its own, so no task holds more than about ``SHARD`` keys.
A probe goes to its key's shard. Three places of a key, exclusive-ored, give its fingerprint (and its value).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards, hashing
from .cells import Sketch

SHARD = 250_000
TRIES = 100


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    x = h + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def _places(h: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three places in neighbouring segments, and a word for the fingerprint."""
    x = _mix(h, seed)
    first = ((x >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    inside = np.uint64(segment - 1)
    at = np.stack([(first + i) * segment + ((x >> np.uint64(18 * i)) & inside).astype(np.int64) for i in range(3)], axis=1)
    return at, x ^ x >> np.uint64(29)


def _shape(n: int) -> tuple[int, int]:
    """(keys to a segment, starting segments) for n keys, with the slack that peeling needs at that size."""
    segment = 1 << min(18, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(1, int(np.ceil(n * factor / segment)) - 1)


def peel(h: np.ndarray) -> tuple[int, int, int, list[tuple[int, int]], np.ndarray]:
    """(seed, segment, segments, [(key, place)] in peeling order, places): distinct hashes, so that each key has a place of its own."""
    segment, segments = _shape(len(h))
    random = hashing.SplitMix64(0x726F6F74)
    for _ in range(TRIES):
        seed = random.next()
        at, _ = _places(h, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        np.bitwise_xor.at(owner, at.ravel(), np.repeat(np.arange(len(h)), 3))
        alone = np.flatnonzero(count == 1).tolist()
        order, done = [], np.zeros(len(h), bool)
        while alone:
            p = alone.pop()
            if count[p] != 1:
                continue
            k = owner[p]
            order.append((int(k), p))
            done[k] = True
            for q in at[k].tolist():
                count[q] -= 1
                owner[q] ^= k
                if count[q] == 1:
                    alone.append(q)
        if len(order) == len(h):
            return seed, segment, segments, order, at
    raise ValueError(f"no peeling found in {TRIES} tries")


class BinaryFuseFilter(Sketch):
    """Cells (shard, seed, segment, segments, n, table): a share of 2^-bits false positives, none false negative."""

    KEYS = ("shard",)
    KIND = "fuse"

    @staticmethod
    def sized(n: int, bits: int = 8, hash_name: str = "xxhash64") -> dict:
        if bits not in (8, 16):
            raise ValueError("fingerprints have 8 or 16 bits")
        guards.positive("n", n)
        return {"bits": bits, "value_bits": 0, "shards": max(1, -(-n // SHARD)), "hash": hash_name}

    @classmethod
    def for_rate(cls, n: int, fp_rate: float, hash_name: str = "xxhash64") -> dict:
        guards.fraction("fp_rate", fp_rate)
        for bits in (8, 16):
            if 2.0**-bits <= fp_rate:
                return cls.sized(n, bits, hash_name)
        raise ValueError(f"no width reaches {fp_rate}")

    @classmethod
    def hashed(cls, key: Column, spec: dict) -> tuple[Column, Column]:
        hi, lo = hashing.words(key, spec["hash"])
        h = F.shiftleft(hi, 32).bitwiseOR(lo)
        return h, F.pmod(F.xxhash64(h, F.lit("shard")), F.lit(spec["shards"])).cast("int")

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = (), value: str | None = None) -> BinaryFuseFilter:
        h, _ = cls.hashed(F.col(key), spec)
        limit = 1 << max(spec["value_bits"], 1)
        v = F.col(value).cast("long") if value else F.lit(0).cast("long")
        rows = df.where(F.col(key).isNotNull()).select(*by, h.alias("h"), v.alias("v")).distinct().groupBy(*by, "h").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        bad = F.when(F.col("n") > 1, F.raise_error(F.lit("a key has two values"))).when((F.col("v") < 0) | (F.col("v") >= limit), F.raise_error(F.lit("a value is too wide"))).otherwise(F.col("v"))
        rows = rows.select(*by, F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(spec["shards"])).cast("int").alias("shard"), "h", bad.alias("v"))
        types = dict(rows.dtypes)
        bits, value_bits = spec["bits"], spec["value_bits"]

        def make(key_: tuple, t: pa.Table) -> pa.Table:
            h = t.column("h").to_numpy().view(np.uint64)
            seed, segment, segments, order, at = peel(h)
            want = _places(h, seed, segment, segments)[1] & np.uint64((1 << bits) - 1)
            want = want << np.uint64(value_bits) | t.column("v").to_numpy().view(np.uint64)
            table = np.zeros((segments + 2) * segment, np.uint64)
            for k, p in reversed(order):
                table[p] = want[k] ^ table[at[k, 0]] ^ table[at[k, 1]] ^ table[at[k, 2]]
            width = next(w for w in (1, 2, 4, 8) if 8 * w >= bits + value_bits)
            packed = table.astype(f"<u{width}").tobytes()
            return pa.table([*[pa.array([k.as_py()], k.type) for k in key_], pa.array([np.uint64(seed).astype(np.int64)]), pa.array([segment]), pa.array([segments]), pa.array([len(h)]), pa.array([packed], pa.binary())], names=[*by, "shard", "seed", "segment", "segments", "n", "data"])

        schema = ", ".join([*(f"`{b}` {types[b]}" for b in by), "shard int, seed long, segment long, segments long, n long, data binary"])
        return cls(spec, rows.groupBy(*by, "shard").applyInArrow(make, schema), by)

    def merge(self, other: Sketch) -> Sketch:
        raise ValueError("a filter that is built once can't be merged; build it from both")

    def _probe(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """``df`` with ``out``: the value (0 in a filter), or null where the fingerprint differs or there is no shard."""
        bits, value_bits = self.spec["bits"], self.spec["value_bits"]
        names = [*self.by, key]
        h, shard = self.hashed(F.col(key), self.spec)
        asked = df.where(F.col(key).isNotNull()).select(*names).distinct().withColumn("__h", h).withColumn("__shard", shard)
        types = dict(asked.dtypes)

        def look(key_: tuple, t: pa.Table, cells: pa.Table) -> pa.Table:
            if not len(t):
                return pa.table([pa.array([], f.type) for f in t.select(names).schema] + [pa.array([], pa.int64())], names=[*names, out])
            answer = pa.nulls(len(t), pa.int64())
            if len(cells):
                c = cells.slice(0, 1).to_pylist()[0]
                width = len(c["data"]) // ((c["segments"] + 2) * c["segment"])
                table = np.frombuffer(c["data"], f"<u{width}").astype(np.uint64)
                at, word = _places(t.column("__h").to_numpy().view(np.uint64), int(np.int64(c["seed"]).astype(np.uint64)), c["segment"], c["segments"])
                got = table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]
                ok = got >> np.uint64(value_bits) == word & np.uint64((1 << bits) - 1)
                answer = pa.array((got & np.uint64((1 << value_bits) - 1)).astype(np.int64), mask=~ok)
            return pa.table([*[t.column(n) for n in names], answer], names=[*names, out])

        schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), f"`{out}` long"])
        cells = self.cells.withColumnRenamed("shard", "__shard")
        answers = asked.groupBy(*self.by, "__shard").cogroup(cells.groupBy(*self.by, "__shard")).applyInArrow(look, schema)
        return df.join(answers, names, "left")

    def test(self, df: DataFrame, key: str, out: str = "member") -> DataFrame:
        return self._probe(df, key, "__v").withColumn(out, F.when(F.col(key).isNotNull(), F.col("__v").isNotNull())).drop("__v")


class BloomierFilter(BinaryFuseFilter):
    """A map in a fuse table: the value of a key that was built in; of others, null but for a share of 2^-8."""

    KIND = "bloomier"

    @staticmethod
    def sized(n: int, value_bits: int, hash_name: str = "xxhash64") -> dict:
        guards.within("value_bits", value_bits, 1, 40)
        return BinaryFuseFilter.sized(n, 8, hash_name) | {"value_bits": value_bits}

    def lookup(self, df: DataFrame, key: str, out: str = "value") -> DataFrame:
        return self._probe(df, key, out)
