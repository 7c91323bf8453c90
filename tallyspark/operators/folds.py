"""Structures whose state depends on the order of the keys: cuckoo and stable filters, HeavyKeeper.

Keys are dealt to shards by their hash, and each shard folds its own rows in order. A key is in one shard only, so answers
of the shards stand side by side; the number of shards, not the length of the stream, bounds what a task holds besides its batch.
"""

from __future__ import annotations

import array
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards, hashing, sizing


def by_shard(df: DataFrame, key: str, order: str, shards: int) -> DataFrame:
    """``df`` dealt to ``shards`` tasks, one for each shard of the keys, and sorted by ``order`` in each, with the key's bytes."""
    rows = df.where(F.col(key).isNotNull()).withColumn("__shard", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("shard")), F.lit(shards)).cast("int"))
    return rows.withColumn("__bytes", hashing.key_bytes(F.col(key))).repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", order)


def _run(df: DataFrame, make: Callable[[int], object], step: Callable, schema: str, names: list[str], keep: list[str], end: Callable | None = None) -> DataFrame:
    """Fold each shard: ``step(state, bytes, row)`` gives the new columns of a row, ``end(state)`` rows of its own."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for b in batches:
            rows = b.to_pydict()
            out = []
            for i, (shard, data) in enumerate(zip(rows["__shard"], rows["__bytes"], strict=True)):
                if shard not in states:
                    states[shard] = make(shard)
                out.append(step(states[shard], data, rows, i))
            if end is None:
                cols = [b.column(k) for k in keep]
                made = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([]) for _ in names]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*keep, *names])
        if end is not None:
            for shard, state in states.items():
                found = end(shard, state)
                if found:
                    yield pa.RecordBatch.from_pylist(found)

    return df.mapInArrow(fold, schema)


class CuckooTable:
    """Buckets of four fingerprints; a fingerprint lies in one of two buckets, each reached from the other. At most 500
    others are moved to make room; if that fails all moves are undone and the key is not added."""

    ENTRIES, KICKS = 4, 500

    def __init__(self, buckets: int, bits: int, seed: int = 1) -> None:
        guards.power_of_two("buckets", buckets)
        self.mask, self.bits = buckets - 1, bits
        self.table = array.array("B" if bits <= 8 else "H" if bits <= 16 else "I" if bits <= 32 else "Q", bytes(0))
        self.table.frombytes(bytes(buckets * self.ENTRIES * self.table.itemsize))
        self.size = bytearray(buckets)
        self.random = hashing.SplitMix64(seed)

    def places(self, data: bytes) -> tuple[int, int, int]:
        h = hashing.xxh3_64(data)
        f = h & ((1 << self.bits) - 1)
        i = hashing.xxh3_64(h.to_bytes(8, "little")) & self.mask
        return f, i, self.other(i, f)

    def other(self, i: int, f: int) -> int:
        return (i ^ hashing.xxh3_64(f.to_bytes(8, "little"))) & self.mask

    def held(self, at: int) -> array.array:
        """The fingerprints of a bucket, as they came."""
        return self.table[at * self.ENTRIES : at * self.ENTRIES + self.size[at]]

    def _appended(self, at: int, f: int) -> bool:
        n = self.size[at]
        if n == self.ENTRIES:
            return False
        self.table[at * self.ENTRIES + n] = f
        self.size[at] = n + 1
        return True

    def __contains__(self, data: bytes) -> bool:
        f, i, j = self.places(data)
        return f in self.held(i) or f in self.held(j)

    def add(self, data: bytes) -> bool:
        f, i, j = self.places(data)
        if self._appended(i, f) or self._appended(j, f):
            return True
        moves = []
        at = (i, j)[self.random.below(2)]
        for _ in range(self.KICKS):
            slot = at * self.ENTRIES + self.random.below(self.ENTRIES)
            moves.append((slot, self.table[slot]))
            f, self.table[slot] = self.table[slot], f
            at = self.other(at, f)
            if self._appended(at, f):
                return True
        for slot, old in reversed(moves):
            self.table[slot] = old
        return False

    def remove(self, data: bytes) -> bool:
        f, i, j = self.places(data)
        for at in (i, j):
            held = self.held(at)
            if f in held:
                held.remove(f)
                held.append(0)
                self.table[at * self.ENTRIES : at * self.ENTRIES + len(held)] = held
                self.size[at] -= 1
                return True
        return False


class CuckooFilter:
    """Adds, removals and tests in order. A row's ``op`` is add, test_and_add, remove or test."""

    @staticmethod
    def sized(n: int, fp_rate: float, shards: int | None = None) -> dict:
        """For ``n`` keys in all; unless told, a shard for 125,000 of them (eight at least), so a task holds no more as n grows."""
        shards = shards or max(8, math.ceil(n / 125_000))
        buckets, bits = sizing.cuckoo_shape(max(1, math.ceil(n / shards * 1.1)), fp_rate)
        return {"buckets": buckets, "bits": bits, "shards": shards}

    @staticmethod
    def run(df: DataFrame, key: str, order: str, spec: dict, op: str = "op", seed: int = 1) -> DataFrame:
        """``df`` with was_member and done (added, removed; false if there was no room or no such key)."""
        buckets, bits = spec["buckets"], spec["bits"]

        def step(t: CuckooTable, data: bytes, rows: dict, i: int) -> tuple[bool, bool]:
            what = rows[op][i]
            was = data in t
            if what == "add":
                return was, t.add(data)
            if what == "test_and_add":
                return was, False if was else t.add(data)
            if what == "remove":
                return was, t.remove(data)
            return was, False

        rows = by_shard(df, key, order, spec["shards"])
        keep = df.columns
        schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "was_member boolean", "done boolean"])
        return _run(rows, lambda shard: CuckooTable(buckets, bits, seed + shard), step, schema, ["was_member", "done"], keep)


class StableTable:
    """Cells that fade: each key first lowers ``p`` cells from a random place on, then sets its own to the top."""

    def __init__(self, spec: dict, seed: int) -> None:
        self.spec = spec
        self.cells = bytearray(spec["m"])
        self.random = hashing.SplitMix64(seed)

    def places(self, data: bytes) -> list[int]:
        h = hashing.xxh3_64(data)
        lo, hi = h & hashing.MASK32, h >> 32
        return [((lo + hi * i) & hashing.MASK32) % self.spec["m"] for i in range(self.spec["k"])]

    def __contains__(self, data: bytes) -> bool:
        return all(self.cells[p] for p in self.places(data))

    def add(self, data: bytes) -> None:
        m = self.spec["m"]
        at = self.random.below(m)
        for i in range(self.spec["p"]):
            c = (at + i) % m
            if self.cells[c]:
                self.cells[c] -= 1
        for p in self.places(data):
            self.cells[p] = self.spec["top"]

    def test_and_add(self, data: bytes) -> bool:
        was = data in self
        self.add(data)
        return was


class StableBloomFilter:
    """Duplicates of an endless stream in a fixed space: old keys are forgotten, so there are false negatives too."""

    @staticmethod
    def sized(m: int, bits: int = 1, fp_rate: float = 0.01, shards: int = 1) -> dict:
        guards.positive("m", m)
        guards.within("bits", bits, 1, 8)
        guards.fraction("fp_rate", fp_rate)
        k = max(1, min(m, sizing.bloom_probes(fp_rate) // 2))
        top = (1 << bits) - 1
        share = (1 - fp_rate ** (1 / k)) ** (1 / top)
        p = int(1 / ((1 / share - 1) * (1 / k - 1 / m))) if k < m else 1
        return {"m": m, "k": k, "top": top, "p": max(1, min(p, m)), "shards": shards}

    @staticmethod
    def unstable(m: int, fp_rate: float = 0.01, shards: int = 1) -> dict:
        """One that forgets nothing: a classic Bloom filter."""
        return StableBloomFilter.sized(m, 1, fp_rate, shards) | {"p": 0, "k": max(1, min(m, sizing.bloom_probes(fp_rate)))}

    @staticmethod
    def stable_point(spec: dict) -> float:
        """The share of zero cells that the filter tends to."""
        if not spec["p"]:
            return 0.0
        return (1 / (1 + 1 / (spec["p"] * (1 / spec["k"] - 1 / spec["m"])))) ** spec["top"]

    @staticmethod
    def fp_rate(spec: dict) -> float:
        return (1 - StableBloomFilter.stable_point(spec)) ** spec["k"]

    @staticmethod
    def test_and_add(df: DataFrame, key: str, order: str, spec: dict, out: str = "member", seed: int = 1) -> DataFrame:
        rows = by_shard(df, key, order, spec["shards"])
        schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{out}` boolean"])
        return _run(rows, lambda shard: StableTable(spec, seed + shard), lambda t, data, _r, _i: (t.test_and_add(data),), schema, [out], df.columns)


class HeavyKeeperTable:
    """Rows of (fingerprint, count): a key that meets another one's fingerprint lowers its count with a chance that falls
    with the count, so large keys stay. The k largest are tracked by name."""

    def __init__(self, k: int, width: int, depth: int, decay: float, seed: int) -> None:
        self.k, self.width, self.decay = k, width, decay
        self.rows: list[dict[int, list[int]]] = [{} for _ in range(depth)]
        self.top: dict[bytes, int] = {}
        self.least = 0
        self.random = hashing.SplitMix64(seed)

    def add(self, data: bytes) -> None:
        h = hashing.xxh3_64(data)
        lo, hi = h & hashing.MASK32, h >> 32
        name, known, best = hi >> 16, self.top.get(data), 0
        for i, row in enumerate(self.rows):
            cell = row.setdefault(((lo + hi * i) & hashing.MASK32) % self.width, [name, 0])
            if cell[1] and cell[0] != name:
                if self.random.unit() >= self.decay ** -cell[1]:
                    continue
                cell[1] -= 1
                if cell[1]:
                    continue
            if not cell[1]:
                cell[:] = [name, 1]
            elif known is not None or cell[1] <= self.least:
                cell[1] += 1
            best = max(best, cell[1])
        if known is not None:
            if best > known:
                self.top[data] = best
                if known == self.least:
                    self.least = min(self.top.values())
        elif len(self.top) < self.k or best == self.least + 1:
            if len(self.top) >= self.k:
                del self.top[min(self.top, key=lambda x: (self.top[x], x))]
            self.top[data] = best
            self.least = min(self.top.values())


def heavy_keeper(df: DataFrame, key: str, order: str, k: int, width: int = 4096, depth: int = 3, decay: float = 1.08, shards: int = 8, seed: int = 1) -> DataFrame:
    """(key as string, estimate) of the k most frequent keys; each shard tracks k, and keys of shards don't meet."""
    guards.positive("k", k)
    guards.positive("decay - 1", decay - 1)
    rows = by_shard(df.select(key, order), key, order, shards)
    end = lambda _shard, t: [{key: d.decode(), "estimate": n} for d, n in t.top.items()]
    found = _run(rows, lambda shard: HeavyKeeperTable(k, width, depth, decay, seed + shard), lambda t, data, _r, _i: t.add(data), f"`{key}` string, estimate long", [], [], end)
    return found.orderBy(F.col("estimate").desc(), key).limit(k)
