"""What two tables don't share, from tables of a few cells: the invertible Bloom lookup table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards, hashing
from .cells import Sketch


class InvertibleBloomLookupTable(Sketch):
    """Cells (cell, cnt, key_sum, hash_sum) of integer keys: every key counts in four cells, one in each quarter.

    Subtracting the table of another set leaves the difference, which is read back by taking out cells of one key each.
    """

    KEYS = ("cell",)
    FOLD = (("cnt", "sum"), ("key_sum", "bit_xor"), ("hash_sum", "bit_xor"))
    KIND = "iblt"
    PROBES = 4

    @staticmethod
    def sized(difference: int, hash_name: str = "md5") -> dict:
        """For a difference of that many keys, with room of a half and a few cells for small ones."""
        guards.positive("difference", difference)
        return {"quarter": max(4, math.ceil(2 * difference / 4) + 4), "hash": hash_name}

    @classmethod
    def build(cls, df: DataFrame, key: str, spec: dict, by: tuple[str, ...] = ()) -> InvertibleBloomLookupTable:
        hi, lo = hashing.words(F.col(key), spec["hash"])
        rows = df.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("long").alias("k"), hi.alias("hi"), lo.alias("lo"))
        spread = F.array(*[((F.col("lo") + F.col("hi") * (i + 1)).bitwiseAND(F.lit(hashing.MASK32).cast("long")) % spec["quarter"]) + i * spec["quarter"] for i in range(cls.PROBES)])
        check = F.col("hi").bitwiseXOR(F.shiftleft("lo", 16))
        rows = rows.select(*by, F.explode(spread).alias("cell"), F.lit(1).cast("long").alias("cnt"), F.col("k").alias("key_sum"), check.alias("hash_sum"))
        return cls(spec, cls.fold(rows, by), by)

    def subtract(self, other: Sketch) -> InvertibleBloomLookupTable:
        return self.merge(other.like(other.cells.withColumn("cnt", -F.col("cnt"))))

    def decode(self) -> DataFrame:
        """(key, side): 1 for keys that only this side has, -1 for the other's; a row (null, 0) if not all could be read.

        Cells that hold one key give it up everywhere, until none is left. A group is read back in one task, as its cells are as many as the
        difference that the table was sized for and not as the keys. Tables hashed with md5 alone can be read back.
        """
        spec = self.spec
        by = list(self.by)

        def peel(pdf):  # noqa: ANN001, ANN202
            import hashlib

            import pandas as pd

            quarter = spec["quarter"]
            cells = {int(c): [int(n), int(k), int(h)] for c, n, k, h in zip(pdf["cell"], pdf["cnt"], pdf["key_sum"], pdf["hash_sum"], strict=True)}

            def of(key: int) -> tuple[list[int], int]:
                if spec["hash"] != "md5":
                    raise ValueError("only md5 tables can be read back")
                d = hashlib.md5(str(key).encode()).hexdigest()
                hi, lo = int(d[:8], 16), int(d[8:16], 16)
                return [(lo + hi * (i + 1) & 0xFFFFFFFF) % quarter + i * quarter for i in range(4)], hi ^ lo << 16

            todo, out = [*cells], []
            while todo:
                c = todo.pop()
                n, k, h = cells[c]
                if abs(n) != 1:
                    continue
                places, check = of(k)
                if check != h or c not in places:
                    continue
                out.append((k, n))
                for p in places:
                    x = cells.setdefault(p, [0, 0, 0])
                    x[0], x[1], x[2] = x[0] - n, x[1] ^ k, x[2] ^ check
                    todo.append(p)
            if any(any(x) for x in cells.values()):
                out = [(None, 0)]
            made = pd.DataFrame(out, columns=["key", "side"])
            for b in by:
                made[b] = pdf[b].iloc[0]
            return made[[*by, "key", "side"]].astype({"key": "Int64"})

        types = dict(self.cells.dtypes)
        schema = ", ".join([*(f"`{b}` {types[b]}" for b in by), "key long", "side long"])
        grouped = self.cells.groupBy(*by) if by else self.cells.withColumn("__one", F.lit(0)).groupBy("__one")
        return grouped.applyInPandas(peel, schema)


def difference(a: DataFrame, b: DataFrame, key: str, size: int) -> DataFrame:
    """(key, side) of the keys that one of two tables has, from tables sized for ``size`` of them."""
    spec = InvertibleBloomLookupTable.sized(size)
    made = [InvertibleBloomLookupTable.build(x.select(key).distinct(), key, spec) for x in (a, b)]
    return made[0].subtract(made[1]).decode()
