"""SimHash near-duplicates by multi-index hashing over the two 32-bit halves of the fingerprint.

Fingerprints at three or fewer differing bits have a half that differs in at most one bit. So each distinct
fingerprint is listed once under each half (the tables) and looks up the ball of radius one around each half;
every candidate's whole distance is verified before it becomes a link. A bucket that holds more fingerprints
than ``hot_bucket`` is indexed anew on the other half, by 16-bit quarters with their own small balls, so no list of
candidates grows with a group of near copies and none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup
from .common import components, cut, lean, read, released, without

HALF = 0xFFFFFFFF
CHUNK = 1 << 15


def simhash64(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats counted; zero if there is no word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not w:
        return 0
    of = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    h = np.array([of(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, out: str = "fp") -> DataFrame:
    """The other columns of ``docs`` and ``out``: the fingerprint as a signed long. A null text counts as empty."""
    rest = without(docs.drop(text) if text in docs.columns else docs, out)
    kept = [c for c in rest.columns if c != text]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            fp = np.fromiter((simhash64(t.as_py(), words, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*kept, out])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(out)).schema
    return lean(frame).mapInArrow(released(add), schema)


def _halves(fp: Column) -> list[tuple[int, Column, Column]]:
    low, high = fp.bitwiseAND(F.lit(HALF).cast("long")), F.shiftrightunsigned(fp, 32)
    return [(0, low, high), (1, high, low)]


def _ball(key: Column, bits: int) -> Column:
    """The key and its neighbours that have one more bit set: of two keys one bit apart, one looks the other up."""
    one = lambda i: F.shiftleft(F.lit(1).cast("long"), i)
    flips = [F.when(key.bitwiseAND(F.lit(1 << i).cast("long")) == 0, key.bitwiseOR(F.lit(1 << i).cast("long"))) for i in range(bits)]
    return F.array_compact(F.array(key, *flips))


def _tagged(keys: Column, tag: str, value: int, name: str) -> Column:
    return F.transform(keys, lambda x: F.struct(F.lit(value).alias(tag), x.alias(name)))


def _listed(fps: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("half"), k.alias("key")) for s, k, _ in _halves(F.col("fp"))])
    return fps.select("fp", F.explode(rows).alias("r")).select("r.*", "fp")


def links(fps: DataFrame, bits: int = 3, hot_bucket: int = 64) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` at ``bits`` (at most 3) or fewer differing bits, each once."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves with balls of radius one find distances up to 3")
    table = _listed(fps)
    rows = F.concat(*[_tagged(_ball(k, 32), "half", s, "key") for s, k, _ in _halves(F.col("fp"))])
    probes = fps.select("fp", F.explode(rows).alias("r")).select("r.*", F.col("fp").alias("x"))
    heavy = cut(table.groupBy("half", "key").count().where(F.col("count") > hot_bucket).select("half", "key"))
    if heavy.isEmpty():
        return _verified(probes, table, ["half", "key"], bits)
    # A bucket is heavy or not on both sides alike, so each pair is found on one of the two ways.
    mark = lambda df: df.join(heavy.withColumn("hot", F.lit(True)), ["half", "key"], "left")
    p, t = cut(mark(probes)), cut(mark(table))
    calm = _verified(p.where("hot is null").drop("hot"), t.where("hot is null").drop("hot"), ["half", "key"], bits)
    return calm.union(_refined(p.where("hot").drop("hot"), t.where("hot").drop("hot"), bits))


def _other(fp: str) -> Column:
    return F.when(F.col("half") == 0, F.shiftrightunsigned(F.col(fp), 32)).otherwise(F.col(fp).bitwiseAND(F.lit(HALF).cast("long")))


def _refined(probes: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """Heavy buckets, by the quarters of the other half: at most 2^16 fingerprints share all of a finer key."""
    quarter = lambda c: [(0, c.bitwiseAND(F.lit(0xFFFF).cast("long"))), (1, F.shiftrightunsigned(c, 16))]
    keys = lambda c: F.array(*[F.struct(F.lit(q).alias("quarter"), k.alias("fine")) for q, k in quarter(c)])
    balls = lambda c: F.concat(*[_tagged(_near(k), "quarter", q, "fine") for q, k in quarter(c)])
    t = table.select("half", "key", "fp", F.explode(keys(_other("fp"))).alias("r")).select("half", "key", "r.*", "fp")
    p = probes.select("half", "key", "x", F.explode(balls(_other("x"))).alias("r")).select("half", "key", "r.*", "x")
    return _verified(p, t, ["half", "key", "quarter", "fine"], bits).distinct()


def _near(key: Column) -> Column:
    return F.array(key, *[key.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(16)])


def _verified(probes: DataFrame, table: DataFrame, on: list[str], bits: int) -> DataFrame:
    """Candidates at ``bits`` or fewer. Where the half looked up is equal, both sides find the pair and one reports
    it; where it differs, only the side without the bit finds it. A pair near in both halves is left to the first."""
    diff = F.col("x").bitwiseXOR(F.col("fp"))
    low, high = F.bit_count(diff.bitwiseAND(F.lit(HALF).cast("long"))), F.bit_count(F.shiftrightunsigned(diff, 32))
    first = F.col("x") < F.col("fp")
    once = F.when(F.col("p.half") == 0, (low == 1) | first).otherwise((low > 1) & ((high == 1) | first))
    cond = (F.bit_count(diff) <= bits) & (F.col("x") != F.col("fp")) & once
    for c in on:
        cond = (F.col(f"p.{c}") == F.col(f"t.{c}")) & cond
    return probes.alias("p").join(table.alias("t"), cond).select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 3, words: int = 3) -> DataFrame:
    """Rows (id, fp, component_id): one for each row of ``docs``; component_id is the smallest id reachable by links.

    Null and empty texts have the fingerprint zero and link like any other; rows with equal fingerprints are linked.
    Rows of null id get a component like the others, but never name it (null where all ids of a component are null).
    """
    fps = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))))
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(reps.select("fp"), bits))
    grouped = cut(reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(grouped.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(grouped.join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Of each group of rows that pairs at a Jaccard of ``similarity`` or more join, the first one by id, then by the hashes
    of its text and of the whole row; of rows that are equal one. Rows of a null id stay.

    Multi-index hashing over the fingerprints of the shingle sets proposes the close copies; at 0.8 fingerprints differ in any
    number of bits, so the bands of ``neardup`` propose the rest, and every pair is verified by its Jaccard.
    """
    cols = [f"`{c}`" for c in docs.columns]
    place = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("text"), F.xxhash64(*cols).alias("row"))
    rows = neardup.grouped(docs.select(place.alias("row"), F.col(f"`{text}`").alias("text")), links, similarity, words)
    known = rows.where("row.id is not null")
    first = known.groupBy("root").agg(F.min("row").alias("row")).select("row")
    first = cut(known.join(first, "row", "left_semi").groupBy("row").agg(F.count("*").alias("n")).select("row.*", "n"))  # equal rows by their number
    packed = docs.select(F.struct(*cols).alias("own"), place.alias("at")).select("own", "at.*")
    alone = packed.join(first.where("n = 1"), ["id", "text", "row"], "left_semi").select("own")
    one = packed.join(first.where("n > 1"), ["id", "text", "row"], "left_semi").dropDuplicates(["id", "text", "row"]).select("own")
    return alone.unionAll(one).select("own.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
