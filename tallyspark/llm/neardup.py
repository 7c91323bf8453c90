"""Near copies at a Jaccard of word shingles, verified pair by pair.

Documents of equal shingle sets are one class, named by a 64-bit hash of the set. Candidates are pairs of classes whose SimHash
fingerprints are near, as the caller finds them, and classes that meet in the bands of a MinHash signature: of pairs at a
Jaccard of 0.8, 48 bands of five rows miss less than two in a hundred million, while fingerprints at 0.8 differ in any
number of bits. In each bucket of a band the classes are first compared with the smallest one. Then, in
buckets that hold several components, the others are compared with each other, block by block, where they lie: an upper bound of the
Jaccard from 16 bits of each shingle rejects nearly all, and what it leaves is verified. So every pair of a bucket is in one component already
or was compared, a large group of near copies sends its rows and not its pairs, and no pair is left out by an estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, cut, lean, released, runs_of

BANDS, ROWS = 48, 5
#: Classes of a bucket that are compared at once; a larger bucket is dealt in blocks of this size.
BLOCK = 512
CHUNK = 512
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_random = np.random.default_rng(42)
TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
PLUS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The hashes of the distinct runs of ``words`` words, ascending; a shorter text is one run, a text without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash64
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    n = len(w) - size + 1
    runs = np.full(n, size, np.uint64)
    for i in range(size):
        runs = runs * STEP + h[i : i + n]
    return np.unique(_mixed(runs))


def name(runs: np.ndarray) -> int:
    """The class of a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(runs.tobytes())).astype(np.int64))


def signature(runs: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(runs), CHUNK):
        np.minimum(least, (TIMES[:, None] * runs[i : i + CHUNK] + PLUS[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * STEP + column)
    return keys.view(np.int64)


def fingerprint(runs: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(runs), CHUNK):
        ones += np.unpackbits(runs[i : i + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(runs), bitorder="little").view("<i8")[0])


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(row, h, c, fp, keys) of the columns (row, h, text): the class, its fingerprint and band keys (none without words)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, fps, keys = [], [], []
            for t in b.column("text"):
                runs = shingles(t.as_py(), words)
                names.append(name(runs))
                fps.append(fingerprint(runs))
                keys.append(signature(runs) if len(runs) else [])
            longs = [pa.array(names, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("h"), *longs], names=["row", "h", "c", "fp", "keys"])

    kind = docs.schema["row"].dataType.simpleString()
    return lean(docs.select("row", "h", "text")).mapInArrow(released(add), f"row {kind}, h long, c long, fp long, keys array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(c, n, runs, sketch): the shingle set of each text as bytes, and the distinct upper 16 bits of its hashes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column(0)]
            columns = [pa.array([name(r) for r in found], pa.int64()), pa.array([len(r) for r in found], pa.int64())]
            columns += [pa.array([r.tobytes() for r in found], pa.binary()), pa.array([np.unique(r >> np.uint64(48)).astype("<u2").tobytes() for r in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "runs", "sketch"])

    return lean(texts).mapInArrow(released(add), "c long, n long, runs binary, sketch binary")


def _ratio(similarity: float) -> tuple[int, int]:
    at_least = Fraction(str(similarity))
    return at_least.numerator, at_least.denominator


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of classes, those at ``similarity`` or more."""
    top, bottom = _ratio(similarity)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if min(len(p), len(q)) * bottom < top * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common * bottom >= top * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("c").alias(k), F.col("runs").alias(f"runs_{k}")) for k in "ab")
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "runs_a", "runs_b")
    return lean(rows).mapInArrow(released(test), "a long, b long")


def _within(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes of one bucket and of different components that an upper bound puts at ``similarity`` or more.

    ``rows`` are (key, lo, hi, mine, c, root, n, keys, sketch), sorted by bucket and by pair of blocks. A pair is looked at in the first
    band alone that it shares. Of two sets, as many shingles are equal as upper bits are, and those that share their bits at most.
    """
    top, bottom = _ratio(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << 16, bool)
        for t in runs_of(batches, "key", "lo", "hi"):
            c, root, n, mine = (t.column(x).to_numpy() for x in ("c", "root", "n", "mine"))
            if (root == root[0]).all():
                continue
            key, lo, hi = (t.column(x)[0].as_py() for x in ("key", "lo", "hi"))
            keys = np.array(t.column("keys").to_pylist(), np.int64)
            bits = [np.frombuffer(x.as_buffer(), "<u2") for x in t.column("sketch")]
            size = np.array([len(x) for x in bits])
            a, b = [], []
            for i in np.flatnonzero(mine == lo):
                ok = (root != root[i]) & ((c > c[i]) if lo == hi else (mine == hi))
                k = np.flatnonzero(ok)
                k = k[(keys[k] == keys[i]).argmax(axis=1) == np.argmax(keys[i] == key)]
                if not len(k):
                    continue
                mark[bits[i]] = True
                shared = np.add.reduceat(mark[np.concatenate([bits[x] for x in k])], np.append(0, np.cumsum(size[k])[:-1]), dtype=np.int64)
                mark[bits[i]] = False
                most = shared + np.minimum(n[i] - size[i], n[k] - size[k])
                k = k[most * bottom >= top * (n[i] + n[k] - most)]
                a.append(np.minimum(c[i], c[k]))
                b.append(np.maximum(c[i], c[k]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    return lean(rows).mapInArrow(released(compare), "a long, b long")


def _met(classes: DataFrame) -> DataFrame:
    """(key, c, first) of the buckets that hold several classes, ``first`` being the smallest one.

    Nearly all band keys have one class, so the rows are laid out and sent once; a bucket is judged where its rows meet, and spills if it is large.
    """
    bucket = Window.partitionBy("key")
    listed = classes.select("c", F.explode("keys").alias("key"))
    listed = listed.withColumns({"first": F.min("c").over(bucket), "last": F.max("c").over(bucket)})
    return listed.where("first < last").select("key", "c", "first")


def links(s: Scratch, classes: DataFrame, docs: DataFrame, similarity: float, words: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of classes at ``similarity`` or more, enough to join all that such pairs join.

    ``classes`` has a row (c, h, fp, keys) for each class, ``docs`` (h, text) for at least one text of each. ``near`` gives the
    pairs (a, b) of near ones of the distinct fingerprints ``fp``.
    """
    fps = s.table(classes.groupBy("fp").agg(F.min("c").alias("first"), F.max("c").alias("last")))
    same = classes.join(fps.where("first < last").select("fp", "first"), "fp").where("c <> first").select(F.col("first").alias("a"), F.col("c").alias("b"))
    x, y = (fps.select(F.col("fp").alias(f"fp_{k}"), F.col("first").alias(k)) for k in "xy")
    close = near(fps.select("fp")).join(x, F.col("a") == F.col("fp_x")).join(y, F.col("b") == F.col("fp_y"))
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    listed = s.table(_met(classes))
    star = listed.where("first < c").select(F.col("first").alias("a"), F.col("c").alias("b"))
    star = s.table(star.unionAll(same).unionAll(close).distinct())
    asked = star.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    asked = classes.join(asked, "c", "left_semi").select("h").distinct()
    sets = s.table(_sets(docs.join(asked, "h", "left_semi").select("text"), words).dropDuplicates(["c"]))
    found = s.table(_verified(star, sets, similarity))
    rooted = listed.join(components(found), F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    rooted = s.table(rooted)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x < y")
    rows = rooted.join(mixed.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    rows = rows.join(classes.select("c", "keys"), "c").join(sets.select("c", "n", "sketch"), "c")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "c", "root", "n", "keys", "sketch")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rest = s.table(_within(rows, similarity).distinct())
    return found.unionAll(s.table(_verified(rest, sets, similarity)))


def grouped(docs: DataFrame, near: Callable[[DataFrame], DataFrame], similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(row, root) of the columns (row, text): rows have the same root if pairs at ``similarity`` or more join them.
    Null texts count as empty; those without words are alike. The root is the class of one of them."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    with Scratch(docs.sparkSession) as s:
        rows = s.table(signed(docs.select("row", F.xxhash64("text").alias("h"), "text"), words))
        classes = s.table(rows.where(F.size("keys") > 0).select("c", "h", "fp", "keys").dropDuplicates(["c"]))
        roots = components(links(s, classes, texts, similarity, words, near))
        out = rows.join(roots, F.col("c") == F.col("node"), "left").select("row", F.coalesce("root", "c").alias("root"))
        return cut(out)
