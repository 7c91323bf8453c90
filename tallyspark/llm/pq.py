"""Embedding near-duplicates by product quantisation.

Equal vectors of a label are one class. A coarse k-means deals the classes to inverted lists; what is left after the
centroid is coded by sub-space. A vector looks into every list whose border may lie within half the link distance: of
two vectors that near, one lies at most that far from the border between their cells, so one of them finds the other
and no link is lost to the lists. In a list, the table-lookup distance less the code's own error bounds the true
distance from below; what may be near is ranked again by exact cosine in double precision.

The first lists are as many as the table needs for PER_LIST vectors each, up to LISTS, since every executor holds their centroids. A list
that has more than MEMBERS is dealt anew, with centroids of its own that only its rows meet: a member goes to one smaller list, a visitor to
all whose border lies within the whole link distance, so it finds each member that near. This goes on until lists are
small; one that doesn't fall apart, as its vectors are all near each other, is cut in blocks of members and of visitors. So no list is gathered
in one task; a block returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, lean, read

#: Vectors that centroids and codes are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
PER_LIST, LISTS = 256, 2048
CODES = 32
#: Members and visitors of a block; a list of more members is dealt anew, from a sample of about AGAIN of them, in SPLIT lists at most.
MEMBERS, VISITORS = 1024, 8192
AGAIN, SPLIT, ROUNDS = 2048, 64, 6
#: Vectors of a length that this few have are one list without codes.
RARE = 512
EPS = 1e-9


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dim
    cuts: list[slice]  # the sub-spaces
    books: list[np.ndarray]  # by sub-space: codes x its dims
    apart: np.ndarray  # distances between centroids

    def place(self, x: np.ndarray) -> np.ndarray:
        return 1.0 + (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the error of each."""
        out = np.zeros((len(rest), len(self.cuts)), np.uint8)
        error = np.zeros(len(rest))
        for j, (s, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            d = ((rest[:, s] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * rest[:, s] @ book.T).clip(0)
            out[:, j] = d.argmin(axis=1)
            error += ((rest[:, s] - book[out[:, j]]) ** 2).sum(axis=1)
        return out, np.sqrt(error)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(axis=1) - 2 * part @ c.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, n: int, seed: int = 11) -> Quantiser:
    """Centroids and codes from a sample of the unit vectors; ``n``, the number of all, sets how many lists there are."""
    rng = np.random.default_rng(seed)
    c = kmeans(sample, int(np.clip(n // PER_LIST, 1, min(LISTS, max(1, len(sample) // 8)))), rng)
    near = ((c**2).sum(axis=1) - 2 * sample @ c.T).argmin(axis=1)
    rest = sample - c[near]
    dim = sample.shape[1]
    edges = np.linspace(0, dim, min(8, dim) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    books = [kmeans(rest[:, s], CODES, rng) for s in cuts]
    return Quantiser(c, cuts, books, _apart(c))


def _apart(c: np.ndarray) -> np.ndarray:
    return np.sqrt((((c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)) - 2 * c @ c.T).clip(0))


def single(dim: int) -> Quantiser:
    """One list, and a code that tells nothing: all its vectors are compared."""
    return Quantiser(np.zeros((1, dim)), [slice(0, dim)], [np.zeros((1, dim))], np.zeros((1, 1)))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v: str):  # noqa: ANN202
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0)


def links(classes: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(a, b, n): of classes (cid, label, dim, embedding, copies), a spanning forest of the links as rows (a, b, null),
    and as (a, null, n) how many vectors of other classes each is linked to (to be summed)."""
    dims = [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().where(F.col("count") > RARE).collect()]  # lengths that many vectors have
    made = {}
    for dim, n in dims:
        rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("cid"), "cid").select("embedding").limit(SAMPLE).toArrow()
        made[dim] = fit(_units(rows.column(0).combine_chunks(), dim), n)
    reach = float(np.sqrt(2 - 2 * cosine))
    sent = classes.sparkSession.sparkContext.broadcast(made)  # at most LISTS centroids for each length

    def index(batches):  # noqa: ANN001, ANN202
        for b in batches:
            dim_of = b.column("dim").to_numpy()
            for dim in np.unique(dim_of):
                q = sent.value.get(int(dim)) or single(int(dim))
                p = b.filter(pa.array(dim_of == dim))
                x = _units(p.column("embedding"), int(dim))
                d = q.place(x)
                own = d.argmin(axis=1)
                codes, error = q.codes(x - q.centroids[own])
                visit = d - d[np.arange(len(x)), own][:, None] <= reach * q.apart[own] + EPS
                at, lists = np.nonzero(visit)
                lists = lists.astype(np.int32)
                sets = [row.tobytes() for row in np.split(lists, np.cumsum(visit.sum(axis=1))[:-1])]
                none = pa.nulls
                yield pa.RecordBatch.from_arrays([p.column("label"), p.column("dim"), pa.array(own.astype(np.int32)), pa.array(own.astype(np.int32)), p.column("cid"), p.column("copies"), p.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(sets, pa.binary())], names=names)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([p.column("label").take(take), p.column("dim").take(take), pa.array(lists), pa.array(own[at].astype(np.int32)), p.column("cid").take(take), p.column("copies").take(take), p.column("embedding").take(take), none(len(at), pa.binary()), none(len(at), pa.float64()), none(len(at), pa.binary())], names=names)

    names = ["label", "dim", "list", "own", "cid", "copies", "embedding", "codes", "error", "lists"]
    element = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    schema = f"label {label}, dim int, list int, own int, cid long, copies long, embedding {element}, codes binary, error double, lists binary"
    rows = cut(lean(classes.select("label", "dim", "cid", "copies", "embedding")).mapInArrow(index, schema))
    rows = rows.withColumn("path", F.lit(0).cast("long")).withColumn("was", F.lit(None).cast("long"))
    member = F.col("codes").isNotNull()
    cell = ["label", "dim", "list", "path"]
    for _ in range(ROUNDS):
        sizes = rows.groupBy(*cell).agg(F.count(F.when(member, 1)).alias("m"), F.count(F.when(~member, 1)).alias("v"), F.first("was").alias("was"))
        sizes = cut(sizes)  # a row for each list and label
        large = sizes.where(f"m > {MEMBERS} and (was is null or 2 * m <= was)").select(*cell, "m", F.ceil((F.col("m") + F.col("v")) / VISITORS).cast("int").alias("salts"))
        if large.isEmpty():
            break
        rows = cut(rows.join(large.select(*cell), cell, "left_anti").unionByName(_again(rows.join(large, cell), large, cell, reach)))
    sizes = sizes.select(*cell, F.ceil(F.col("m") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("v") / VISITORS).cast("int").alias("vb")).where("mb > 0 and vb > 0")
    dealt = rows.join(sizes, cell)
    mine = F.pmod(F.xxhash64("cid"), F.when(member, F.col("mb")).otherwise(F.col("vb"))).cast("int")
    other = F.sequence(F.lit(0), F.when(member, F.col("vb")).otherwise(F.col("mb")) - 1)
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("block", F.when(member, F.col("mine")).otherwise(F.col("other"))).withColumn("group", F.when(member, F.col("other")).otherwise(F.col("mine")))

    def near(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        here = t.column("list")[0].as_py()
        is_member = t.column("codes").is_valid()
        m, v = t.filter(is_member), t.filter(pa.compute.invert(is_member))
        out = ([], [], [])
        if len(m) and len(v):
            _near(m.combine_chunks(), v.combine_chunks(), dim, here, sent.value.get(dim) or single(dim), cosine, reach, out)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64(), mask=k(x)) for x, k in zip(out, (_none, _minus, _minus), strict=True)], names=["a", "b", "n"])

    return dealt.select(*cell, "block", "group", "own", "cid", "copies", "embedding", "codes", "error", "lists").groupBy(*cell, "block", "group").applyInArrow(near, "a long, b long, n long")


def _again(rows: DataFrame, large: DataFrame, cell: list[str], reach: float) -> DataFrame:
    """The rows of large lists (with m and salts of their list) in smaller lists, by ``path``.

    A list's centroids come from a sample of its members that their hashes choose; rows of a list meet them in parts of
    about VISITORS rows.
    """
    kind = dict(rows.dtypes)
    head = ", ".join(f"`{c}` {kind[c]}" for c in cell)

    def centres(t: pa.Table) -> pa.Table:
        x = _units(t.column("embedding").combine_chunks(), t.column("dim")[0].as_py())
        c = kmeans(x, int(np.clip(t.column("m")[0].as_py() * 2 // MEMBERS, 2, SPLIT)), np.random.default_rng(13))
        return pa.table({k: t.column(k).slice(0, 1) for k in cell} | {"c": pa.array([c.tobytes()], pa.binary())})

    def assigned(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.combine_chunks()
        if not len(t) or not len(right):
            return pa.table({c: left.column(c).slice(0, 0) for c in columns} | {"path": pa.array([], pa.int64()), "was": pa.array([], pa.int64())}).select(names)
        dim = t.column("dim")[0].as_py()
        c = np.frombuffer(right.column("c")[0].as_py()).reshape(-1, dim)
        x = _units(t.column("embedding").combine_chunks(), dim)
        d = 1.0 + (c**2).sum(axis=1) - 2 * x @ c.T
        own = d.argmin(axis=1)
        here = np.arange(len(c)) == own[:, None]
        # Of two vectors at the link distance, the second lies no further than that beyond the border to its list.
        visit = d - d[np.arange(len(x)), own][:, None] <= 2 * reach * _apart(c)[own] + EPS
        is_member = t.column("codes").is_valid().to_numpy(zero_copy_only=False)
        at, sub = np.nonzero(np.where(is_member[:, None], here, visit))
        out = t.take(pa.array(at))
        path = out.column("path").to_numpy() * (SPLIT + 1) + sub + 1
        return pa.table({k: out.column(k) for k in columns} | {"path": pa.array(path, pa.int64()), "was": out.column("m")}).select(names)

    names = [c for c in rows.columns if c not in ("m", "salts")]
    columns = [c for c in names if c not in ("path", "was")]
    schema = ", ".join(f"`{c}` {kind[c]}" for c in names)
    some = F.col("codes").isNotNull() & (F.pmod(F.xxhash64("cid", F.lit(3)), F.col("m")) < AGAIN)
    books = rows.where(some).select(*cell, "m", "embedding").groupBy(*cell).applyInArrow(centres, f"{head}, c binary")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("salts")).cast("int")).drop("salts")
    books = books.join(large.select(*cell, "salts"), cell).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return salted.groupBy(*cell, "salt").cogroup(books.groupBy(*cell, "salt")).applyInArrow(assigned, schema)


def _none(x: list[np.ndarray]) -> np.ndarray | None:
    return None


def _minus(x: list[np.ndarray]) -> np.ndarray | None:
    return (np.concatenate(x) < 0) if x else None


def _near(m: pa.Table, v: pa.Table, dim: int, here: int, q: Quantiser, cosine: float, reach: float, out: tuple[list, list, list]) -> None:
    col = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    y, x = _units(m.column("embedding").combine_chunks(), dim), _units(v.column("embedding").combine_chunks(), dim)
    codes = np.frombuffer(b"".join(m.column("codes").to_pylist()), np.uint8).reshape(len(m), -1)
    limit = (reach + col(m, "error") + 1e-6) ** 2
    y_id, x_id, own = col(m, "cid"), col(v, "cid"), col(v, "own")
    looks = [frozenset(np.frombuffer(s, np.int32).tolist()) for s in m.column("lists").to_pylist()]
    back = np.zeros((len(m), len(q.centroids)), bool)  # which lists each member looks into
    for i, s in enumerate(looks):
        back[i, list(s)] = True
    rest = x - q.centroids[here]
    found = []
    for at in range(0, len(x), 1024):
        part = rest[at : at + 1024]
        far = np.zeros((len(part), len(y)))
        for j, (s, book) in enumerate(zip(q.cuts, q.books, strict=True)):
            table = ((part[:, s] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part[:, s] @ book.T).clip(0)
            far += table[:, codes[:, j]]
        i, k = np.nonzero(far <= limit)
        i = i + at
        ok = np.ones(len(i), bool)
        same = own[i] == here
        ok[same] = x_id[i[same]] < y_id[k[same]]
        ok[~same] = (own[i[~same]] < here) | ~back[k[~same], own[i[~same]]]
        i, k = i[ok], k[ok]
        for a in range(0, len(i), 1 << 16):
            ii, kk = i[a : a + (1 << 16)], k[a : a + (1 << 16)]
            good = np.einsum("ij,ij->i", x[ii], y[kk]) >= cosine
            found.append((ii[good], kk[good]))
    i, k = (np.concatenate([f[z] for f in found]) if found else np.zeros(0, np.int64) for z in (0, 1))
    if not len(i):
        return
    nx, ny = col(v, "copies"), col(m, "copies")
    for ids, at, n in ((x_id, i, ny[k]), (y_id, k, nx[i])):
        total = np.bincount(at, weights=n, minlength=len(ids)).astype(np.int64)
        hit = np.nonzero(total)[0]
        out[0].append(ids[hit])
        out[1].append(np.full(len(hit), -1))
        out[2].append(total[hit])
    # A node's root is the smallest id its links lead to; an edge to it stands for them.
    ids, back_to = np.unique(np.concatenate([x_id[i], y_id[k]]), return_inverse=True)
    a, b = back_to[: len(i)], back_to[len(i) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    hit = np.nonzero(root != np.arange(len(ids)))[0]
    out[0].append(ids[hit])
    out[1].append(ids[root[hit]])
    out[2].append(np.full(len(hit), -1))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each vector; other columns are left out, and an empty table gives none.

    Vectors link within a label and a length at ``cosine`` or more. Vectors that are null, zero or hold null or
    non-finite numbers, and rows of null label, link with nothing. Rows of a null id count, but name no component.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    ok = F.coalesce(F.col("label").isNotNull() & _usable("embedding"), F.lit(False))
    grouped = v.where(ok).groupBy("label", "embedding").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = cut(cut(grouped).withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    found = cut(links(classes, cosine))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"))
    c = classes.join(counts, classes.cid == counts.a, "left").drop("a").join(roots, F.col("cid") == F.col("node"), "left")
    c = cut(c.select("label", "embedding", "first", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    least = cut(c.groupBy("root").agg(F.min("first").alias("component_id")))
    c = cut(c.join(least, "root").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id"))
    linked = v.where(ok).join(c, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("id", "n_links", "component_id")
    alone = v.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionAll(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
