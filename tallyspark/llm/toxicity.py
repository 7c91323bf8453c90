"""Toxicity by a small convolutional text classifier that is trained here, in numpy.

Words and the heads of words are hashed into one table of embeddings; a word is the sum of its own. Filters of
widths one to three run over the words, each is max-pooled over the whole text, and a logistic layer makes the score.
For scoring, a word's products with all filters are added up once and kept, so a text costs a table look-up and a few
sums a word. A part of the training rows sets the thresholds: one of all rows, which is moved to score 0.5, and one by
language beside the score.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, lean, read, released, without

TABLE = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bounds of the training sample: this many labelled rows of each class at most, and bytes of their texts, taken by hash of their id.
SAMPLE = 4000
SAMPLE_BYTES = 32 << 20
#: Times that each row is learnt from: at least so often, and more often while few rows would make few steps.
EPOCHS, MORE_EPOCHS, ROWS_LEARNT = 4, 12, 24_000
CACHE = 50_000
EDGE = ".,;:!?\"'()[]{}<>*#$%&|«»…-_"


def pieces(word: str) -> tuple[int, int, int]:
    """Places in the table of a word and of its heads of 4 and 6 characters."""
    w = word.lower().strip(EDGE) or word
    b = w.encode("utf-8", "surrogatepass")
    of = zlib.crc32
    return of(b) % TABLE, of(b"4" + w[:4].encode("utf-8", "surrogatepass")) % TABLE, of(b"6" + w[:6].encode("utf-8", "surrogatepass")) % TABLE


@dataclass
class Cnn:
    """The trained numbers. ``scores`` is what the operator runs; ``shift`` moves the threshold to 0.5."""

    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # by language
    _rows: dict[str, int] = field(default_factory=dict)
    _cells: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"} | {"_rows": {}, "_cells": None}

    def forget(self) -> None:
        """Drop what was kept of the words."""
        self._rows, self._cells = {}, None

    def _learn(self, words: list[str]) -> None:
        """Add the products of new words with all filters; row 0 is the padding."""
        if self._cells is None:
            self._cells = np.zeros((1024, sum(WIDTHS) * FILTERS), np.float32)
            self._places = self.table @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        first = len(self._rows) + 1
        while first + len(words) > len(self._cells):
            self._cells = np.concatenate([self._cells, np.zeros_like(self._cells)])
        if words:
            self._cells[first : first + len(words)] = self._places[np.array([pieces(w) for w in words])].sum(axis=1)
            self._rows.update(zip(words, range(first, first + len(words)), strict=True))

    def pooled(self, text: str, chunk: int = 1 << 14) -> np.ndarray:
        """The largest answer of each filter over the text, in chunks that overlap by the widest filter."""
        words = text.split()
        best = np.full(len(self.bias), -np.inf, np.float32)
        step = max(WIDTHS) - 1
        for at in range(0, max(len(words), 1), chunk):
            part = words[at : at + chunk + step]
            if len(self._rows) + len(part) >= CACHE:
                self._rows.clear()
            known = self._rows
            self._learn([w for w in dict.fromkeys(part) if w not in known])
            rows = [*map(known.__getitem__, part), *([] if part else [0]), *[0] * step]
            last = at + chunk >= len(words)  # windows that go beyond a chunk belong to it, but not the padding
            cells = self._cells[rows]
            col = 0
            for k, w in enumerate(WIDTHS):
                n = len(rows) - w + 1
                z = cells[:n, col : col + FILTERS]
                for j in range(1, w):
                    col += FILTERS
                    z = z + cells[j : n + j, col : col + FILTERS]
                col += FILTERS
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                best[own] = np.maximum(best[own], z[: max(len(part), 1) if last else chunk].max(axis=0))
        return best

    def logit(self, text: str) -> float:
        return float(np.maximum(self.pooled(text) + self.bias, 0) @ self.out + self.out_bias)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.logit(text or "") - self.shift, -30, 30))))


def constant(rate: float) -> Cnn:
    """What there is without labels of both classes: the rate, for every text."""
    z = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    return Cnn(np.zeros((TABLE, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), z)


def train(texts: list[str], labels: list[int], weights: list[float], langs: list[str], epochs: int | None = None, seed: int = 7, batch: int = 32) -> Cnn:
    """Fit on four fifths of the rows, set the thresholds on the others (weighted to what the corpus holds)."""
    y = np.array(labels, np.float32)
    if len(y) < 20 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    epochs = epochs or min(MORE_EPOCHS, max(EPOCHS, ROWS_LEARNT // len(y)))
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    bags = array("i")  # three places a word
    docs = []
    for t in texts:
        ids = []
        for w in t.split():
            if (k := seen.get(w)) is None:
                k = seen[w] = len(bags) // 3
                bags.extend(pieces(w))
            ids.append(k)
        docs.append(np.array(ids or [-1], np.int32))
    del seen
    pad, longest = len(bags) // 3, 3
    bag = np.full((pad + 1, longest), TABLE, np.int32)  # row TABLE of the table is zero
    bag[:pad] = np.frombuffer(bags, np.int32).reshape(pad, 3)
    del bags
    table = np.concatenate([rng.normal(0, 0.05, (TABLE, DIM)), np.zeros((1, DIM))]).astype(np.float32)
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, out, out_bias = np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32)
    moments = {}

    def adam(name: str, p: np.ndarray, g: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        m, v, t = moments.setdefault(name, [np.zeros_like(p), np.zeros_like(p), 0])
        moments[name][2] = t = t + 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.98 * v[at] + 0.02 * g * g
        p[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.98**t)) + 1e-6)

    order = rng.permutation(len(docs))
    hold = order[: max(len(docs) // 5, 1)]
    fit = order[len(hold) :]
    step = max(WIDTHS) - 1
    tail = np.full(step, pad, np.int32)
    for epoch in range(epochs):
        rate = 0.01 * (0.6**epoch)
        # Of like length together, so that a batch is even; the batches in random order.
        by = fit[np.argsort([len(docs[i]) + rng.random() for i in fit])]
        for b in rng.permutation(-(-len(by) // batch)):
            own = by[b * batch : (b + 1) * batch]
            ids = np.concatenate([np.concatenate([np.where(docs[i] < 0, pad, docs[i]), tail]) for i in own])
            sizes = np.array([len(docs[i]) for i in own])
            starts = np.cumsum([0, *(sizes[:-1] + step)])
            unique, back = np.unique(ids, return_inverse=True)
            word = table[bag[unique]].sum(axis=1)  # by unique word
            pooled, where = [], []
            for w, f in zip(WIDTHS, filters, strict=True):
                z = np.zeros((len(ids), FILTERS), np.float32)
                for j in range(w):
                    z[: len(ids) - j] += (word @ f[j])[back[j:]]
                inside = np.zeros(len(ids), bool)
                for s, n in zip(starts, sizes, strict=True):
                    inside[s : s + n] = True
                z[~inside] = -1e9
                at = np.stack([s + z[s : s + n].argmax(axis=0) for s, n in zip(starts, sizes, strict=True)])
                where.append(at)
                pooled.append(np.take_along_axis(z, at, axis=0))
            h = np.concatenate(pooled, axis=1) + bias
            a = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(a @ out + out_bias, -30, 30)))
            d = (p - y[own]) / len(own)
            da = (d[:, None] * out) * (h > 0)
            g_word = np.zeros_like(word)
            for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                part = da[:, k * FILTERS : (k + 1) * FILTERS]
                g_f = np.zeros_like(f)
                for j in range(w):
                    rows = back[where[k] + j]  # documents x filters
                    g_f[j] = np.einsum("bf,bfd->df", part, word[rows])
                    np.add.at(g_word, rows, part[:, :, None] * f[j].T[None])
                adam(f"f{k}", f, g_f, rate)
            used = np.nonzero(np.any(g_word != 0, axis=1))[0]
            g_table = np.zeros((TABLE + 1, DIM), np.float32) if len(used) else None
            if g_table is not None:
                np.add.at(g_table, bag[unique[used]].ravel(), np.repeat(g_word[used], longest, axis=0))
                rows = np.unique(bag[unique[used]])
                rows = rows[rows < TABLE]
                adam("table", table, g_table[rows], rate, rows)
            adam("bias", bias, da.sum(axis=0), rate)
            adam("out", out, a.T @ d + 1e-5 * out, rate)
            adam("out_bias", out_bias, np.array([d.sum()], np.float32), rate)
    made = Cnn(table[:TABLE], filters, bias, out, float(out_bias[0]))
    logits = np.array([made.logit(texts[i]) for i in hold])
    w = np.array(weights)[hold]
    made.shift = _threshold(logits, y[hold], w)
    for lang in sorted({langs[i] for i in hold if langs[i] is not None}):
        mine = np.array([langs[i] == lang for i in hold])
        if min((y[hold][mine] == c).sum() for c in (0, 1)) >= 20:
            cut = _threshold(logits[mine], y[hold][mine], w[mine])
            made.thresholds[lang] = 1 / (1 + float(np.exp(-np.clip(cut - made.shift, -30, 30))))
    return made


def _threshold(logits: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut of the best weighted F1, in the middle of the gap it lies in."""
    order = np.argsort(-logits)
    hit = np.cumsum(w[order] * y[order])
    f1 = 2 * hit / (np.cumsum(w[order]) + (w * y).sum())
    k = int(np.argmax(f1))
    ordered = logits[order]
    return float((ordered[k] + ordered[k + 1]) / 2) if k + 1 < len(ordered) else float(ordered[k])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by five. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, class_bytes: int = SAMPLE_BYTES) -> Cnn:
    """Train on at most ``per_class`` labelled rows of each class that are not held out, taken by hash of the id while their texts have
    ``class_bytes`` bytes. Of rows that repeat an id the text of the smallest hash counts; a null text counts as empty. Without
    documents or labels, every text gets the rate of the labels as its score."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * per_class rows
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("lang", "text", "toxic"), F.struct(F.xxhash64("text"), "lang")).alias("one")).select("doc_id", "one.*")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < class_bytes).orderBy("doc_id").select("text", "toxic", "lang").toArrow()
    texts, y, langs = (rows.column(k).to_pylist() for k in range(3))
    del rows
    share = {c: counts.get(c, 0) / max(1, y.count(c)) for c in (0, 1)}
    made = train(texts, y, [share[c] for c in y], langs)
    del texts
    give_back()  # what the driver held for the training
    return made


def score(docs: DataFrame, model: Cnn, text: str = "text") -> DataFrame:
    """``docs`` with score and threshold (that of the row's language for the verdict ``rejected``).

    The score sees the text alone; a null text counts as empty. Languages without a threshold of their own take 0.5. Rows stay as they
    are, repeated ones too; an empty table gives none.
    """
    spark = docs.sparkSession
    base = without(docs, "score", "threshold", "rejected")
    sent = spark.sparkContext.broadcast(model)  # bounded: the table and the filters, 4 MB

    names = base.columns

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for b in batches:
            found = pa.array([made.score(t.as_py()) for t in b.column(names.index(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*names, "score"])
        made.forget()

    limits = F.lit(0.5)
    if "lang" in base.columns:
        for lang, x in model.thresholds.items():
            limits = F.when(F.col("lang") == lang, F.lit(x)).otherwise(limits)
    out = lean(base).mapInArrow(released(scores), base.withColumn("score", F.lit(0.5)).schema).withColumn("threshold", limits)
    return out.withColumn("rejected", F.col("score") >= F.col("threshold"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
