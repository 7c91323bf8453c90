"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts in a document of
smaller id.

Sorting all suffixes of a corpus would move many times its size, so the strings are bucketed first. Each string of
LENGTH bytes has one anchor, its q-gram of the smallest hash; strings that are equal have equal anchors, and the Q bytes before or
behind the anchor too, whichever lie well within the string. These 2 Q bytes are its key. Keys of one document alone are
done. For the others, the bytes that the strings span meet by key, in parts. In a part the suffixes of these
bytes are sorted by bucket-pointer refinement: they start in buckets of their first eight bytes, each suffix points to its bucket, and a
bucket is refined by sorting its suffixes on the pointers at the offset to which it is known. New pointers stand at once, so the
next slice of buckets, and the buckets this one falls into, are sorted on them and reach further. In the finished order,
neighbours that share LENGTH bytes are equal strings. All comparisons are of bytes; hashes only choose anchors and parts.

What bounds memory. Documents travel in compressed blocks of BLOCK_BYTES; a text is one row in and out, so a longer one is a block
alone. There are as many parts as the corpus has PART_BYTES, whatever its size: keys go to COARSE of them first and from there, if
there are more, to their own. A task goes through its parts one after the other. A block sends each key once, and of
equal surroundings only those of its smallest document; a part keeps one of each kind and sends the others back at once, so a
passage that a third of all documents hold takes one place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, read, released, runs_of

LENGTH = 50
Q = 16
BLOCK_BYTES = 2 << 20
SEGMENT = 1 << 18
#: Bytes of text whose keys meet in one part; parts that keys go to at first; tasks of a shuffle, at most.
PART_BYTES = 6 << 20
COARSE = 4096
TASKS = 32768
#: Bytes of surroundings that are folded, and sorted, at once; suffixes of a slice; keys that are dealt from coarse parts at once.
FOLD_BYTES = 4 << 20
SORT_BYTES = 1 << 19
SLICE = 1 << 16
DEALT = 1 << 20
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
S32, S29, S16 = np.uint64(32), np.uint64(29), np.uint64(16)


def _words(b: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each of ``n`` places as a number."""
    return np.ndarray((n,), "<u8", b, strides=(1,))


def hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes at each place that has them."""
    n = len(b) - Q + 1
    h = _words(b, n) * A
    h ^= h >> S32
    h += _words(b[Q - 8 :], n) * B
    h ^= h >> S29
    h *= C
    h ^= h >> S32
    return h


def anchors(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: (first start, number of starts, place and hash of the anchor).

    ``ends`` are the ends of the documents in ``b``; strings lie within one. Of equal hashes the leftmost counts.
    """
    w = length - Q + 1
    first, count, place, found = [], [], [], []
    low = np.uint64((1 << (segment + length).bit_length()) - 1)
    for at in range(0, len(b) - length + 1, segment):
        part = b[at : at + segment + length - 1]
        if len(part) < length:
            break
        h = hashes(part)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= w:
            m = np.minimum(m[: len(m) - step], m[step:])
            step *= 2
        if w > step:
            m = np.minimum(m[: len(m) - (w - step)], m[w - step :])
        ok = np.ones(len(m), bool)
        for e in ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(part))]:
            ok[max(0, e - at - length + 1) : e - at] = False
        starts = np.flatnonzero(ok)
        if not len(starts):
            continue
        where = (m[starts] & low).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        first.append(starts[head] + at)
        count.append(np.diff(np.append(head, len(starts))))
        place.append(where[head] + at)
        found.append(h[where[head]])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(first, np.int64), cat(count, np.int64), cat(place, np.int64), cat(found, np.uint64)


def suffix_classes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Classes of the strings of ``length`` bytes at ``starts``, in their order: equal for equal strings.

    Bucket-pointer refinement of all suffixes. A pointer is the rank at which its bucket ends; ``depth`` tells, by pointer, how
    many bytes the suffixes of the bucket share. Slices end between buckets, so the suffixes of a bucket move together.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    grams = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    last = np.append(grams[1:] != grams[:-1], True)
    ends = np.flatnonzero(last)
    bucket = np.cumsum(last) - last
    pointer = np.full(n + length, -1, np.int64)  # -1: beyond the text
    pointer[order] = ends[bucket]
    depth = np.full(n, 8, np.int64)
    todo = np.flatnonzero(np.diff(ends, prepend=-1)[bucket] > 1)
    while len(todo):
        left = []
        for a, z in _slices(_whole(np.arange(len(todo)) // SLICE, pointer[order[todo]])):
            ranks = todo[a:z]
            at = order[ranks]
            own = pointer[at]
            offset = depth[own]
            later = pointer[at + offset]
            by = np.lexsort((later, own))
            at, own, later, offset = at[by], own[by], later[by], offset[by]
            last = np.append((own[1:] != own[:-1]) | (later[1:] != later[:-1]), True)
            known = offset + np.where(later < 0, length, depth[later])
            order[ranks] = at
            ends = ranks[last]
            pointer[at] = ends[np.cumsum(last) - last]
            depth[ends] = known[last]
            alone = last & np.append(True, last[:-1])
            left.append(ranks[~alone & (known < length)])
        todo = np.concatenate(left)
    mine = np.zeros(n, bool)
    mine[starts] = True
    at = order[mine[order]]
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        w = _words(padded[k:], n)[at]
        same &= w[1:] == w[:-1]
    found = np.zeros(n, np.int64)
    found[at] = np.cumsum(np.append(True, ~same))[: len(at)] - 1
    return found[starts]


def _whole(group: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """``group`` so that each run of one bucket lies in the group of its first."""
    if not len(group):
        return group
    opens = np.append(True, bucket[1:] != bucket[:-1])
    return group[np.flatnonzero(opens)[np.cumsum(opens) - 1]]


def _slices(group: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(group):
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        yield from zip(heads, [*heads[1:], len(group)], strict=True)


def _press(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _ident(h: np.ndarray, coarse: int, fine: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, identifier) of a key. The upper bits of its hash are the identifier: two keys of a part that are told apart by no bit are
    only sent in vain. With parts below the coarse ones the identifier chooses among them, so it has 48 bits and not 32."""
    ident = h >> (S32 if fine == 1 else S16)
    part = ((h & np.uint64(0xFFFF)) % np.uint64(coarse)) * np.uint64(fine)
    return (part + (ident * C >> S32) % np.uint64(fine)).astype(np.int64), ident


def _bundle(block: np.ndarray, ident: np.ndarray, many: np.ndarray) -> bytes:
    """Anchors of some blocks; identifiers ascend in a block, and their steps go byte plane by byte plane, as the upper ones hold little."""
    order = np.lexsort((ident, block))
    block, ident, many = block[order], ident[order], many[order]
    names, n = np.unique(block, return_counts=True)
    return _press(np.array([len(names), len(ident)], "<i8").tobytes() + names.astype("<i8").tobytes() + n.astype("<i8").tobytes() + _planes(np.diff(ident, prepend=np.uint64(0))) + np.packbits(many).tobytes())


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()


def _unbundle(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = _open(raw)
    m, n = np.frombuffer(raw, "<i8", 2)
    names, counts = np.frombuffer(raw, "<i8", 2 * m, 16).reshape(2, m)
    ident = np.cumsum(_from_planes(raw, n, 16 + 16 * m), dtype=np.uint64)
    many = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 + 16 * m + 8 * n), count=n).astype(bool)
    return np.repeat(names, counts), ident, many


def _load(ids: pa.Scalar, sizes: pa.Scalar, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, ends and ids of a block; documents without an id have none of their own (mask)."""
    b = np.frombuffer(_open(payload) + bytes(8), np.uint8)
    ends = np.cumsum(np.array(sizes.as_py(), np.int64))
    known = np.array([x is not None for x in ids.as_py()])
    return b[: len(b) - 8], ends, np.array([x or 0 for x in ids.as_py()], np.int64), known


def _block_runs(b: np.ndarray, ends: np.ndarray, known: np.ndarray, length: int, segment: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one key: (first start, number of starts, place of the key, its hash, document).

    Of the strings around an anchor, those that go ``half`` bytes or more to its left hold the Q bytes before it, the others those
    behind it.
    """
    first, count, place, _ = anchors(b, ends, length, segment)
    half = (length - Q + 1) // 2
    cuts = np.clip(place - half + 1, first, first + count)
    first, last, place = np.concatenate([first, cuts]), np.concatenate([cuts, first + count]), np.concatenate([place - Q, place])
    doc = np.searchsorted(ends, first, side="right")
    ok = last > first
    ok[ok] = known[doc[ok]]
    first, last, place, doc = first[ok], last[ok], place[ok], doc[ok]
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    h = np.zeros(len(first), np.uint64)
    for k in range(0, 2 * Q, 8):
        h = (h ^ _words(padded, len(b))[place + k]) * A
        h ^= h >> S32
    h *= C
    return first, last - first, place, h ^ h >> S29, doc


def _surroundings(b: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, width: int, length: int) -> np.ndarray:
    """Rows (place of the key, number of strings, the bytes they span), filled up with zeros to whole words."""
    padded = np.concatenate([b, np.zeros(width, np.uint8)])
    out = np.zeros((len(first), -(-(width + 2) // 8) * 8), np.uint8)
    out[:, 0], out[:, 1] = place - first, count
    for a in range(0, len(first), 1 << 14):
        z = a + (1 << 14)
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[first[a:z]]
        out[a:z, 2 : width + 2] = np.where(np.arange(width) < (count[a:z] + length - 1)[:, None], rows, 0)
    return out


def _kinds(rows: np.ndarray) -> np.ndarray:
    """A number for each row, equal only for equal rows (were hashes to collide, equal rows may get two numbers)."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for column in words.T:
        h = (h ^ column) * A
        h ^= h >> S32
    order = np.argsort(h, kind="stable")
    new = np.append(True, (words[order[1:]] != words[order[:-1]]).any(axis=1))[: len(rows)]
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    for a, z in _slices(keys[order]):
        yield int(keys[order[a]]), order[a:z]


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, segment: int = SEGMENT, coarse_parts: int = COARSE, as_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_bytes, n_removed, n_spans (long) and kept (binary: the other bytes).

    With ``as_text``, kept is a string, and of characters that are cut in two the other bytes fall out too. A null text has no bytes.
    Rows of a null id are kept whole and remove nothing. Rows of equal id don't remove from each other. Matches are
    judged on the input, within documents, byte by byte of UTF-8. An empty table gives none.
    """
    if not 3 * Q - 1 <= length <= 200:
        raise ValueError(f"length must be from {3 * Q - 1} to 200")
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    rest = [c for c in docs.columns if c.lower() not in {text.lower(), *new}]
    width = length - 1 + max((length - Q + 1) // 2, length - Q + 1 - (length - Q + 1) // 2)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    rest_type = frame.schema["rest"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            size = pa.compute.binary_length(t.column("text")).to_numpy().astype(np.int64)
            for a, z in _slices(np.cumsum(size) // block_bytes):
                s = t.slice(a, z - a)
                raw = b"".join(s.column("text").to_pylist())
                one = lambda c, s=s: pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([one(s.column("rest")), one(s.column("id")), one(pa.array(size[a:z])), pa.array([len(raw)]), pa.array([_press(raw, 3)], pa.binary())], names=["rest", "ids", "sizes", "raw", "payload"])

    packed = lean(frame).mapInArrow(released(pack), f"rest array<{rest_type}>, ids array<long>, sizes array<long>, raw long, payload binary")
    blocks = cut(packed.withColumn("b", F.monotonically_increasing_id()))
    total = blocks.agg(F.sum("raw")).first()[0] or 0
    parts = max(8, total // part_bytes + 1)
    coarse = min(parts, coarse_parts)
    fine = -(-parts // coarse)
    tasks = min(parts, TASKS)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each key of a block once, by coarse part, and whether two documents of the block have it."""
        for t in batches:
            for i in range(len(t)):
                b, ends, ids, known = _load(t.column("ids")[i], t.column("sizes")[i], t.column("payload")[i].as_py())
                _, _, _, h, doc = _block_runs(b, ends, known, length, segment)
                if not len(h):
                    continue
                part, ident = _ident(h, coarse, fine)
                part //= fine
                order = np.lexsort((ident, part))
                part, ident, doc = part[order], ident[order], ids[doc[order]]
                head = np.flatnonzero(np.append(True, (ident[1:] != ident[:-1]) | (part[1:] != part[:-1])))
                many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
                block = np.full(len(head), t.column("b")[i].as_py())
                yield bundles(part[head], block, ident[head], many)

    def bundles(part: np.ndarray, block: np.ndarray, ident: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        rows = [(p, _bundle(block[k], ident[k], many[k])) for p, k in _by(part)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["p", "anchors"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From coarse parts to their own parts."""
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for t in batches:
            for p, raw in zip(t.column("p").to_pylist(), t.column("anchors").to_pylist(), strict=True):
                block, ident, many = _unbundle(raw)
                held.append((_ident(ident << S16 | np.uint64(p), coarse, fine)[0], block, ident, many))
                n += len(ident)
                if n >= DEALT:
                    yield bundles(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield bundles(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys that two documents have, back to their blocks."""
        for t in runs_of(batches, "p"):
            p = t.column("p")[0].as_py()
            block, ident, many = (np.concatenate(x) for x in zip(*map(_unbundle, t.column("anchors").to_pylist()), strict=True))
            order = np.argsort(ident, kind="stable")
            s = ident[order]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            n = np.diff(np.append(head, len(s)))
            good = np.repeat((n > 1) | np.logical_or.reduceat(many[order], head), n)
            keep = order[good]
            rows = [(k, _bundle(block[keep[at]], ident[keep[at]], many[keep[at]])) for k, at in _by(block[keep])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["b", "p", "anchors"])

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around shared keys, by part; and what larger documents of the block repeat (parts below zero)."""
        for t in batches:
            for i in range(len(t)):
                b, ends, ids, known = _load(t.column("ids")[i], t.column("sizes")[i], t.column("payload")[i].as_py())
                first, count, place, h, doc = _block_runs(b, ends, known, length, segment)
                part, ident = _ident(h, coarse, fine)
                good = np.zeros(len(h), bool)
                by_part = dict(_by(part))
                for s in t.column("found")[i].as_py():
                    there = _unbundle(s["anchors"])[1]
                    at = by_part[s["p"]]
                    good[at] = there[np.minimum(np.searchsorted(there, ident[at]), len(there) - 1)] == ident[at]
                first, count, place, doc, part = (x[good] for x in (first, count, place, doc, part))
                if not len(first):
                    continue
                rows = _surroundings(b, first, count, place, width, length)
                kind = _kinds(rows)
                least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, kind, ids[doc])
                mine = ids[doc] == least[kind]
                start = first - np.append(0, ends[:-1])[doc]
                block = t.column("b")[i].as_py()
                if not mine.all():
                    data = _press(np.stack([doc[~mine], start[~mine], start[~mine] + count[~mine]]).astype("<i8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - block % tasks]), pa.array([block]), pa.array([0]), pa.array([data], pa.binary())], names=["p", "b", "n", "data"])
                at = np.flatnonzero(mine)
                for group in np.array_split(at, max(1, len(at) // 20_000)):
                    found = []
                    for p, k in _by(part[group]):
                        k = group[k]
                        span = np.arange(width) < (count[k] + length - 1)[:, None]
                        raw = _planes(np.concatenate([ids[doc[k]], doc[k], start[k]])) + rows[k, 0].tobytes() + rows[k, 1].tobytes() + rows[k, 2 : width + 2][span].tobytes()
                        found.append((p, len(k), _press(raw)))
                    if found:
                        ps, ns, data = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([block] * len(ps), pa.int64()), pa.array(ns, pa.int64()), pa.array(data, pa.binary())], names=["p", "b", "n", "data"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which strings around shared keys start in a smaller document; what blocks told goes on as it is."""
        part = Part(width, length)
        last = None
        for t in batches:
            for p, b, n, data in zip(*(t.column(c).to_pylist() for c in ("p", "b", "n", "data")), strict=True):
                if p < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([data], pa.binary())], names=["b", "data"])
                    continue
                if p != last:
                    yield from part.finish()
                    last = p
                yield from part.add(b, n, data)
        yield from part.finish()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(len(t)):
                b, ends, _, _ = _load(t.column("ids")[i], t.column("sizes")[i], t.column("payload")[i].as_py())
                begin = np.append(0, ends[:-1]).astype(np.int64)
                edge = np.zeros(len(b) + 1, np.int32)
                for data in t.column("told")[i].as_py() or []:
                    doc, start, end = np.frombuffer(_open(data), "<i8").reshape(3, -1)
                    np.add.at(edge, begin[doc] + start, 1)
                    np.add.at(edge, begin[doc] + end + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = begin[(begin < len(b)) & (ends > begin)]
                opens[inner] = gone[inner]
                total, spans = (np.append(0, np.cumsum(x)) for x in (gone, opens))
                left = [kept_of(b[s:e][~gone[s:e]].tobytes() if total[e] > total[s] else b[s:e].tobytes()) for s, e in zip(begin, ends, strict=True)]
                rows = t.column("rest").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([rows, pa.array(ends - begin), pa.array(total[ends] - total[begin]), pa.array(spans[ends] - spans[begin]), pa.array(left, pa.string() if as_text else pa.binary())], names=["rest", "n_bytes", "n_removed", "n_spans", "kept"])

    def kept_of(raw: bytes) -> bytes | str:
        return raw.decode("utf-8", "ignore") if as_text else raw

    proposed = blocks.select("b", "ids", "sizes", "payload").mapInArrow(released(propose), "p long, anchors binary")
    if fine > 1:
        proposed = proposed.repartition(coarse, "p").mapInArrow(released(deal), "p long, anchors binary")
    found = proposed.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(released(shared), "b long, p long, anchors binary")
    found = found.groupBy("b").agg(F.collect_list(F.struct("p", "anchors")).alias("found"))
    dealt = blocks.select("b", "rest", "ids", "sizes", "payload").repartition(tasks, "b")  # shuffled once, read twice
    near = dealt.join(found.repartition(tasks, "b").hint("shuffle_hash"), "b").select("b", "rest", "ids", "sizes", "payload", "found")
    sent = near.mapInArrow(released(surround), "p long, b long, n long, data binary").repartition(tasks, "p").sortWithinPartitions("p")
    told = sent.mapInArrow(released(judge), "b long, data binary")
    told = told.groupBy("b").agg(F.collect_list("data").alias("told")).repartition(tasks, "b")
    out = dealt.join(told.hint("shuffle_hash"), "b", "left").select("b", "rest", "ids", "sizes", "payload", "told")
    kind = "string" if as_text else "binary"
    return out.mapInArrow(released(keep), f"rest {rest_type}, n_bytes long, n_removed long, n_spans long, kept {kind}").select("rest.*", *new)


class Part:
    """Surroundings of one part as they come in. Of equal ones those of the smallest document are held; the others repeat it."""

    def __init__(self, width: int, length: int) -> None:
        self.width, self.length = width, length
        self.clear()

    def clear(self) -> None:
        self.new: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0
        self.held: tuple[np.ndarray, ...] | None = None

    def add(self, block: int, n: int, data: bytes) -> Iterator[pa.RecordBatch]:
        raw = _open(data)
        ids, docs, starts = _from_planes(raw, 3 * n).astype(np.int64).reshape(3, n)
        head = np.frombuffer(raw, np.uint8, 2 * n, 24 * n).reshape(2, n)
        rows = np.zeros((n, -(-(self.width + 2) // 8) * 8), np.uint8)
        rows[:, :2] = head.T
        span = np.arange(rows.shape[1] - 2) < (head[1].astype(np.int64) + self.length - 1)[:, None]
        rows[:, 2:][span] = np.frombuffer(raw, np.uint8, offset=26 * n)
        self.new.append((ids, np.full(n, block), docs, starts, rows))
        self.bytes += rows.nbytes
        if self.bytes >= FOLD_BYTES:
            yield from self.fold()

    def fold(self) -> Iterator[pa.RecordBatch]:
        """Send back what repeats a smaller document, hold the rest."""
        every = [*([self.held] if self.held else []), *self.new]
        ids, blocks, docs, starts, rows = (np.concatenate(x) for x in zip(*every, strict=True))
        self.new, self.bytes = [], 0
        kind = _kinds(rows)
        least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, kind, ids)
        gone = ids > least[kind]
        yield from told(blocks[gone], docs[gone], starts[gone], starts[gone] + rows[gone, 1])
        self.held = tuple(x[~gone] for x in (ids, blocks, docs, starts, rows))

    def finish(self) -> Iterator[pa.RecordBatch]:
        """Sort what is left: buckets are the anchors that several kinds of surroundings have."""
        if self.new:
            yield from self.fold()
        if self.held and len(self.held[0]):
            yield from self.sorted(*self.held)
        self.clear()

    def sorted(self, ids: np.ndarray, blocks: np.ndarray, docs: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = _kinds(rows)
        first = np.full(kind.max() + 1, len(kind))
        np.minimum.at(first, kind, np.arange(len(kind)))
        keys = np.take_along_axis(rows[first], rows[first, :1].astype(np.int64) + 2 + np.arange(2 * Q), axis=1)
        bucket = _kinds(keys)
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        one = np.minimum.reduceat(ids[first[order]], heads) == np.maximum.reduceat(ids[first[order]], heads)
        todo = order[~one[bucket[order]]]  # kinds, bucket by bucket, of buckets that several documents have
        hit_kind, hit_at = [], []
        size = rows[first[todo], 1].astype(np.int64) + self.length - 1
        for a, z in _slices(_whole(np.cumsum(size) // SORT_BYTES, bucket[todo])):
            k = first[todo[a:z]]
            count = rows[k, 1].astype(np.int64)
            span = count + self.length - 1
            text = rows[k, 2:][np.arange(rows.shape[1] - 2) < span[:, None]]
            of = np.repeat(np.arange(len(k)), count)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            same = suffix_classes(text, (np.cumsum(span) - span)[of] + inside, self.length)
            low = np.full(same.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, same, ids[k][of])
            hit = ids[k][of] > low[same]
            hit_kind.append(todo[a:z][of[hit]])
            hit_at.append(inside[hit])
        if not sum(map(len, hit_kind)):
            return
        k, at = np.concatenate(hit_kind), np.concatenate(hit_at)
        order = np.lexsort((at, k))
        k, at = k[order], at[order]
        heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)))
        k, begin, end = k[heads], at[heads], at[np.append(heads[1:], len(at)) - 1] + 1
        # Each row of a kind gets the runs of its kind.
        low, n = np.searchsorted(k, kind), np.searchsorted(k, kind, side="right") - np.searchsorted(k, kind)
        of = np.repeat(np.arange(len(kind)), n)
        run = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
        yield from told(blocks[of], docs[of], starts[of] + begin[run], starts[of] + end[run])


def told(block: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By block, the runs of strings [start, end) of its documents that go."""
    rows = [(k, _press(np.stack([doc[at], start[at], end[at]]).astype("<i8").tobytes())) for k, at in _by(block)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["b", "data"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
