"""BPE encoding and decoding by tree concatenation.

A text is normalised as the vocabulary file says and halved, at any character, until a part has at most ``LEAF`` characters. Leaves
are encoded on their own. Where two parts meet inside a run without white space, the pretokens around the join are cut and merged
anew in a window that grows until its first and its last pretoken are those that stood there before; and where a
pretoken itself was cut, its ids are joined the same way: a window of tokens is spelled out and merged anew, and grows until both its
ends are the tokens that stood there. Then every pair of neighbours is one that BPE keeps apart, so the ids are exactly those of the
whole. Long pretokens are halved in the same manner. Texts of more than ``PART`` characters are dealt out in parts of that size,
encoded in parallel and joined by document.

Read from the file: normaliser NFC, white space to a space, lower case; split by a pattern; byte symbols; word end
marked by a suffix on the last symbol; special strings are found in the raw text first. Only Latin text without control
characters takes the fast way through Python's own lower(); any other text goes through the file's own normaliser
and splitter. All merges are made here; the file's library makes none.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, read, released, without

#: Characters of a leaf, and first symbols of one in a long pretoken.
LEAF = 2048
SYMBOLS = 64
PART = 1 << 15
#: Entries of a young cache; when it is full it becomes the old one. Runs above SHORT characters are not kept.
CACHE = 120_000
SHORT = 64
#: Characters for which Python and the file's normaliser agree: printable ASCII, tab to carriage return, and Latin letters that NFC keeps and whose lower case is one character.
PLAIN = re.compile("[\t-\r -~ -įı-ňŊ-ž]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next of those from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def _plain(category: str) -> str:
    """The characters of PLAIN in a Unicode category, to stand in a character class."""
    return "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == category and PLAIN.fullmatch(c))


def strings_of(spec: dict) -> list[str | None]:
    """The string of each id."""
    table = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [table.get(i) for i in range(max(table) + 1)]


def joined(ids: list[int], strings: list[str | None]) -> str:
    """The file names no decoder, so tokens are joined by spaces; ids without a token are left out."""
    if len(ids) > 1:
        try:
            return " ".join(itemgetter(*ids)(strings))
        except (IndexError, TypeError):  # an id without a token
            pass
    n = len(strings)
    return " ".join([t for i in ids if i < n and (t := strings[i]) is not None])


@dataclass
class Run:
    """A long run without white space, or one that is cut: its pretokens and the ids of each."""

    words: list[str]
    ids: list[list[int]]

    def packed(self) -> bytes:
        return b"".join(pack(f"<{len(x)}I", *x) for x in self.ids)


@dataclass
class Piece:
    """A part of a text: its runs, their ids, and whether it begins and ends inside a run."""

    runs: list[str]
    ids: list[bytes | Run]
    opens: bool
    ends: bool

    def packed(self) -> bytes:
        try:
            return b"".join(self.ids)
        except TypeError:
            return b"".join([x.packed() if isinstance(x, Run) else x for x in self.ids])


class Bpe:
    """One vocabulary. ``encode`` gives ids, ``decode`` the text of ids, each as the file's own library does."""

    def __init__(self, path: str, leaf: int = LEAF, symbols: int = SYMBOLS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.leaf, self.symbols = leaf, symbols
        self.joins = self.token_joins = 0  # of parts, and of tokens within a pretoken
        self.path = path
        self.loaded: Tokenizer | None = None
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.strings = strings_of(spec)
        self.shift = len(self.strings).bit_length()
        self.mask = (1 << self.shift) - 1
        #: (left, right) in one number to (rank, merged) in one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << self.shift | vocab[b], rank << self.shift | vocab[a + b])
        chars = byte_symbols()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + suffix] for c in chars]
        self.opened = dict(zip(self.last, self.inner, strict=True)) if suffix else {}
        self.symbol_of = dict(zip(chars, self.inner, strict=True))
        self.suffix = suffix
        self.spellings: dict[int, list[int]] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = re.compile(split.replace("\\p{L}", _plain("L")).replace("\\p{N}", _plain("N")))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    @property
    def library(self) -> Tokenizer:
        """The file's own library: normaliser and splitter of texts beyond PLAIN."""
        if self.loaded is None:
            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    # Pretokens to ids

    def first_symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [inner[b] for b in raw]
        if raw:
            ids[-1] = self.last[raw[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: the pair of the lowest rank first, the leftmost of equals. ``ids`` may be changed."""
        if len(ids) > 40:
            return self.merge_heap(ids)
        get, shift, mask, none = self.merges.get, self.shift, self.mask, 1 << 62
        found = [get(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while found and (least := min(found)) != none:
            i = found.index(least)
            ids[i] = new = least & mask
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = get(new << shift | ids[i + 1], none)
            if i:
                found[i - 1] = get(ids[i - 1] << shift | new, none)
        return ids

    def merge_heap(self, ids: list[int]) -> list[int]:
        n, get, shift, mask = len(ids), self.merges.get, self.shift, self.mask
        ids, after, before = [*ids], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << shift | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            new = m & mask
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := get(new << shift | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (k := before[i]) >= 0 and (m := get(ids[k] << shift | new)) is not None:
                heapq.heappush(heap, (m, k, ids[k], new))
        return [x for x in ids if x >= 0]

    def spelled(self, token: int) -> list[int]:
        """A token as the symbols that BPE starts from."""
        found = self.spellings.get(token)
        if found is None:
            s = self.strings[token]
            end = bool(self.suffix) and s.endswith(self.suffix) and s not in self.symbol_of
            found = [self.symbol_of[c] for c in (s[: -len(self.suffix)] if end else s)]
            if end:
                found[-1] = self.last[self.inner.index(found[-1])]
            self.spellings[token] = found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the concatenation: a window around the join grows until both its ends agree. If ``left`` ends a word, it no
        longer does."""
        if not left or not right:
            return left + right
        self.token_joins += 1
        size = 4
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            begin = [s for t in left[i:] for s in self.spelled(t)]
            begin[-1] = self.opened.get(begin[-1], begin[-1])
            window = self.merge(begin + [s for t in right[:j] for s in self.spelled(t)])
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            size *= 2

    def tree(self, ids: list[int]) -> list[int]:
        """Halves on their own, then the join; ids are first symbols."""
        if len(ids) <= self.symbols:
            return self.merge(ids)
        half = len(ids) // 2
        return self.join(self.tree(ids[:half]), self.tree(ids[half:]))

    def word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            found = self.tree(self.first_symbols(word))
            if len(word) <= SHORT:
                if len(self.words) >= CACHE // 2:
                    self.words = {}
                self.words[word] = found
        return found

    # Runs, parts, texts

    def long(self, chars: str) -> Run:
        words = self.pretokens(chars)
        return Run(words, [self.word(w) for w in words])

    def run(self, chars: str) -> bytes | Run:
        """Ids of a run without white space; pretokens don't go beyond one."""
        if len(chars) > SHORT:
            return self.long(chars)
        found = self.old.get(chars)
        if found is None:
            ids = [i for w in self.pretokens(chars) for i in self.word(w)]
            found = pack(f"<{len(ids)}I", *ids)
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[chars] = found
        return found

    def part(self, chars: str) -> Piece:
        """A leaf: white space is single spaces."""
        runs = chars.strip(" ").split(" ") if chars != " " else []
        known, run = self.young.get, self.run
        return Piece(runs, [known(r) or run(r) for r in runs], chars[:1] != " ", chars[-1:] != " ")

    def concatenate(self, a: Piece, b: Piece) -> Piece:
        """The part that two neighbours make. A cut run is joined, the others stay."""
        self.joins += 1
        if a.ends and b.opens and a.runs and b.runs:
            left, right = a.ids.pop(), b.ids[0]
            before, after = a.runs.pop(), b.runs[0]
            both = self.join_runs(left if isinstance(left, Run) else self.long(before), right if isinstance(right, Run) else self.long(after))
            a.runs.append(before + after)
            a.ids.append(both if len(before) + len(after) > SHORT else both.packed())
            b.runs, b.ids = b.runs[1:], b.ids[1:]
        opens = a.opens if a.runs or not a.opens else b.opens
        return Piece(a.runs + b.runs, a.ids + b.ids, opens, b.ends)

    def join_runs(self, a: Run, b: Run) -> Run:
        """A run from its halves: pretokens around the join anew, in a window that grows until its first and last one agree.

        The first must begin three characters or more before the join, since the pattern looks that far; the last begins where one
        of ``b`` does, and from there on nothing changes.
        """
        size = 2
        while True:
            i, j = max(0, len(a.words) - size), min(len(b.words), size)
            left, right = a.words[i:], b.words[:j]
            words = self.pretokens("".join(left) + "".join(right))
            if (i == 0 or words[0] == left[0] and sum(map(len, left)) >= 3) and (j == len(b.words) or words[-1] == right[-1]):
                break
            size *= 2
        ids = []
        for w in words:
            cut = w == a.words[-1] + b.words[0] and len(w) > SHORT
            ids.append(self.join(a.ids[-1], b.ids[0]) if cut else self.word(w))
        return Run(a.words[:i] + words + b.words[j:], a.ids[:i] + ids + b.ids[j:])

    def text(self, chars: str, a: int, z: int) -> Piece:
        if z - a <= self.leaf:
            return self.part(chars[a:z])
        half = (a + z) // 2
        return self.concatenate(self.text(chars, a, half), self.text(chars, half, z))

    def normal(self, text: str) -> str:
        """The normalised text with single spaces for white space."""
        if PLAIN.fullmatch(text):
            return " ".join(text.lower().split())
        return self.library.normalizer.normalize_str(text)

    def pretokens(self, run: str) -> list[str]:
        if PLAIN.fullmatch(run):
            return self.split.findall(run)
        return [run[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(run)]

    def pieces(self, text: str) -> Iterator[str | int]:
        """The text between special strings, and the ids of those."""
        if self.special_cut and "<|" in text:
            for i, x in enumerate(self.special_cut.split(text)):
                if i % 2:
                    yield self.special[x]
                elif x:
                    yield x
        elif text:
            yield text

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                out.append(pack("<I", piece))
            elif normal := self.normal(piece):
                out.append(self.text(normal, 0, len(normal)).packed())
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return joined(ids, self.strings)

    # Parts of long texts

    def parts(self, text: str, size: int) -> list[tuple[str, int]]:
        """(characters, -1) for each part of ``size`` characters, cut wherever it falls, and ("", id) for special strings."""
        out: list[tuple[str, int]] = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                out.append(("", piece))
            else:
                normal = self.normal(piece)
                out += [(normal[i : i + size], -1) for i in range(0, len(normal), size)]
        return out

    def encode_part(self, chars: str) -> dict:
        """A part as it travels: its ids, and of its first and last run, if it begins or ends inside one, the pretokens and their ids."""
        p = self.text(chars, 0, len(chars))
        edge = lambda k: p.ids[k] if isinstance(p.ids[k], Run) else self.long(p.runs[k])
        alone = len(p.runs) == 1
        head = edge(0) if p.runs and (p.opens or alone) else None
        tail = edge(-1) if p.runs and p.ends and not alone else None
        a, z = int(head is not None), len(p.runs) - int(tail is not None)
        return {"head": _sent(head), "ids": Piece(p.runs[a:z], p.ids[a:z], False, False).packed(), "tail": _sent(tail), "opens": p.opens, "ends": p.ends}

    def join_parts(self, parts: list[tuple[int, dict | None]]) -> bytes:
        """Ids of the whole from its parts in order, joined by pairs as a tree; special strings stand between."""
        out: list[bytes] = []
        open_: list[Piece] = []

        def close() -> None:
            nonlocal open_
            while len(open_) > 1:
                open_ = [self.concatenate(*open_[i : i + 2]) if i + 1 < len(open_) else open_[i] for i in range(0, len(open_), 2)]
            out.extend(p.packed() for p in open_)
            open_ = []

        for special, sent in parts:
            if special >= 0:
                close()
                out.append(pack("<I", special))
                continue
            # Runs that are no edge have no text here; they are never cut.
            inner = [*([_run(sent["head"])] if sent["head"] else []), sent["ids"], *([_run(sent["tail"])] if sent["tail"] else [])]
            if sent["head"] and not sent["tail"] and not sent["ids"]:
                inner = inner[:1]
            open_.append(Piece(["".join(x.words) if isinstance(x, Run) else "" for x in inner], inner, sent["opens"], sent["ends"]))
        close()
        return b"".join(out)


def _sent(run: Run | None) -> dict | None:
    return None if run is None else {"words": run.words, "n": [len(x) for x in run.ids], "ids": run.packed()}


def _run(sent: dict) -> Run:
    ids = np.frombuffer(sent["ids"], "<u4").tolist()
    ends = np.cumsum(sent["n"], dtype=np.int64).tolist()
    return Run(sent["words"], [ids[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def strings(path: str) -> list[str | None]:
    with open(path, encoding="utf-8") as f:
        return strings_of(json.load(f))


def forgetting(f):  # noqa: ANN001, ANN201
    """A function over batches that drops the vocabulary at the end of its task, as idle workers would keep it."""

    @wraps(f)
    def run(batches):  # noqa: ANN001, ANN202
        yield from f(batches)
        vocabulary.cache_clear()

    return released(run)


RUN = "struct<words: array<string>, n: array<int>, ids: binary>"
TRAVELS = f"struct<head: {RUN}, ids: binary, tail: {RUN}, opens: boolean, ends: boolean>"
_RUN = pa.struct([("words", pa.list_(pa.string())), ("n", pa.list_(pa.int32())), ("ids", pa.binary())])
SENT = pa.struct([("head", _RUN), ("ids", pa.binary()), ("tail", _RUN), ("opens", pa.bool_()), ("ends", pa.bool_())])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", part: int = PART, decoded: str | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``out``: ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Rows stay as many as they are; repeated rows have equal results. Texts
    above ``part`` characters are encoded by parts in parallel; only these are shuffled. ``decoded`` names a column for what
    the ids decode to, made from the ids in the same pass.
    """
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), out.lower(), (decoded or out).lower()}]
    frame = lean(docs).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    row_type = frame.schema["row"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            for part_ in (b.slice(i, 1000) for i in range(0, len(b), 1000)):
                yield finished(bpe, part_.column(0), [bpe.encode_bytes(t.as_py()) for t in part_.column(1)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            for i in range(len(b)):
                t = b.column(1)[i].as_py()
                found = bpe.parts(t, part) or [("", -1)]
                n = len(found)
                # The row goes with the first part alone.
                rows = pa.concat_arrays([b.column(0).slice(i, 1), pa.nulls(n - 1, b.column(0).type)])
                yield pa.RecordBatch.from_arrays([rows, pa.array([b.column(2)[i].as_py()] * n), pa.array(range(n), pa.int32()), pa.array([x[1] for x in found]), pa.array([x[0] for x in found])], names=["row", "key", "at", "special", "chars"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            sent = [bpe.encode_part(c) if s < 0 else None for s, c in zip(b.column("special").to_pylist(), b.column("chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("at"), b.column("special"), pa.array(sent, SENT)], names=["row", "key", "at", "special", "sent"])

    def whole_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            for i in range(len(b)):
                ids = bpe.join_parts([(p["special"], p["sent"]) for p in b.column("parts")[i].as_py()])
                yield finished(bpe, b.column("row").slice(i, 1), [ids])

    def finished(bpe: Bpe, rows: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        cols, names = [rows, pa.array(ids, pa.binary())], ["row", "ids"]
        if decoded:
            cols.append(pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(cols, names=names)

    done = f"row {row_type}, ids binary" + ", decoded string" * bool(decoded)
    long = F.length("text") > part
    few = frame.where(~long).mapInArrow(forgetting(short), done)
    keyed = frame.where(long).withColumn("key", F.sha2(F.concat_ws("\x00", F.to_json("row"), "text"), 256))
    dealt = keyed.mapInArrow(forgetting(split), f"row {row_type}, key string, at int, special long, chars string").repartition("key", "at")
    # Equal rows have equal keys; each part then comes as many times as the row does.
    met = dealt.mapInArrow(forgetting(leaf), f"row {row_type}, key string, at int, special long, sent {TRAVELS}").groupBy("key", "at").agg(F.first("row").alias("row"), F.first("special").alias("special"), F.first("sent").alias("sent"), F.count("*").alias("n"))
    whole = met.groupBy("key").agg(F.first("row", ignorenulls=True).alias("row"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "special", "sent"))).alias("parts"))
    many = whole.select("row", "parts", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row", "parts").mapInArrow(forgetting(whole_ids), done)
    return few.unionAll(many).select("row.*", F.col("ids").alias(out), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` and ``out``: the text of the ids in the binary column ``ids``; null ids give the empty text."""

    @F.pandas_udf("string")
    def text_of(s):  # noqa: ANN001, ANN202
        table = strings(path)
        return s.map(lambda x: joined(np.frombuffer(x or b"", "<u4").tolist(), table))

    return without(df, out).withColumn(out, text_of(F.col(f"`{ids}`")))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    both = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
