"""Sketches as bytes: an envelope with a checksum around the cells, and tables of envelopes.

Envelope: magic, version (u16), kind (u16 length and UTF-8), hash (the same), payload length (u32), payload, CRC-32 of all
before it; little-endian. The payload is JSON of the numbers and an Arrow stream of the cells. What is damaged, of another kind, of an
unknown version or hash, or longer than allowed is refused.
"""

from __future__ import annotations

import io
import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HASHES
from ..operators.cells import Sketch

MAGIC = b"TLSK"
VERSION = 1
#: A sketch that is packed on the driver may have this many bytes; larger ones are written as tables.
LIMIT = 64 << 20


def _named(x: str) -> bytes:
    raw = x.encode()
    return struct.pack("<H", len(raw)) + raw


def envelope(kind: str, hash_name: str, payload: bytes) -> bytes:
    body = MAGIC + struct.pack("<H", VERSION) + _named(kind) + _named(hash_name) + struct.pack("<I", len(payload)) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def opened(raw: bytes, limit: int = LIMIT) -> tuple[str, str, bytes]:
    """(kind, hash, payload)."""
    if len(raw) < 14 or raw[:4] != MAGIC:
        raise ValueError("not an envelope")
    if struct.unpack_from("<H", raw, 4)[0] != VERSION:
        raise ValueError("unknown version")
    if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("damaged: the checksum differs")
    at, names = 6, []
    for _ in range(2):
        n = struct.unpack_from("<H", raw, at)[0]
        names.append(raw[at + 2 : at + 2 + n].decode())
        at += 2 + n
    n = struct.unpack_from("<I", raw, at)[0]
    if n > limit or at + 4 + n + 4 != len(raw):
        raise ValueError("the length is wrong")
    return names[0], names[1], raw[at + 4 : at + 4 + n]


def to_bytes(sketch: Sketch) -> bytes:
    """One sketch as bytes. Its cells come to the driver, so their size is looked at first."""
    wide = [F.octet_length(c) if t in ("string", "binary") else F.size(c) * 8 if t.startswith("array") else F.lit(8) for c, t in sketch.cells.dtypes]
    size = sketch.cells.agg(F.sum(sum(wide[1:], wide[0]))).first()[0] or 0
    if size > LIMIT:
        raise ValueError(f"{size} bytes of cells are too many for one envelope; write the sketch as a table")
    sink = io.BytesIO()
    table = sketch.cells.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    head = json.dumps({"spec": sketch.spec, "by": list(sketch.by)}).encode()
    return envelope(sketch.KIND, sketch.spec.get("hash", "none"), struct.pack("<I", len(head)) + head + sink.getvalue())


def from_bytes(spark: SparkSession, kind: type[Sketch], raw: bytes) -> Sketch:
    name, hash_name, payload = opened(raw)
    if name != kind.KIND:
        raise ValueError(f"holds a {name}, not a {kind.KIND}")
    if hash_name != "none" and hash_name not in HASHES:
        raise ValueError(f"hash {hash_name!r} is not registered here")
    n = struct.unpack_from("<I", payload)[0]
    head = json.loads(payload[4 : 4 + n])
    table = pa.ipc.open_stream(payload[4 + n :]).read_all()
    return kind(head["spec"], spark.createDataFrame(table), tuple(head["by"]))


def nested(parts: dict[str, Sketch]) -> bytes:
    """Several sketches in one envelope, each in an envelope of its own under its name."""
    packed = {name: to_bytes(s) for name, s in parts.items()}
    payload = struct.pack("<I", len(packed)) + b"".join(_named(n) + struct.pack("<I", len(x)) + x for n, x in packed.items())
    if len(payload) > LIMIT:
        raise ValueError("too long for one envelope")
    return envelope("nested", "none", payload)


def from_nested(spark: SparkSession, raw: bytes, kinds: dict[str, type[Sketch]]) -> dict[str, Sketch]:
    """The way back; ``kinds`` tells what each name holds. Envelopes within are checked like any other."""
    kind, _, payload = opened(raw)
    if kind != "nested":
        raise ValueError(f"holds a {kind}, not several sketches")
    out, at = {}, 4
    for _ in range(struct.unpack_from("<I", payload)[0]):
        n = struct.unpack_from("<H", payload, at)[0]
        name = payload[at + 2 : at + 2 + n].decode()
        at += 2 + n
        size = struct.unpack_from("<I", payload, at)[0]
        if name not in kinds:
            raise ValueError(f"{name!r} is not asked for")
        out[name] = from_bytes(spark, kinds[name], payload[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(payload) or out.keys() != kinds.keys():
        raise ValueError("the parts don't fill the envelope")
    return out


def pack_groups(sketch: Sketch, out: str = "envelope") -> DataFrame:
    """A grouped sketch as a table (by, envelope): each group's cells in an envelope of their own, packed where they are."""
    by, kind, hash_name = list(sketch.by), sketch.KIND, sketch.spec.get("hash", "none")
    head = json.dumps({"spec": sketch.spec, "by": []}).encode()
    types = dict(sketch.cells.dtypes)

    def pack(t: pa.Table) -> pa.Table:
        sink = io.BytesIO()
        cells = t.drop_columns(by)
        with pa.ipc.new_stream(sink, cells.schema) as w:
            w.write_table(cells)
        raw = envelope(kind, hash_name, struct.pack("<I", len(head)) + head + sink.getvalue())
        return pa.table([*[t.column(b).slice(0, 1) for b in by], pa.array([raw], pa.binary())], names=[*by, out])

    schema = ", ".join([*(f"`{b}` {types[b]}" for b in by), f"`{out}` binary"])
    return sketch.cells.groupBy(*by).applyInArrow(pack, schema)


def unpack_groups(df: DataFrame, kind: type[Sketch], by: tuple[str, ...], spec: dict, cells: str, column: str = "envelope") -> Sketch:
    """The way back: ``cells`` is the schema of the cells without the groups. Every envelope is checked."""
    types = dict(df.dtypes)
    name = kind.KIND

    def unpack(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for i in range(len(b)):
                got, _, payload = opened(b.column(column)[i].as_py())
                n = struct.unpack_from("<I", payload)[0]
                if got != name or json.loads(payload[4 : 4 + n])["spec"] != spec:
                    raise ValueError(f"an envelope holds another sketch than {name} {spec}")
                t = pa.ipc.open_stream(payload[4 + n :]).read_all().combine_chunks()
                for part in t.to_batches():
                    groups = [pa.array([b.column(g)[i].as_py()] * len(part), b.column(g).type) for g in by]
                    yield pa.RecordBatch.from_arrays([*groups, *part.columns], names=[*by, *part.schema.names])

    schema = ", ".join([*(f"`{g}` {types[g]}" for g in by), cells])
    return kind(spec, df.select(*by, F.col(column)).mapInArrow(unpack, schema), by)
