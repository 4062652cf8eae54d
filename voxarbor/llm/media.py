"""Media columns: payloads in content-addressed tar shards, rows that point into them.

Each payload is stored as an 8-bit greyscale PNG of 64 samples a line (lossless).  A
task writes its payloads into tar files of bounded size, each entry named by the
SHA-256 of the payload and stored once per file; the rows carry digest, shard, offset
and length.  Metadata columns come from range reads of the first 33 bytes of an entry
(the PNG header), features from range reads of the whole entry.

The shards lie in the folder named by spark.checkpoint.dir, through pyarrow's file
systems; a shard's name is made of its content, and it is put in place by renaming, so
a task that runs again after a lost executor writes the same files.

Cases: null and empty text give the payload of 64 zero bytes; equal texts give equal
values; long texts are one entry of any size.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .common import materialise, pieces, shared_dir

LINE = 64
#: Bytes of entries after which a task begins a new shard.
SHARD_BYTES = 32_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // LINE)) * LINE, b"\0"), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(payload: bytes) -> bytes:
    """8-bit greyscale, LINE wide, filter 0 on every line, zlib level 1."""
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, LINE)
    framed = np.zeros((len(lines), LINE + 1), dtype=np.uint8)
    framed[:, 1:] = lines
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(framed.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first HEADER_BYTES bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return width, height, depth


def png_decode(stored: bytes) -> bytes:
    width, _, _ = png_header(stored[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            data += stored[at + 8 : at + 8 + n]
        at += n + 12
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return lines[:, 1:].tobytes()


class _Shard:
    """One tar file in memory, at most SHARD_BYTES plus one entry."""

    def __init__(self):
        self.buffer, self.entries, self.rows = io.BytesIO(), {}, []

    def add(self, digest: str, stored: bytes) -> tuple[int, int]:
        if digest not in self.entries:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(stored)
            self.buffer.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.entries[digest] = (self.buffer.tell(), len(stored))
            self.buffer.write(stored + b"\0" * (-len(stored) % 512))
        return self.entries[digest]

    def put(self, store: fs.FileSystem, root: str) -> str:
        self.buffer.write(b"\0" * 1024)
        data = self.buffer.getbuffer()
        name = f"{hashlib.sha256(data).hexdigest()}.tar"
        temp = f"{root}/{name}.{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(temp) as out:
            out.write(data)
        store.move(temp, f"{root}/{name}")
        return name


def store_payloads(docs: DataFrame, at: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, digest, shard, offset and length of every row; writes the shards."""
    schema = docs.select(key).schema
    for name, kind in (("n_bytes", "long"), ("digest", "string"), ("shard", "string"), ("offset", "long"), ("length", "long")):
        schema = schema.add(name, kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        shard, held = _Shard(), []

        def flush() -> pa.RecordBatch:
            name = shard.put(store, root)
            ids, rest = pa.concat_arrays([a for a, _ in held]), [r for _, rs in held for r in rs]
            cols = list(zip(*[(n, d, name, *shard.entries[d]) for n, d in rest], strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

        for batch in batches:
            for part in pieces(batch, text):
                rows = []
                for t in part.column(text).to_pylist():
                    payload, n = payload_of(t)
                    d = hashlib.sha256(payload).hexdigest()
                    if d not in shard.entries:
                        shard.add(d, png_encode(payload))
                    rows.append((n, d))
                if rows:
                    held.append((part.column(key), rows))
                if shard.buffer.tell() >= SHARD_BYTES:
                    yield flush()
                    shard, held = _Shard(), []
        if held:
            yield flush()

    return docs.select(key, text).mapInArrow(write, schema)


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples and a coarse histogram, as text."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"mean={x.mean():.4f};std={x.std():.4f};hist={','.join(map(str, bins))}"


def read_media(rows: DataFrame, at: str, key: str = "doc_id") -> DataFrame:
    """Rows of store_payloads with metadata from headers and features from the payload,
    both read back from the shards."""
    schema = rows.select(key, "n_bytes").schema
    added = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"),
             ("media_sha256", "string"), ("feature", "string"), ("width", "integer"), ("height", "integer"), ("depth", "integer"),
             ("digest", "string"), ("shard", "string"), ("offset", "long"), ("length", "long")]
    for name, kind in added:
        schema = schema.add(name, kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        last, file, memo = None, None, {}
        for batch in batches:
            out = []
            for d, s, o, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if s != last:
                    if file is not None:
                        file.close()
                    file, last, memo = store.open_input_file(f"{root}/{s}"), s, {}
                if o not in memo:
                    width, height, depth = png_header(file.read_at(HEADER_BYTES, o))
                    stored = file.read_at(n, o)
                    payload = png_decode(stored)
                    memo[o] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(stored),
                               hashlib.sha256(stored).hexdigest(), feature_of(payload), width, height, depth)
                out.append((*memo[o], d, s, o, n))
            cols = [batch.column(key), batch.column("n_bytes")]
            kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
            for (_, kind), c in zip(added, zip(*out, strict=True), strict=True):
                cols.append(pa.array(c, kinds[kind]))
            if out:
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        if file is not None:
            file.close()

    return rows.mapInArrow(read, schema)


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store every payload, then read each row's entry back."""
    at = f"{shared_dir(docs.sparkSession)}/shards"
    rows = materialise(store_payloads(docs, at, text, key))
    return read_media(rows, at, key)
