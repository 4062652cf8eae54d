"""Image stacks: TIFF planes and v3draw volumes as voxel rows, and back.

Files come through Spark's binaryFile source, one row a file, so any file system Spark
knows will do; decoding runs in Arrow batches on the executors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "x int, y int, z int, v int"


def input_kind(path: str) -> str:
    """Kind of input by extension; a folder is decided by what it holds (see folder_kind)."""
    for ext in ("vdb", "swc", "ims", "v3draw", "v3dpbd"):
        if path.lower().endswith(f".{ext}"):
            return ext
    raise ValueError(f"unknown input type: {path}")


def folder_kind(names: list[str]) -> str:
    return "swcs" if any(n.lower().endswith(".swc") for n in names) else "tiff"


def plane_index(path):
    """Column: digits after the last underscore of a file name, as the plane number."""
    return F.regexp_replace(F.regexp_extract(path, r"_([^_/]*)$", 1), r"\D", "").cast("int")


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, 256 clears, 257 ends."""
    out, table = [], [bytes([i]) for i in range(256)] + [b"", b""]
    entries, width, before = list(table), 9, None
    bits = n = 0
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n
        bits &= (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            entries, width, before = list(table), 9, None
            continue
        if code > len(entries) or (code >= 256 and before is None):
            raise ValueError(f"not an LZW stream: code {code} after {len(out)} entries")
        entry = entries[code] if code < len(entries) else before + before[:1]
        out.append(entry)
        if before is not None:
            entries.append(before + entry[:1])
        before = entry
        if len(entries) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def tiff_pages(data: bytes) -> list[np.ndarray]:
    """Greyscale 8- or 16-bit pages, striped, plain or LZW; anything else is refused."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at, pages = struct.unpack(f"{order}I", data[4:8])[0], []
    size = {1: 1, 2: 1, 3: 2, 4: 4}
    while at:
        n = struct.unpack(f"{order}H", data[at : at + 2])[0]
        tags: dict[int, list[int]] = {}
        for i in range(n):
            e = at + 2 + 12 * i
            tag, kind, count = struct.unpack(f"{order}HHI", data[e : e + 8])
            if kind not in size:
                continue
            total = size[kind] * count
            where = e + 8 if total <= 4 else struct.unpack(f"{order}I", data[e + 8 : e + 12])[0]
            tags[tag] = list(struct.unpack(f"{order}{count}{'?BBHI'[kind]}", data[where : where + total]))
        at = struct.unpack(f"{order}I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        if tags.get(254, [0])[0] & 1:  # a reduced copy beside its page, as LSM files have them
            continue
        if 322 in tags or tags.get(277, [1])[0] != 1:
            raise ValueError("only striped greyscale TIFF")
        width, height, bits, packed = tags[256][0], tags[257][0], tags[258][0], tags.get(259, [1])[0]
        if bits not in (8, 16) or packed not in (1, 5):
            raise ValueError("only 8 or 16 bits, plain or LZW")
        strips = [data[o : o + c] for o, c in zip(tags[273], tags[279], strict=True)]
        raw = b"".join(map(lzw_decode, strips) if packed == 5 else strips)
        pages.append(np.frombuffer(raw, dtype=f"{order}u{bits // 8}", count=width * height).reshape(height, width))
    return pages


def tiff_bytes(*planes: np.ndarray) -> bytes:
    """One page a plane, each of one plain strip, little endian."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4  # where the place of the next page is to be written
    for plane in planes:
        height, width = plane.shape
        raw, strip = np.ascontiguousarray(plane, dtype=f"<u{plane.dtype.itemsize}").tobytes(), len(out)
        out += raw + b"\0" * (len(raw) % 2)
        tags = ((256, 4, width), (257, 4, height), (258, 3, plane.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, strip), (277, 3, 1), (278, 4, height), (279, 4, len(raw)))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        out += b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in tags)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def mrc_volume(data: bytes) -> np.ndarray:
    """An MRC map, z by y by x: header of 1,024 bytes and its extension, then modes 0 (8 bits),
    1 and 6 (16 bits); negative values are refused."""
    if len(data) < 1024:
        raise ValueError("not an MRC file: no whole header")
    order = ">" if data[212:213] == b"\x11" else "<"
    x, y, z, mode = struct.unpack(f"{order}4i", data[:16])
    kind = {0: "i1", 1: "i2", 6: "u2"}.get(mode)
    if kind is None or min(x, y, z) < 1:
        raise ValueError(f"not an MRC volume of 8 or 16 bits: {x} x {y} x {z}, mode {mode}")
    extended = struct.unpack(f"{order}i", data[92:96])[0]
    volume = np.frombuffer(data, dtype=f"{order}{kind}", count=x * y * z, offset=1024 + extended).reshape(z, y, x)
    if volume.min() < 0:
        raise ValueError("negative values in an MRC volume")
    return volume


def v3draw_volume(data: bytes) -> np.ndarray:
    """First channel, z by y by x, of a raw volume with a 43-byte header."""
    if not data.startswith(b"raw_image_stack_by_hpeng"):
        raise ValueError("not a v3draw file")
    order = {b"L": "<", b"B": ">"}[data[24:25]]
    unit = struct.unpack(f"{order}h", data[25:27])[0]
    x, y, z, _ = struct.unpack(f"{order}4i", data[27:43])
    return np.frombuffer(data, dtype=f"{order}u{unit}", count=x * y * z, offset=43).reshape(z, y, x)


def _rows(planes: list[tuple[int, np.ndarray]], least: int) -> Iterator[pa.RecordBatch]:
    for z, plane in planes:
        y, x = np.nonzero(plane > least)
        cols = (x, y, np.full(len(x), z), plane[y, x])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], names=["x", "y", "z", "v"])


def read_tiff(spark: SparkSession, path: str, above: int = -1) -> DataFrame:
    """Voxels above a value: one file a plane (numbered by name), or pages of one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    files = files.select(F.coalesce(plane_index(F.regexp_replace("path", r"\.tiff?$", "")), F.lit(0)).alias("z"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, content in zip(batch.column("z").to_pylist(), batch.column("content"), strict=True):
                pages = tiff_pages(content.as_py())
                yield from _rows([(z if len(pages) == 1 else i, p) for i, p in enumerate(pages)], above)

    return files.mapInArrow(decode, VOXELS)


def _read_volumes(spark: SparkSession, path: str, above: int, volume) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _rows(list(enumerate(volume(content.as_py()))), above)

    return files.mapInArrow(decode, VOXELS)


def read_v3draw(spark: SparkSession, path: str, above: int = -1) -> DataFrame:
    return _read_volumes(spark, path, above, v3draw_volume)


def read_mrc(spark: SparkSession, path: str, above: int = -1) -> DataFrame:
    return _read_volumes(spark, path, above, mrc_volume)


def write_tiff(voxels: DataFrame, uri: str, width: int, height: int, bits: int = 16) -> DataFrame:
    """One img_%06d.tif a plane below a folder URI that executors share; returns the names.
    A plane is at most width by height pixels, whatever the volume's size."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((height, width), dtype=f"u{bits // 8}")
        plane[pdf.y, pdf.x] = pdf.v
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        name = f"img_{int(pdf.z.iloc[0]):06d}.tif"
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(tiff_bytes(plane))
        return pd.DataFrame({"z": [int(pdf.z.iloc[0])], "name": [name]})

    return voxels.select("x", "y", "z", "v").groupBy("z").applyInPandas(write, "z int, name string")


def write_windows(held: DataFrame, uri: str, bits: int = 16) -> DataFrame:
    """One window_<id>.tif of all its planes a window, from the rows of grid.in_windows with a
    value v; a window without a voxel has no row and gets no file.  Returns the names."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = ([int(pdf[f"{m}_{a}"].iloc[0]) for a in "zyx"] for m in ("min", "max"))
        block = np.zeros([b - a + 1 for a, b in zip(low, high, strict=True)], dtype=f"u{bits // 8}")
        block[pdf.z - low[0], pdf.y - low[1], pdf.x - low[2]] = pdf.v
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        window = int(pdf.window.iloc[0])
        name = f"window_{window}.tif"
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(tiff_bytes(*block))
        return pd.DataFrame({"window": [window], "planes": [len(block)], "name": [name]})

    return held.groupBy("window").applyInPandas(write, "window long, planes int, name string")
