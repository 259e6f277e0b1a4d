"""Netpbm and BMP images as columns: decoded to arrays, area-resized, tiled and hashed.

Any bytes can be stored losslessly as an 8-bit grey image: 64 samples a row, the last
row filled up with zeros. Images are written to a table, read back and decoded; their
tiles are written to another, as NPY files, and read back for the features.

Edge cases: a null or empty text is one row of zeros; bytes that aren't a whole image
of a known kind, or have a sample out of range, decode to an error; rows that repeat a
doc_id are each stored. Memory follows the longest text a few times: integral images
are made block by block.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalweave.llm.common import stage, texts_of
from evalweave.llm.units import forget

WIDTH = 64


def encode_pgm(grey: np.ndarray) -> bytes:
    """A binary grey map of 8 bits."""
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def encode_ppm(rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + np.ascontiguousarray(rgb, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Grey as 8 bits with a grey palette, colour as 24 bits; rows from the bottom up, each of whole 32-bit words."""
    grey = image.ndim == 2
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image if grey else image[:, :, ::-1], np.uint8).reshape(height, -1)[::-1]
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = (np.arange(256, dtype=np.uint32) * 0x010101).astype("<u4").tobytes() if grey else b""
    at = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, width, height, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette + rows.tobytes()


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` numbers after the magic, comments left out, and where the samples begin."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 0x30
    bits, colour, plain = kind in (1, 4), kind in (3, 6), kind < 4
    (width, height, *most), at = _header(data, 2 if bits else 3)
    top = most[0] if most else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("not a Netpbm size")
    n = width * height * (3 if colour else 1)
    if plain and bits:
        samples = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8) - 0x30
    elif plain:
        samples = np.array([int(x) for x in data[at - 1 :].split()[:n]], np.int64)
    elif bits:
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at).reshape(height, -1)
        samples = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    if len(samples) < n:
        raise ValueError("samples are missing")
    samples = samples[:n]
    if not bits and (samples.min() < 0 or samples.max() > top):
        raise ValueError("a sample is out of range")
    samples = samples.reshape((height, width, 3) if colour else (height, width))
    if bits:
        return np.where(samples, 0, 255).astype(np.uint8)
    return samples.astype(np.uint8) if top == 255 else (samples.astype(np.int64) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    at, size, width, height, _, depth, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed or depth not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("not a plain BMP")
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if depth >= 24:
        return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1].copy()
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)
        rows = np.packbits(np.pad(bits.reshape(len(rows), -1, depth), ((0, 0), (0, 0), (8 - depth, 0))), axis=2)[:, :, 0]
    rows = rows[:, :width]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    """Height x width (x 3) of 8 bits."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _lines(grey: np.ndarray, edges: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Rows of the integral image's row sums at ``edges`` (ascending, 0 to height), made a block of rows at a time."""
    out = np.zeros((len(edges), grey.shape[1]))
    before = np.zeros(grey.shape[1])
    for at in range(0, grey.shape[0], block):
        sums = np.cumsum(grey[at : at + block], axis=0, dtype=np.float64)
        sums += before
        a, b = np.searchsorted(edges, [at + 1, at + len(sums) + 1])
        out[a:b] = sums[edges[a:b] - at - 1]
        before = sums[-1].copy()
    return out


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means, by an integral image read between its points."""
    edge = np.linspace(0, grey.shape[0], height + 1)
    low = np.minimum(edge.astype(np.int64), grey.shape[0] - 1)
    points, where = np.unique(np.concatenate([low, low + 1]), return_inverse=True)
    lines = _lines(grey, points)[where]
    part = (edge - low)[:, None]
    lines = lines[: height + 1] * (1 - part) + lines[height + 1 :] * part
    total = np.zeros((height + 1, grey.shape[1] + 1))
    np.cumsum(lines, axis=1, out=total[:, 1:])
    edge = np.linspace(0, grey.shape[1], width + 1)
    low = np.minimum(edge.astype(np.int64), grey.shape[1] - 1)
    part = edge - low
    corner = total[:, low] * (1 - part) + total[:, low + 1] * part
    sums = np.diff(np.diff(corner, axis=0), axis=1)
    return sums * (height * width / (grey.shape[0] * grey.shape[1]))


def difference_hash(grey: np.ndarray, side: int = 8) -> str:
    """Is each of side x (side + 1) area means over its left neighbour? As hex digits."""
    small = np.round(area_resize(grey, side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(grey: np.ndarray, side: int = 32) -> bytes:
    """The area-resized image in NPY format."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(grey, side, side)).astype(np.uint8))
    return out.getvalue()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a grey map) of every text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            size, n, media, ids = 0, [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows = max(1, -(-len(raw) // WIDTH))
                ids.append(doc_id)
                n.append(len(raw))
                media.append(encode_pgm(np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)))
                size += len(raw)
                if size > 1 << 23:
                    yield _stored(ids, n, media)
                    size, n, media, ids = 0, [], [], []
            if ids:
                yield _stored(ids, n, media)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _stored(ids: list, n: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def tiles(images: DataFrame, side: int = 32) -> DataFrame:
    """doc_id, height, width, tile (NPY), dhash and error of each (doc_id, media)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
        for batch in parts:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    image = decode(data or b"")
                    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
                    rows.append((doc_id, *image.shape[:2], npy_tile(grey, side), difference_hash(grey), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((doc_id, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema.types, strict=True)], schema=schema)

    return images.select("doc_id", "media").mapInArrow(run, "doc_id long, height long, width long, tile binary, dhash string, error string")


def _payloads(images: DataFrame, side: int = 32) -> DataFrame:
    """Digests of what the stored images decode to, with their NPY tiles and difference hashes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grey = decode(data)
                payload = memoryview(np.ascontiguousarray(grey)).cast("B")
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), npy_tile(grey, side), difference_hash(grey)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string"
    return images.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


@F.arrow_udf(StringType())
def _feature(dhash: pa.Array, tile: pa.Array) -> pa.Array:
    """The difference hash and the CRC of the tile's samples, as NPY reads them."""
    return pa.array([f"{h}:{zlib.crc32(np.load(io.BytesIO(t)).tobytes()):08x}" for h, t in zip(dhash.to_pylist(), tile.to_pylist(), strict=True)], pa.string())


def text_media(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Store every text as an image, write the tiles of what is read back, and give their digests and where both lie."""
    images, path = stage(store(docs), "media")
    tiled, tiles_path = stage(_payloads(images), "tiles")
    return tiled.withColumn("feature", _feature("dhash", "tile")).drop("dhash", "tile"), path, tiles_path
