"""Media columns: Netpbm and BMP bytes, decoded to arrays, area-resized, tiled and hashed.

Samples are 8 bits.  Images are resized by their integral image: the integral is interpolated at the
target's cell borders, which gives each cell's exact area mean, also where cells cut pixels.  A
difference hash compares neighbouring cells of a 9 x 8 reduction; the 8 x 8 reduction is written as an
NPY tile.  Colour images are reduced channel by channel and hashed by their luma.  Integrals are taken
over strips of rows, so their memory does not follow the image's height.

For texts, ``store_texts`` writes a text's UTF-8 bytes, filled with 255 to a positive multiple of
``BLOCK``, as the samples of an image ``WIDTH`` wide into a media table of the shared folder: as PGM,
or, from ``BMP_FROM`` bytes on, as BMP, whose rows lie at fixed aligned places.  ``media_features``
reads that table back and computes everything from the stored bytes.

Null and empty texts are one block of 255.  Very long ones are one image.  Cells of equal brightness
give a zero bit.  Equal texts give equal values, repeated rows a row each; null ids stay null.  Bytes
that are no whole image raise ``ValueError``.  Extra columns are ignored, whatever their names, and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tables
from .textcore import row_slices, string_buffer

BLOCK, WIDTH, FILL = 576, 24, 255
BMP_FROM = 1 << 16
# The parts of red, green and blue in luma.
LUMA = np.array([0.299, 0.587, 0.114])
STRIP = 1 << 16


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary PGM of a (rows, columns) array, binary PPM of a (rows, columns, 3) one."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 of at most 8 bits a sample; comments are allowed, bitmaps become 0 and 255."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    fields: list[int] = []
    at, need = 2, 2 if kind in (b"P1", b"P4") else 3
    while len(fields) < need:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header breaks off")
        fields.append(int(raw[at:end]))
        at = end
    columns, rows = fields[:2]
    top = fields[2] if need == 3 else 1
    if top > 255:
        raise ValueError("16-bit samples")
    shape = (rows, columns, 3) if kind in (b"P3", b"P6") else (rows, columns)
    n = int(np.prod(shape))
    if kind == b"P4":
        stride = (columns + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stride, at + 1).reshape(rows, stride), axis=1)
        return ((1 - bits[:, :columns]) * 255).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        if len(raw) - at - 1 < n:
            raise ValueError("a Netpbm image breaks off")
        samples = np.frombuffer(raw, np.uint8, n, at + 1)
    else:
        words = raw[at:].split() if kind != b"P1" else [bytes([c]) for c in raw[at:] if c in b"01"]
        if len(words) < n:
            raise ValueError("a Netpbm image breaks off")
        samples = np.array(words[:n], np.int64)
        samples = ((1 - samples) * 255 if kind == b"P1" else samples).astype(np.uint8)
    return (samples.astype(np.uint16) * 255 // top).astype(np.uint8).reshape(shape) if top not in (1, 255) else samples.reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    rows, columns = image.shape[:2]
    depth = 24 if image.ndim == 3 else 8
    stride = (columns * depth // 8 + 3) // 4 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, : columns * depth // 8] = (image[..., ::-1] if depth == 24 else image)[::-1].reshape(rows, -1)
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if depth == 8 else b""
    start = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, depth, 0, body.size, 2835, 2835, len(palette) // 4, 0) + palette + body.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 or 24 bits, either row order; grey palettes give two dimensions."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not a BMP image")
    start, head = struct.unpack_from("<II", raw, 10)
    columns, rows, _, depth, packed = struct.unpack_from("<iiHHI", raw, 18)
    if packed or depth not in (8, 24):
        raise ValueError("a BMP image of another kind")
    stride, high = (columns * depth // 8 + 3) // 4 * 4, abs(rows)
    if len(raw) < start + stride * high:
        raise ValueError("a BMP image breaks off")
    body = np.frombuffer(raw, np.uint8, stride * high, start).reshape(high, stride)
    body = body if rows < 0 else body[::-1]
    if depth == 24:
        return body[:, : 3 * columns].reshape(high, columns, 3)[..., ::-1]
    palette = np.frombuffer(raw, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    full = np.zeros((256, 3), np.uint8)
    full[: len(palette)] = palette[:256]
    image = full[body[:, :columns]] if (full != full[:, :1]).any() else full[:, 0][body[:, :columns]]
    return image


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def _borders(cells: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(cells + 1) * size / cells
    whole = np.minimum(at.astype(np.int64), size)
    return whole, at - whole


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of an image over each cell of a grid, from its integral image; colours one by one."""
    if image.ndim == 3:
        return np.stack([area_resize(image[..., c], rows, columns) for c in range(image.shape[2])], -1)
    high, wide = image.shape
    x, fx = _borders(columns, wide)
    y, fy = _borders(rows, high)
    edge = np.zeros((rows + 1, columns))
    carry = np.zeros(columns)
    for top in range(0, high, STRIP):
        strip = image[top : top + STRIP]
        across = np.zeros((len(strip), wide + 1))
        np.cumsum(strip, axis=1, dtype=np.float64, out=across[:, 1:])
        at_x = across[:, x] + fx * (across[:, np.minimum(x + 1, wide)] - across[:, x])
        integral = np.zeros((len(strip) + 1, columns))
        integral[0] = carry
        np.cumsum(np.diff(at_x, axis=1), axis=0, out=integral[1:])
        integral[1:] += carry
        own = np.flatnonzero((y >= top) & ((y < top + len(strip)) | (top + len(strip) == high)))
        low = y[own] - top
        up = np.minimum(low + 1, len(strip))
        edge[own] = integral[low] + fy[own, None] * (integral[up] - integral[low])
        carry = integral[-1]
    return np.diff(edge, axis=0) / (high * wide / (rows * columns))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each cell of 8 x 9 is brighter than the one to its right."""
    small = area_resize(image, 8, 9)
    small = np.rint((small @ LUMA if small.ndim == 3 else small) * 256).astype(np.int64)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int = 8) -> bytes:
    """The image's reduction to ``side`` x ``side`` as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_payload(raw: bytes) -> bytes:
    """The bytes filled up to a positive multiple of BLOCK."""
    return raw + bytes([FILL]) * (-len(raw) % BLOCK if raw else BLOCK)


def _stored(form: str):
    store = {"pgm": encode_netpbm, "bmp": encode_bmp}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for a, b in row_slices(offs):
                media = []
                for i, j in zip(offs[a:b].tolist(), offs[a + 1 : b + 1].tolist(), strict=True):
                    payload = text_payload(data[i:j].tobytes())
                    own = form if form != "auto" else "bmp" if len(payload) >= BMP_FROM else "pgm"
                    media.append(store[own](np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs[a : b + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def store_texts(documents: DataFrame, form: str = "auto") -> DataFrame:
    """The media table (doc_id, n_bytes, media) of all texts, stored; ``form``: pgm, bmp or auto."""
    images = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_stored(form), "doc_id long, n_bytes long, media binary")
    return tables.stored(images, "media", compression="zstd")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        out = []
        for media in batch.column(2):
            media = media.as_buffer().to_pybytes()
            image = decode(media)
            back = image.tobytes()
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image):016x}", npy_tile(image)))
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])


def media_features(media: DataFrame) -> DataFrame:
    """Sizes, digests, difference hash and NPY tile of each image of a table (doc_id, n_bytes, media)."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_featured, f"doc_id long, n_bytes long, {FEATURES}")


def text_images(documents: DataFrame, form: str = "auto") -> DataFrame:
    """Each text as a stored image and what its stored bytes give."""
    return media_features(store_texts(documents, form))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_images(tables.read(spark, sf_dir, "documents"))
