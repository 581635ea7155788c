"""Media columns: Netpbm and BMP pictures decoded to arrays, resized and hashed.

Pictures are held as binary columns. Each is decoded to a numpy array, area-resized by an
integral image (the mean over any rectangle, also with fractional edges, from four reads
of the running sums) to a small NPY tile and to the nine by eight grid of a difference
hash. Everything is per row: a scan without a shuffle.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples in a row of the picture that holds a text.
ROW = 64
TILE = 16


def _token(data: bytes, at: int) -> tuple[int, int]:
    """The next number of a Netpbm header or plain raster, and the place after it."""
    while True:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] != b"#":
            break
        while at < len(data) and data[at : at + 1] not in b"\r\n":
            at += 1
    start = at
    while at < len(data) and 48 <= data[at] <= 57:
        at += 1
    if start == at:
        raise ValueError("a number is missing")
    return int(data[start:at]), at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3); bitmaps are 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm picture")
    width, at = _token(data, 2)
    height, at = _token(data, at)
    bits = kind in (b"P1", b"P4")
    most, at = (1, at) if bits else _token(data, at)
    if not 0 < most < 65536:
        raise ValueError("the largest sample is out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    row = (width + 7) // 8
    least = {b"P1": n, b"P4": row * height + 1}.get(kind) or (2 * n - 1 if kind in (b"P2", b"P3") else n * (1 + (most > 255)) + 1)
    if n and least > len(data) - at:  # before anything of that size is made
        raise ValueError("the raster is too short")
    if kind == b"P1":
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].splitlines())
        out = np.frombuffer(body, np.uint8)
        out = out[(out == 48) | (out == 49)][:n] - 48
    elif kind in (b"P2", b"P3"):
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].splitlines())
        numbers = body.split(None, n)[:n]
        if not all(x.isdigit() and len(x) < 10 for x in numbers):
            raise ValueError("a sample is no number")
        out = np.array([int(x) for x in numbers], np.int64)
    elif kind == b"P4":
        raw = np.frombuffer(data, np.uint8, row * height, at + 1)
        out = np.unpackbits(raw.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(out) != n:
        raise ValueError("the raster is too short")
    if n and int(out.max()) > most:
        raise ValueError("a sample exceeds the largest one stated")
    out = ((1 - out) * 255).astype(np.uint8) if bits else out.astype(np.uint16 if most > 255 else np.uint8)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def _masked(raw: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """Pixels of 16 or 32 bits as red, green and blue, each cut out by its mask and stretched to 0 to 255."""
    out = np.zeros((*raw.shape, 3), np.uint8)
    for i, mask in enumerate(masks):
        low = (mask & -mask).bit_length() - 1
        most = mask >> max(low, 0)
        if not mask or most & (most + 1):
            raise ValueError("a mask is not one run of bits")
        out[:, :, i] = ((raw.astype(np.uint64) & np.uint64(mask)) >> np.uint64(low)) * np.uint64(255) // np.uint64(most)
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, with bit fields or without, as (height, width, 3), or (height, width) if its palette is grey."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    offset, size = struct.unpack_from("<II", data, 10)
    if size < 40:
        raise ValueError("an old BMP header")
    width, height, _, depth, packing, _, _, _, colours = struct.unpack_from("<iiHHIIiiI", data, 18)
    if depth not in (1, 4, 8, 16, 24, 32) or packing != 0 and (packing != 3 or depth not in (16, 32)) or width <= 0 or not height:
        raise ValueError("an unsupported BMP kind")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if stride * rows > len(data) - offset or colours > 1 << min(depth, 8):
        raise ValueError("the raster or the palette is too short")
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if depth in (16, 32) and (packing or depth == 16):
        masks = struct.unpack_from("<III", data, 54) if packing else (0x7C00, 0x03E0, 0x001F)
        return _masked(np.ascontiguousarray(raw).view("<u2" if depth == 16 else "<u4")[:, :width], masks)
    if depth >= 24:
        return np.ascontiguousarray(raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1])
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << depth), 14 + size).reshape(-1, 4)[:, 2::-1]
    if depth == 8:
        index = raw[:, :width]
    elif depth == 4:
        index = np.stack((raw >> 4, raw & 15), axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    out = palette[index]
    return np.ascontiguousarray(out[:, :, 0]) if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def grey(picture: np.ndarray) -> np.ndarray:
    return picture if picture.ndim == 2 else picture @ np.array([0.299, 0.587, 0.114])


def integral(picture: np.ndarray) -> np.ndarray:
    """out[i, j] is the sum of the first i rows and j columns."""
    out = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1))
    np.cumsum(np.cumsum(picture, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def area_resize(sums: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each cell of an even height by width grid, from the integral image."""
    h, w = sums.shape[0] - 1, sums.shape[1] - 1
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    i, j = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    b, a = (y - i)[:, None], (x - j)[None, :]
    rows = sums[i] * (1 - b) + sums[i + 1] * b
    at = rows[:, j] * (1 - a) + rows[:, j + 1] * a
    return np.diff(np.diff(at, axis=0), axis=1) * (height * width) / (h * w)


def difference_hash(sums: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of nine cells in eight rows is brighter than the one to its left."""
    small = np.round(area_resize(sums, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def text_picture(text: Column) -> Column:
    """A text's UTF-8 bytes as a binary PGM, 64 samples a row, padded with 0 to full rows; null is empty."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / ROW)).cast("int")
    head = F.encode(F.concat(F.lit(f"P5\n{ROW} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    return F.concat(head, F.call_function("rpad", raw, rows * ROW, F.to_binary(F.lit("00"), F.lit("hex"))))


def media_columns(df: DataFrame, media: str = "media", tile: int = TILE) -> DataFrame:
    """`df` with what its pictures hold: ``height``, ``width``, ``samples`` (the decoded
    array's bytes), ``tile`` (an NPY file, `tile` by `tile` grey) and ``dhash``.

    A null, an empty picture or one that can't be decoded (malformed, cut off, with samples
    above the stated largest one or a size that its bytes don't fill) has nulls in these
    columns. A very long picture is decoded whole in its task, which takes about 20 times
    its bytes for the running sums; nothing larger than its bytes allow is ever made.
    Columns of these names are replaced; all others are carried along. Rows are handled
    one by one, so repeated rows give equal results and an empty table stays empty.
    """
    made = (("height", T.IntegerType()), ("width", T.IntegerType()), ("samples", T.BinaryType()), ("tile", T.BinaryType()), ("dhash", T.StringType()))
    kept = df.select(*(c for c in df.columns if c not in dict(made)))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in made)])

    def one(data: bytes | None) -> tuple:
        try:
            picture = decode(data or b"")
            sums = integral(grey(picture))
            if not picture.size:
                raise ValueError("no samples")
        except (ValueError, struct.error, IndexError, OverflowError):
            return (None,) * 5
        small = np.clip(np.rint(np.round(area_resize(sums, tile, tile), 6)), 0, 65535 if picture.dtype == np.uint16 else 255).astype(picture.dtype)
        return picture.shape[0], picture.shape[1], picture.tobytes(), npy(small), difference_hash(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import steps

        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
        for batch in batches:
            for part in steps(batch, media, 4 << 20):
                columns = list(zip(*map(one, part.column(part.schema.get_field_index(media)).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.fieldNames())

    return kept.mapInArrow(run, schema)
