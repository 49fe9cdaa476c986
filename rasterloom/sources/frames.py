"""Daily raster frames: directory scan, decoding, and cubes from them."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import stack_year
from ..shipping import ship

#: The form of a frame's file name: four digits of the year, three of its day.
NAME = r"(\d{4})(\d{3})_50KM\.(?:tif|npy)$"


def scan(spark: SparkSession, folder: str, pattern: str = "*.tif", year: int | None = None) -> DataFrame:
    """year, doy, path of a folder's frames, without reading their contents; of a day's several files the last by path.

    Names that don't parse are left out; years are told apart only if one is asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    part = lambda n: F.regexp_extract("path", NAME, n)
    named = files.where(part(1) != "").select(part(1).cast("int").alias("year"), part(2).cast("int").alias("doy"), "path")
    named = named if year is None else named.where(F.col("year") == year)
    return named.groupBy("doy").agg(F.max_by("year", "path").alias("year"), F.max("path").alias("path")).select("year", "doy", "path")


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """The byte order and the first image's tags of whole numbers, of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{order}H", data, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    entry, count, place = ("HHQ", "Q", 8) if big else ("HHI", "H", 4)
    word = "Q" if big else "I"
    at = struct.unpack_from(f"{order}{word}", data, 8 if big else 4)[0]
    n = struct.unpack_from(f"{order}{count}", data, at)[0]
    size = struct.calcsize(f"={entry}") + place
    codes, tags = {1: "B", 3: "H", 4: "I", 16: "Q"}, {}
    for i in range(n):
        here = at + struct.calcsize(f"={count}") + size * i
        tag, kind, many = struct.unpack_from(f"{order}{entry}", data, here)
        if kind in codes:
            form = f"{order}{many}{codes[kind]}"
            value = here + size - place
            if struct.calcsize(form) > place:
                value = struct.unpack_from(f"{order}{word}", data, value)[0]
            if value + struct.calcsize(form) > len(data):
                raise ValueError("a tag points past the file's end")
            tags[tag] = struct.unpack_from(form, data, value)
    return order, tags


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs of one byte and stretches of others, each after its length."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, that widen one code early."""
    out, table, last = [], [], None
    bits = held = 0
    width = 9
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        if code > len(table) or (code == len(table) and last is None):
            raise ValueError("an LZW code that no text has")
        found = table[code] if code < len(table) else last + last[:1]
        out.append(found)
        if last is not None:
            table.append(last + found[:1])
        last, width = found, min(12, (len(table) + 1).bit_length()) if len(table) >= 511 else 9
    return b"".join(out)


#: The numbers of the compressions.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode_tiff(data: bytes) -> np.ndarray:
    """The first band of a TIFF or BigTIFF file as rows of whole numbers or floats.

    Strips and tiles; uncompressed, LZW, Deflate and PackBits; without a predictor or with the horizontal one; samples
    of 8 to 64 bits, several of them interleaved or apart.
    """
    order, tags = tiff_tags(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bits, form, samples = tags[256][0], tags[257][0], one(258, 1), one(339, 1), one(277, 1)
    method, predictor, apart = one(259, 1), one(317, 1), one(284, 1) == 2
    if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or method not in UNPACK or predictor not in (1, 2) or (form == 3 and (bits < 16 or predictor == 2)):
        raise ValueError(f"a form of TIFF that is not read: {bits} bits of form {form}, compression {method}, predictor {predictor}")
    kind = np.dtype(f"{order}{'uif'[form - 1]}{bits // 8}")
    tiled = 322 in tags
    wide, high = (tags[322][0], tags[323][0]) if tiled else (width, min(height, one(278, height)))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // wide), -(-height // high)
    if min(width, height, wide, high) < 1 or len(starts) < across * down or width * height > 1 << 31:
        raise ValueError("not enough strips or tiles for the image")
    each = 1 if apart else samples
    out = np.zeros((height, width), kind.newbyteorder("="))
    for n in range(across * down):
        top, left = n // across * high, n % across * wide
        rows = high if tiled else min(high, height - top)
        body = UNPACK[method](data[starts[n] : starts[n] + sizes[n]])
        if len(body) < rows * wide * each * kind.itemsize:
            raise ValueError("a strip or tile is cut short")
        cells = np.frombuffer(body, kind, rows * wide * each).reshape(rows, wide, each)[:, :, 0].astype(kind.newbyteorder("="))
        if predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
        out[top : top + rows, left : left + wide] = cells[: height - top, : width - left]
    return out


def decode(data: bytes) -> np.ndarray:
    """A frame from .npy or TIFF bytes; a ValueError says why there is none."""
    try:
        return np.load(io.BytesIO(data), allow_pickle=False) if data[:6] == b"\x93NUMPY" else decode_tiff(data)
    except (KeyError, IndexError, TypeError, OverflowError, EOFError, MemoryError, struct.error, zlib.error) as error:
        raise ValueError(f"{type(error).__name__}: {error}") from error


def _contents(spark: SparkSession, folder: str, pattern: str, year: int | None) -> DataFrame:
    wanted = scan(ship(spark), folder, pattern, year)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.join(wanted, "path").select("doy", "path", "content")


def read(spark: SparkSession, folder: str, pattern: str = "*.tif", year: int | None = None) -> DataFrame:
    """doy, h, w, raw of all frames; unreadable files give no rows, so their day is missing, as are days without one.

    Each file is decoded by itself in a task, so only one frame at a time is in a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doy, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                try:
                    plane = decode(content.as_py())
                except ValueError:
                    continue
                h, w = np.indices(plane.shape, dtype=np.int32)
                raw = pa.array(plane.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(plane.size, doy, np.int32)), pa.array(h.ravel()), pa.array(w.ravel()), raw], names=["doy", "h", "w", "raw"])

    return _contents(spark, folder, pattern, year).mapInArrow(run, "doy int, h int, w int, raw int")


def frame_report(spark: SparkSession, folder: str, pattern: str = "*.tif", year: int | None = None) -> DataFrame:
    """One row (doy, path, height, width, error) a file; error says why a file that ``read`` passes over is unreadable. Spark skips empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doy, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                try:
                    shape, error = decode(content.as_py()).shape, None
                    shape, error = (shape, None) if len(shape) == 2 else ((None, None), f"a frame of {len(shape)} axes")
                except ValueError as found:
                    shape, error = (None, None), str(found)
                row = [pa.array([doy], pa.int32()), pa.array([path]), *(pa.array([n], pa.int32()) for n in shape), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(row, names=["doy", "path", "height", "width", "error"])

    return _contents(spark, folder, pattern, year).mapInArrow(run, "doy int, path string, height int, width int, error string")


def year_cube(spark: SparkSession, folder: str, year: int, shape: tuple[int, int], pattern: str = "*.tif", nodata: int = 65535, scale: float = 0.1) -> DataFrame:
    """t, h, w, raw, radiance of a whole year from a folder of frames."""
    return stack_year(read(spark, folder, pattern, year), year, shape, nodata, scale)


def encode_tiff(plane: np.ndarray) -> bytes:
    """A minimal little-endian TIFF of one 16-bit band, for fixtures and exports."""
    height, width = plane.shape
    pixels = plane.astype("<u2").tobytes()
    entries = [(256, 4, width), (257, 4, height), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(pixels))]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(pixels)) + pixels + body
