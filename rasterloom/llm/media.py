"""Media columns: AVI files of motion JPEG, their frames, shots and clips.

A byte string becomes a silent AVI file. Each frame is a baseline JPEG of 32 x 24 grey samples whose twelve blocks
carry 48 bytes each as quantised coefficients; an entropy code of whole bytes keeps writing and reading lossless and
free of per-sample work. Reading follows the RIFF index, undoes the entropy code, and decodes the frames by the
inverse cosine transform; shots end where the histogram difference of neighbours stands out from its surroundings.
Files of other writers are decoded by their own quantisation and Huffman tables, in grey or colour, sub-sampled or not.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_rows, table, whole_text

#: The frame's size, its blocks and the bytes in each, frames a second, the unit of payload.
WIDTH, HEIGHT, BLOCKS, CARRIED, RATE = 32, 24, 12, 48, 25
UNIT = BLOCKS * CARRIED
#: Byte codes of the two entropy tables: DC difference of size 0; AC coefficient of size 8 without zeros before; end of block.
DC_ZERO, AC_EIGHT, BLOCK_END = 0, 0, 1
SCAN = BLOCKS * (2 + 2 * CARRIED)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, symbols: bytes) -> bytes:
    """A table whose codes all have eight bits: 0, 1, ... for the symbols in turn."""
    return segment(0xC4, bytes([kind, 0, 0, 0, 0, 0, 0, 0, len(symbols), 0, 0, 0, 0, 0, 0, 0, 0]) + symbols)


HEAD = b"".join([
    b"\xff\xd8", segment(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0"), segment(0xDB, b"\0" + b"\1" * 64),
    segment(0xC0, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)), huffman(0x00, b"\0"), huffman(0x10, b"\x08\0"),
    segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])
TAIL = b"\xff\xd9"


@cache
def zigzag() -> np.ndarray:
    """Raster position of the k-th coefficient in zigzag order."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


@cache
def cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.where(k == 0, np.sqrt(1 / 8), np.sqrt(1 / 4)) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """The data filled up with bytes 255 to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\xff")


def frames_of(payload: bytes) -> list[bytes]:
    """One JPEG for each unit of payload."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCKS, CARRIED)
    scan = np.empty((len(data), BLOCKS, 2 + 2 * CARRIED), np.uint8)
    scan[:, :, 0], scan[:, :, 1:-1:2], scan[:, :, 2:-1:2], scan[:, :, -1] = DC_ZERO, AC_EIGHT, data, BLOCK_END
    # bytes 255 of the entropy-coded part are followed by a zero, as the format asks
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\0") + TAIL for row in scan]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """The AVI file of a payload: header lists, one 00dc chunk a frame, and the index."""
    frames = frames_of(payload)
    most = max(map(len, frames))
    size = (WIDTH, HEIGHT)
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, *size, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, *size)
    picture = struct.pack("<IiiHH4sIiiII", 40, *size, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    movie, index, at = [b"movi"], [], 4
    for frame in frames:
        movie.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movie[-1])
    return chunk(b"RIFF", b"AVI " + lists + chunk(b"LIST", b"".join(movie)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, body start, body end) of the RIFF chunks between two places."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def read_frames(avi: bytes) -> tuple[list[bytes], float]:
    """The frames that the index lists, in its order, and the frames a second; ValueError if this is no such file.

    Offsets count from the list of frames or from the file's start, as writers differ. Without an index the list's
    own order counts.
    """
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movie, index = float(RATE), None, b""
    for name, a, b in chunks(avi, 12, len(avi)):
        if name == b"LIST" and avi[a : a + 4] == b"movi":
            movie = a, b
        elif name == b"LIST" and avi[a : a + 4] == b"hdrl":
            for inner, c, d in chunks(avi, a + 4, b):
                if inner == b"avih" and d - c >= 4 and (step := struct.unpack_from("<I", avi, c)[0]):
                    rate = 1e6 / step
        elif name == b"idx1":
            index = avi[a:b]
    if movie is None:
        raise ValueError("no list of frames")
    entries = [(n, o, s) for n, _, o, s in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if n[2:] in (b"dc", b"db")]
    if entries:
        name, first, _ = entries[0]
        base = movie[0] if avi[movie[0] + first : movie[0] + first + 4] == name else 0
        found = [avi[base + o + 8 : base + o + 8 + s] for _, o, s in entries]
    else:
        found, lists = [], [(movie[0] + 4, movie[1])]
        while lists:
            for name, a, b in chunks(avi, *lists.pop()):
                if name == b"LIST":
                    lists.append((a + 4, b))
                elif name[2:] in (b"dc", b"db"):
                    found.append(avi[a:b])
    if not found:
        raise ValueError("no frames")
    return found, rate


@cache
def codes(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For every 16 bits: the symbol that the code at their start stands for, and that code's length, 0 if none."""
    symbol, length, at, n = [0] * 65536, [0] * 65536, 0, 0
    for size, count in enumerate(counts, 1):
        for _ in range(count):
            span = 1 << (16 - size)
            if at + span > 65536 or n >= len(symbols):
                raise ValueError("broken Huffman table")
            symbol[at : at + span], length[at : at + span] = [symbols[n]] * span, [size] * span
            at, n = at + span, n + 1
    return symbol, length


class Bits:
    """Bits of an entropy-coded segment without its stuffed zeros; zeros beyond its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            more = self.data[self.at : self.at + 4].ljust(4, b"\0")
            self.held, self.n, self.at = (self.held & (1 << self.n) - 1) << 32 | int.from_bytes(more), self.n + 32, self.at + 4
        return self.held >> (self.n - n) & (1 << n) - 1

    def take(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.n -= n
        return value

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        at = self.peek(16)
        if not table[1][at]:
            raise ValueError("not a Huffman code")
        self.n -= table[1][at]
        return table[0][at]

    def number(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def decode_frame(frame: bytes) -> np.ndarray:
    """The 8-bit luma samples (row, column) of a baseline JPEG, by its own tables; ValueError if it is none or broken."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    tables, scales, parts, restart, at = {}, {}, [], 0, 2
    height = width = 0
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("no scan in the frame")
        mark, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4])
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = 64 << (body[0] >> 4 > 0)
                scales[body[0] & 15] = np.frombuffer(body[1 : 1 + wide].ljust(wide, b"\1"), ">u2" if wide > 64 else np.uint8).astype(np.float32)
                body = body[1 + wide :]
        elif mark == 0xC4:
            while len(body) > 16:
                n = sum(body[1:17])
                tables[body[0]] = codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5] or body[0] != 8:
                raise ValueError("unreadable frame header")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("not a baseline frame")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2])
        elif mark == 0xDA:
            break
    if not parts or not height or not width or not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in parts):
        raise ValueError("no frame header")
    if len(body) < 1 + 2 * len(parts) or body[0] != len(parts):
        raise ValueError("not a scan of all components")
    use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(len(parts))}
    try:
        plan = [(i, h, v, tables[use[c] >> 4], tables[16 | use[c] & 15]) for i, (c, h, v, _) in enumerate(parts)]
        scale = scales[parts[0][3]]
    except KeyError:
        raise ValueError("a table is missing") from None
    if len(parts) == 1:
        plan = [(0, 1, 1, *plan[0][3:])]
    most_h, most_v, (_, own_h, own_v, *_) = max(p[1] for p in plan), max(p[2] for p in plan), plan[0]
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if across * down > 1 << 20:
        raise ValueError("frame too large")
    grid = np.zeros((down * own_v, across * own_h, 64), np.float32)
    end = frame.rfind(b"\xff\xd9")
    pieces = re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end > at else len(frame)])
    bits, last, order = Bits(pieces[0]), [0] * len(plan), zigzag().tolist()
    for n in range(across * down):
        if restart and n and n % restart == 0:
            bits, last = Bits(pieces[min(n // restart, len(pieces) - 1)]), [0] * len(plan)
        for i, h, v, dc, ac in plan:
            for cell in range(h * v):
                last[i] += bits.number(bits.symbol(dc) & 15)
                values, k = {0: last[i]}, 1
                while k < 64:
                    run, size = divmod(bits.symbol(ac), 16)
                    if not size and run < 15:
                        break
                    k += run
                    if size and k < 64:
                        values[k] = bits.number(size)
                    k += 1
                if not i:
                    block = grid[n // across * v + cell // h, n % across * h + cell % h]
                    for k, value in values.items():
                        block[order[k]] = value * scale[k]
    own_width, own_height = -(-width * own_h // most_h), -(-height * own_v // most_v)
    return from_coefficients(grid[None])[0, :own_height, :own_width]


def from_coefficients(grid: np.ndarray) -> np.ndarray:
    """8-bit samples (frame, row, column) of blocks (frame, block row, block column, coefficient in raster order)."""
    c, (n, down, across, _) = cosines(), grid.shape
    pixels = np.matmul(np.matmul(c.T, grid.reshape(-1, 8, 8)), c) + 128
    pixels = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return pixels.reshape(n, down, across, 8, 8).swapaxes(2, 3).reshape(n, 8 * down, 8 * across)


def scan_bytes(frame: bytes) -> bytes:
    """The entropy-coded bytes of a frame, without the stuffed zeros."""
    if frame.startswith(HEAD) and frame.endswith(TAIL):
        return frame[len(HEAD) : -2].replace(b"\xff\0", b"\xff")
    raise ValueError("not a frame of this writer")


def read_back(frames: list[bytes]) -> np.ndarray:
    """The carried bytes as (frame, block, byte); ValueError if the entropy code isn't the writer's."""
    scan = np.frombuffer(b"".join(map(scan_bytes, frames)), np.uint8).reshape(len(frames), BLOCKS, 2 + 2 * CARRIED)
    if scan[:, :, 0].any() or scan[:, :, 1:-1:2].any() or (scan[:, :, -1] != BLOCK_END).any():
        raise ValueError("unexpected entropy code")
    return scan[:, :, 2:-1:2]


def decode(carried: np.ndarray) -> np.ndarray:
    """8-bit samples (frame, row, column): a byte with its high bit set is its own coefficient, others are less 255."""
    value = carried.astype(np.float32)
    value = np.where(carried >= 128, value, value - 255)
    grid = np.zeros((len(carried), BLOCKS, 64), np.float32)
    grid[:, :, zigzag()[1 : CARRIED + 1]] = value
    return from_coefficients(grid.reshape(len(carried), HEIGHT // 8, WIDTH // 8, 64))


def histograms(samples: np.ndarray, bins: int = 16) -> np.ndarray:
    """The shares of ``bins`` ranges of brightness in each frame."""
    n = len(samples)
    place = (samples.reshape(n, -1) >> 4).astype(np.int64) + bins * np.arange(n)[:, None]
    return np.bincount(place.ravel(), minlength=n * bins).reshape(n, bins) / samples[0].size


def differences(share: np.ndarray) -> np.ndarray:
    """Half the L1 distance of each frame's histogram to the one before; 0 for the first."""
    return np.concatenate(([0.0], np.abs(np.diff(share, axis=0)).sum(axis=1) / 2))


def shots(change: np.ndarray, window: int = 8, factor: float = 1.5, floor: float = 0.08) -> list[int]:
    """First frames of the shots: 0, and where the change passes the floor and the neighbours' mean plus ``factor`` deviations."""
    n = len(change)
    sums, squares = (np.concatenate(([0.0], np.cumsum(v))) for v in (change, change**2))
    at = np.arange(n)
    low, high = np.maximum(1, at - window), np.minimum(n, at + window + 1)
    count = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - change) / count
    deviation = np.sqrt(np.maximum((squares[high] - squares[low] - change**2) / count - mean**2, 0))
    cut = (at > 0) & (change > floor) & (change > mean + factor * deviation)
    return [0, *np.flatnonzero(cut).tolist()]


CLIP = StructType([
    StructField("clip", IntegerType()), StructField("start_s", DoubleType()), StructField("end_s", DoubleType()),
    StructField("n_frames", IntegerType()), StructField("mean_luma", DoubleType()), StructField("peak_change", DoubleType()),
])


def inspect(avi: bytes) -> tuple[bytes | None, list[dict]]:
    """The payload read back from a file, None of another writer's, and its clips; ValueError if it can't be read.

    Frames are decoded in groups, so long files stay small in memory.
    """
    frames, rate = read_frames(avi)
    ours = all(f.startswith(HEAD) for f in frames)
    carried, luma, share = [], [], []
    for at in range(0, len(frames), 512):
        if ours:
            part = read_back(frames[at : at + 512])
            carried.append(part.tobytes())
            groups = [decode(part)]
        else:
            groups = (decode_frame(f)[None] for f in frames[at : at + 512])
        for samples in groups:
            luma.append(samples.mean(axis=(1, 2), dtype=np.float64))
            share.append(histograms(samples))
    moved, bright = differences(np.concatenate(share)), np.concatenate(luma)
    firsts = shots(moved)
    clips = [
        {
            "clip": n, "start_s": a / rate, "end_s": b / rate, "n_frames": b - a,
            "mean_luma": round(float(bright[a:b].mean()), 4), "peak_change": round(float(moved[a:b].max()), 4),
        }
        for n, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(moved)], strict=True))
    ]
    return b"".join(carried) if ours else None, clips


def media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text's UTF-8 bytes, filled up, as an AVI file.

    Null texts count as empty and make one frame; repeated rows make equal files; an empty table makes none.
    """
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_bytes", LongType()), StructField("media", BinaryType())])

    def make():
        def each(key, text):
            data = text.encode("utf-8", "surrogatepass")
            return key, len(data), write_avi(padded(data))

        return each

    return map_rows(docs.select("doc_id", whole_text()), make, schema)


def read_media(files: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, clips, error) of such files.

    Files of other writers have clips but no payload. What can't be read, null included, gives a row without clips
    whose ``error`` says why; it is null otherwise.
    """
    names = [("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("media_bytes", LongType()), ("media_sha256", StringType())]
    fields = [files.schema["doc_id"], files.schema["n_bytes"], *(StructField(n, t) for n, t in names), StructField("clips", ArrayType(CLIP)), StructField("error", StringType())]

    def make():
        def each(key, n, avi):
            if avi is None:
                return key, n, None, None, None, None, None, None, "no file"
            stored = (len(avi), hashlib.sha256(avi).hexdigest())
            try:
                payload, clips = inspect(bytes(avi))
            except (ValueError, ArithmeticError, LookupError, TypeError, MemoryError, struct.error) as problem:
                return key, n, None, None, None, *stored, None, str(problem) or type(problem).__name__
            read = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            return key, n, *read, *stored, clips, None

        return each

    return map_rows(files.select("doc_id", "n_bytes", "media"), make, StructType(fields))


def clip_rows(files: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip, start_s, end_s, n_frames, mean_luma, peak_change."""
    return read_media(files).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def op6(spark, sf_dir: str) -> DataFrame:
    found = read_media(media(table(spark, sf_dir, "documents")))
    one = lambda c: F.format_string("%.2f-%.2f:%d:%.4f:%.4f", c["start_s"], c["end_s"], c["n_frames"], c["mean_luma"], c["peak_change"])
    feature = F.concat(F.lit("clips="), F.size("clips").cast("string"), F.lit(";"), F.array_join(F.transform("clips", one), ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
