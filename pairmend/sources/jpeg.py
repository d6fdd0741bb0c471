"""JPEG files from decoded images: baseline, RGB in and Y, Cb, Cr out, colour at half the resolution both ways.

Spark's image source decodes; this is the way back. Code tables are made for each image from its own symbols.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUALITY = 92

#: The example quantisation tables of the JPEG standard, brightness and colour, row by row.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)

#: An 8 x 8 block by rising diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The cosine transform of eight values.
_U = np.arange(8)
DCT = np.where(_U[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16))
#: Blocks whose symbols are held at a time.
BLOCKS = 12_288
RESERVED = 256


def normalized(images: DataFrame, quality: int = QUALITY) -> DataFrame:
    """origin and content: read_images' rows as JPEG files, null where an image could not be read or has a side over 65,535."""

    @F.pandas_udf("binary")
    def encoded(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([of_image(*x, quality) for x in zip(data, height, width, channels, strict=True)], dtype=object)

    return images.select("origin", encoded("data", "height", "width", "channels").alias("content"))


def of_image(data: bytes | None, height: int | None, width: int | None, channels: int | None, quality: int = QUALITY) -> bytes | None:
    """A JPEG of rows of blue, green, red (and alpha, which goes) or of grey bytes; None for what could not be read."""
    if data is None or pd.isna(height) or pd.isna(width) or not (0 < height < 65536 and 0 < width < 65536):
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))
    return encode(pixels[:, :, [2, 1, 0]] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, 2), quality)


def steps(table: tuple[int, ...], quality: int) -> np.ndarray:
    """A quantisation table at a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised 8 x 8 blocks in zigzag order: rows of blocks, columns of blocks, 64."""
    h, w = (n // 8 for n in plane.shape)
    square = plane.reshape(h, 8, w, 8).swapaxes(1, 2) - np.float32(128)
    found = (DCT.astype(np.float32) @ square @ DCT.T.astype(np.float32)).reshape(h, w, 64)
    return np.clip(np.rint(found / table.astype(np.float32)), -1023, 1023).astype(np.int16)[:, :, ZIGZAG]


def _differences(blocks: np.ndarray) -> np.ndarray:
    """blocks (in the order in which they are written) with each first value less the one before."""
    out = blocks.copy()
    out[1:, 0] -= blocks[:-1, 0]
    return out


def scan(pixels: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All blocks as they are written: of each 16 x 16 pixels four of brightness, then two of colour."""
    height, width = pixels.shape[:2]
    rgb = np.pad(pixels, ((0, -height % 16), (0, -width % 16), (0, 0)), "edge").astype(np.float32)
    r, g, b = rgb[:, :, 0], rgb[:, :, 1], rgb[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    rows, cols = (n // 16 for n in y.shape)
    bright = _blocks(y, tables[0]).reshape(rows, 2, cols, 2, 64).swapaxes(1, 2).reshape(-1, 64)
    out = np.empty((rows * cols, 6, 64), np.int16)
    out[:, :4] = _differences(bright).reshape(-1, 4, 64)
    for k, colour in ((4, (b - y) * np.float32(1 / 1.772)), (5, (r - y) * np.float32(1 / 1.402))):
        half = colour.reshape(rows * 8, 2, cols * 8, 2).mean((1, 3)) + 128
        out[:, k] = _differences(_blocks(half, tables[1]).reshape(-1, 64))
    return out.reshape(-1, 64)


def _tokens(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """table, symbol, value bits and their number, of whole groups of six blocks, in the order in which they are written.

    Tables are 0 and 1 for first values of brightness and colour, 2 and 3 for the others.
    """
    of = np.arange(len(blocks)) % 6 >= 4
    at, k = np.nonzero(blocks[:, 1:])
    k += 1
    follows = np.concatenate([[False], at[1:] == at[:-1]])
    run = k - np.where(follows, np.concatenate([[0], k[:-1]]), 0) - 1
    value = blocks[at, k].astype(np.int64)
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, at, k)
    skips, ends = np.repeat(np.arange(len(at)), run // 16), np.flatnonzero(last < 63)
    first = blocks[:, 0].astype(np.int64)
    where = np.concatenate([np.arange(len(blocks)) * 130, at * 130 + 2 * k + 1, at[skips] * 130 + 2 * k[skips], ends * 130 + 129])
    values = np.concatenate([first, value, np.zeros(len(skips) + len(ends), np.int64)])
    bits = np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)
    symbol = bits.copy()
    symbol[len(first) : len(first) + len(value)] += (run % 16) << 4
    symbol[len(first) + len(value) : len(first) + len(value) + len(skips)] = 0xF0
    table = np.concatenate([of.astype(np.int64), 2 + of[at], 2 + of[at[skips]], 2 + of[ends]])
    order = np.argsort(where, kind="stable")
    low = np.where(values < 0, values + (1 << bits) - 1, values)
    return table[order], symbol[order], low[order], bits[order]


def code_table(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """How many codes there are of each length from 1 to 16, and the symbols by their codes, for symbols so frequent.

    A symbol that never occurs takes the code of ones alone, which a file may not use.
    """
    heap = [(int(n), s, [s]) for s, n in enumerate(counts) if n] + [(0, RESERVED, [RESERVED])]
    depth = dict.fromkeys((s for _, s, _ in heap), 0)
    if len(heap) == 1:
        return [0] * 16, []
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, s, some), (m, _, more) = heapq.heappop(heap), heapq.heappop(heap)
        for x in some + more:
            depth[x] += 1
        heapq.heappush(heap, (n + m, s, some + more))
    lengths = np.bincount(list(depth.values()), minlength=18)
    for i in range(len(lengths) - 1, 16, -1):  # pairs that are too deep go up, beside a leaf that goes down
        while lengths[i] > 0:
            j = int(np.flatnonzero(lengths[: i - 1])[-1])
            np.add.at(lengths, [i, i - 1, j + 1, j], [-2, 1, 2, -1])  # i - 1 and j + 1 may be one
    lengths[np.flatnonzero(lengths)[-1]] -= 1
    return lengths[1:17].tolist(), sorted((s for s in depth if s != RESERVED), key=lambda s: (depth[s], s))


def _codes(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code and its length."""
    codes, sizes, code, given = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, iter(symbols)
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            s = next(given)
            codes[s], sizes[s] = code, size
            code += 1
        code <<= 1
    return codes, sizes


def _packed(blocks: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of blocks, a stretch at a time."""
    for start in range(0, len(blocks), BLOCKS):
        table, symbol, low, more = _tokens(blocks[start : start + BLOCKS])
        length = sizes[table, symbol] + more
        value = codes[table, symbol] << more | low
        token = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(token)) - np.repeat(length.cumsum() - length, length)
        yield (value[token] >> (length[token] - 1 - place) & 1).astype(np.uint8)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(pixels: np.ndarray, quality: int = QUALITY) -> bytes:
    """A JPEG file of rows of red, green, blue bytes, 65,535 at most each way."""
    height, width = pixels.shape[:2]
    tables = steps(BRIGHTNESS, quality), steps(COLOUR, quality)
    blocks = scan(pixels, tables)
    counts = np.zeros(4 * 256, np.int64)
    for start in range(0, len(blocks), BLOCKS):
        table, symbol, _, _ = _tokens(blocks[start : start + BLOCKS])
        counts += np.bincount(table * 256 + symbol, minlength=len(counts))
    made = [code_table(c) for c in counts.reshape(4, 256)]
    codes, sizes = (np.array(x) for x in zip(*[_codes(*m) for m in made], strict=True))
    bits = np.concatenate(list(_packed(blocks, codes, sizes)))
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0]))]
    out += [_segment(0xDB, bytes([i, *t[ZIGZAG].tolist()])) for i, t in enumerate(tables)]
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    out += [_segment(0xC4, bytes([(i // 2) << 4 | i % 2, *lengths, *symbols])) for i, (lengths, symbols) in enumerate(made)]
    out.append(_segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    return b"".join([*out, data, b"\xff\xd9"])
