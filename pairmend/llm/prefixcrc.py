"""CRC-32 of any run of words, from running CRCs of the text that it stands in.

A text is brought to one form, words joined by single spaces, and scanned once; the CRC of every prefix that ends
at a word's bound is kept. A run's CRC is that of the prefix at its end, with the prefix at its start cancelled: CRCs
are linear over GF(2), so the earlier prefix, shifted by as many zero bytes as the run has, is taken off by exclusive or.
No run of words is ever put together or read again, whatever its length.
"""

from __future__ import annotations

import numpy as np

from pairmend.llm import kernels as K

#: The reflected polynomial of CRC-32, and its state before the first byte.
_POLYNOMIAL, _FULL = np.uint32(0xEDB88320), np.uint32(0xFFFFFFFF)
#: The scan goes down rows of this many bytes at once; shifts by fewer bytes have a table each.
ROW = 256

#: Bytes of words: all but ASCII other than 0-9 and a-z. Bytes of longer characters belong to words.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _byte_steps() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ _POLYNOMIAL, t >> np.uint32(1))
    return t


_STEP = _byte_steps()


def _near() -> np.ndarray:
    """[n, k, v]: what byte k of a state, having value v, becomes after n zero bytes."""
    out = np.empty((ROW + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(ROW):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ _STEP[out[n] & np.uint32(255)]
    return out


_NEAR = _near()


def _by(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return table[0][state & low] ^ table[1][state >> np.uint32(8) & low] ^ table[2][state >> np.uint32(16) & low] ^ table[3][state >> np.uint32(24)]


def _far() -> list[np.ndarray]:
    """The tables for ROW, 2 ROW, 4 ROW ... zero bytes, each the one before it applied twice."""
    out = [_NEAR[ROW]]
    while len(out) < 32:
        out.append(_by(out[-1], out[-1]))
    return out


_FAR = _far()


def shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States after n zero bytes each."""
    k, low = n % ROW, np.uint32(255)
    out = _NEAR[k, 0, state & low] ^ _NEAR[k, 1, state >> np.uint32(8) & low] ^ _NEAR[k, 2, state >> np.uint32(16) & low] ^ _NEAR[k, 3, state >> np.uint32(24)]
    left, table = n // ROW, 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _by(_FAR[table], out[odd])
        left, table = left >> 1, table + 1
    return out


def running(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CRC-32 of the first at bytes, for each of at: one scan, in rows side by side that are then chained."""
    n = -(-max(len(data), 1) // ROW)
    rows = np.zeros(n * ROW, np.uint8)
    rows[: len(data)] = data
    rows = np.ascontiguousarray(rows.reshape(n, ROW).T)
    own, state = np.empty((ROW, n), np.uint32), np.zeros(n, np.uint32)
    for k in range(ROW):
        state = _STEP[(state ^ rows[k]) & np.uint32(255)] ^ (state >> np.uint32(8))
        own[k] = state
    a, b, c, d = _NEAR[ROW].tolist()
    before, now = [], int(_FULL)
    for x in own[-1].tolist():
        before.append(now)
        now = x ^ a[now & 255] ^ b[now >> 8 & 255] ^ c[now >> 16 & 255] ^ d[now >> 24]
    row, k = np.maximum(at - 1, 0) // ROW, np.maximum(at - 1, 0) % ROW
    out = own[k, row] ^ shifted(np.array(before, np.uint32)[row], k + 1)
    return np.where(at == 0, np.uint32(0), out ^ _FULL)


def word_runs(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of texts in UTF-8 with A-Z lowered: how many words each has, and for runs of 1 to `longest` words
    (text, CRC-32 of the run's words joined by one space) for every run of every text, repeats and all.
    """
    data = K._LOWER[data]
    starts, ends, first = K.word_bounds(data, offsets, _GAP)
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)  # where each word starts when one space follows every word
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(to, size) + inside] = data[np.repeat(starts, size) + inside]
    del inside
    crc = running(joined, np.concatenate([to, to + size]))
    opens, closes = crc[: len(to)], crc[len(to) :]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = []
    for n in range(1, longest + 1):
        head = np.arange(max(0, len(to) - n + 1))
        head = head[text[head] == text[head + n - 1]]
        last = head + n - 1
        out.append((text[head], closes[last] ^ shifted(opens[head], to[last] + size[last] - to[head])))
    return np.diff(first), out
