"""Numpy kernels over Arrow text buffers: word bounds and 64-bit word, window and shingle hashes.

They work on the UTF-8 bytes of a slice of rows at once, so that no Python object is made per word.
Hashes are fixed functions of the bytes, alike on every executor and in every run.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time. The working arrays take about 60 times as much, so a text that is
#: longer (it is a slice by itself) takes about 60 times its own size.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)
#: Words of more bytes than this are digested each by itself.
LONG_WORD = 64
#: Masks that keep the first 0 .. 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def released(batches: Iterator) -> Iterator:
    """The batches of a task; after the last one the worker, which waits for other tasks, gives freed memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each; a longer text is alone in its range."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and for n texts the n + 1 places among the words; gap: bytes between words."""
    solid = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower maps A-Z to a-z first, and lanes 0 and 1 are independent.

    Words of up to eight bytes and one length never collide: their bytes go through bijections. Longer words get a digest's
    bytes, once for each that differs, so that nobody can write words that collide (a state that eight known bytes can
    be cancelled from would let them).
    """
    return word_lanes(data, starts, ends, lower, (lane,))[0]


def word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lanes: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
    """word_hashes() of several lanes, with the long words' digests taken once."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in lanes]
    data = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    size = ends - starts
    eights = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))
    part = eights[starts].view("<u8").ravel() & _FIRST[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    digests = _digests(data, eights, starts[long], size[long])
    out = []
    for lane in lanes:
        h = mix((mix(size.astype(np.uint64) * _ODD[lane] + _ODD[2 + lane]) ^ part) * _ODD[lane] + _ODD[2 + lane])
        h[long] = digests[:, lane]
        out.append(h)
    return out


def _digests(data: np.ndarray, eights: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers of a digest of each word: taken of one word of each kind, by a quick hash whose equals are compared byte by byte."""
    state, live, at = size.astype(np.uint64), np.arange(len(starts)), 0
    while len(live):
        block = eights[starts[live] + at].view("<u8").ravel() & _FIRST[np.minimum(size[live] - at, 8)]
        state[live] = mix((state[live] ^ block) * _ODD[0] + _ODD[2])
        at += 8
        live = live[(size[live] > at) & (size[live] <= LONG_WORD)]
    _, first, kind = np.unique(state, return_index=True, return_inverse=True)
    like = first[kind]
    alone = (size != size[like]) | (size > LONG_WORD)
    live, at = np.flatnonzero(~alone & (like != np.arange(len(like)))), 0
    while len(live):
        keep = _FIRST[np.minimum(size[live] - at, 8)]
        alone[live] |= (eights[starts[live] + at].view("<u8").ravel() & keep) != (eights[starts[like[live]] + at].view("<u8").ravel() & keep)
        at += 8
        live = live[size[live] > at]
    raw = data.tobytes()
    one = lambda k: hashlib.blake2b(raw[starts[k] : starts[k] + size[k]], digest_size=16).digest()
    out = np.frombuffer(b"".join(map(one, first.tolist())), "<u8").reshape(-1, 2)[kind]
    for k in np.flatnonzero(alone).tolist():
        out[k] = np.frombuffer(one(k), "<u8")
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words: len(words) - size + 1 of them, or none.

    Runs of two, four, eight words and so on are mixed from two halves, and a run of any size from those.
    """
    n = len(words) - size + 1
    if n < 1 or size < 1:
        return np.zeros(0, np.uint64)
    run, length, out, done, left = words, 1, None, 0, size
    while left:
        if left & 1:
            out = run[:n] if out is None else mix(out * _ODD[0] + run[done : done + n] * _ODD[2] + np.uint64(length))
            done += length
        left >>= 1
        if left:
            run, length = mix(run[:-length] * _ODD[1] + run[length:] + np.uint64(length)), 2 * length
    return mix(out ^ np.uint64(size))
