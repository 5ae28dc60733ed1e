"""Vectorised helpers over Arrow text columns: byte buffers, words, and hashes of words.

A chunk is a run of rows whose texts stand one after another in one byte array. Everything here is numpy over
such chunks inside a Spark task; chunks are kept to a few megabytes, so a task's memory does not follow the
size of its partition (a single longer text is a chunk of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 256 << 10

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15

#: Bytes that separate words: space and the controls 0x09 to 0x0D.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Random words by place in a word and byte; A-Z have those of a-z. Longer words are hashed by a digest of their bytes.
TABLE_BYTES = 64
_TABLE = mix(np.arange(1, TABLE_BYTES * 256 + 1, dtype=np.uint64) * np.uint64(_STEP)).reshape(TABLE_BYTES, 256)
_TABLE_LOWER = np.ascontiguousarray(_TABLE[:, _LOWER]).ravel()


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by document) of the words; a word never crosses documents."""
    inside = _IS_WORD[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z, the same wherever the word stands.

    Words of up to ``TABLE_BYTES`` bytes are hashed by tabulation (the random words of their bytes by place, combined by
    exclusive or), longer ones by a digest: no two words collide but by chance.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(first[-1] + size[-1]), dtype=np.int64) - np.repeat(first, size)
    letters = data[place + np.repeat(starts, size)]
    np.minimum(place, TABLE_BYTES - 1, out=place)
    out = mix(np.bitwise_xor.reduceat(_TABLE_LOWER[place * 256 + letters], first) + size.astype(np.uint64))
    for i in np.flatnonzero(size > TABLE_BYTES).tolist():
        word = _LOWER[data[starts[i] : ends[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def shingle_hashes(hashes: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of all runs of ``width`` words; of the whole text if it has fewer words."""
    n = np.diff(word_offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    offsets = np.zeros(len(word_offsets), dtype=np.int64)
    np.cumsum(count, out=offsets[1:])
    out = np.zeros(int(offsets[-1]), dtype=np.uint64)
    if not len(out):
        return out, offsets
    first = np.repeat(word_offsets[:-1] - offsets[:-1], count) + np.arange(len(out))
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    length = np.minimum(np.repeat(n, count), width)
    for k in range(width):
        part = padded[first + k]
        if k:
            part = np.where(k < length, part, np.uint64(0))
        out = mix(out * np.uint64(_STEP) + part + np.uint64(k + 1))
    return mix(out + length.astype(np.uint64)), offsets


def segments_unique(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, ascending, with new offsets."""
    if not len(values):
        return values, offsets
    values, cuts = values.copy(), offsets.tolist()
    for x, y in zip(cuts, cuts[1:], strict=False):
        values[x:y].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(keep, out=out[1:])
    return values[keep], out[offsets]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
