"""Sampled suffix positions of texts.

Every window of ``length`` bytes names one of its positions as its anchor: the start of the k-byte string with the
smallest hash in the window (the leftmost of equal ones). The choice depends on the window's bytes alone, so equal
windows have their anchors at the same place, wherever they stand. A suffix array over the anchors therefore meets
every repeated window, with one entry for about ``(length - k) / 2`` bytes of text.
"""

from __future__ import annotations

import numpy as np

from lexmill.llm.bytewords import mix

#: Bytes of a suffix that stand in its entry.
K = 32
#: They only choose places: a collision of these hashes loses no repeat.
_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte strings of ``data``, by doubling their length."""
    h, base, width = _BYTE[data], 0x9E3779B97F4A7C13 | 3, 1
    while width < K:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    return mix(h)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first window, last window) of each run of windows with one anchor; positions in ``data``."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    if len(data) >= 1 << 32:
        raise ValueError("a text of 4 GB or more")
    span = length - K + 1  # k-byte strings of a window
    key = (_gram_hashes(data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - K + 1, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = span - width
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window
    cut = np.ones(len(anchor), dtype=bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    sizes = np.diff(offsets)
    for edge in (offsets[:-1], offsets[1:] - length + 1):
        at = edge[(sizes >= length) & (edge < len(anchor))]
        cut[at] = True
    # windows that cross documents form runs of their own, which go
    small = offsets[:-1][(sizes < length) & (offsets[:-1] < len(anchor))]
    cut[small] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(anchor)) - 1
    owner = np.searchsorted(offsets, first, side="right") - 1
    keep = last + length <= offsets[owner + 1]
    return owner[keep], anchor[first[keep]], first[keep], last[keep]
