"""Word patterns for expressions, and word hashes over Arrow text buffers for tasks.

A word is a maximal run of characters other than the six ASCII white-space
characters, so it never depends on a locale or on a regular-expression engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

CHUNK = 1 << 20  # bytes hashed at once: bounds a worker's memory, not the text
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection); wraps around."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _hash_bytes(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in ``data``; words also end at ``marks``."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[marks] = inside[marks]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    before = marks[marks > 0] - 1
    stop[before] = inside[before]
    first = np.flatnonzero(start)
    last = np.flatnonzero(stop) + 1
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * down[first]), first


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """End of a chunk that begins at ``at``: behind white space, or the end of the text."""
    stop = at + CHUNK
    while stop < end:
        spaces = np.flatnonzero(_SPACE[data[at:stop]])
        if len(spaces):
            return at + int(spaces[-1]) + 1
        stop += CHUNK
    return end


def hashed_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) for runs of rows; row i owns hashes[bounds[i]:bounds[i + 1]].

    Letters A-Z count as lower case. Nulls have no words. Rows are taken
    together up to CHUNK bytes; a longer row is hashed in chunks.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, body = texts.buffers()
    bounds = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1)
        stop = min(stop, n)
        lo, hi = int(bounds[row]), int(bounds[stop])
        if hi - lo <= CHUNK:
            marks = bounds[row:stop] - lo
            found, first = _hash_bytes(data[lo:hi], marks[marks < hi - lo]) if hi > lo else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield row, found, np.searchsorted(first, bounds[row : stop + 1] - lo)
        else:  # one long row
            parts, at = [], lo
            while at < hi:
                end = _cut(data, at, hi)
                parts.append(_hash_bytes(data[at:end], np.zeros(1, np.int64))[0])
                at = end
            found = np.concatenate(parts)
            yield row, found, np.array([0, len(found)])
        row = stop


def row_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each row."""
    for _, found, bounds in hashed_rows(texts):
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield found[a:b]
