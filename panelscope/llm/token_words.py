"""Texts as runs between ASCII white space, for tokenizers that never join such runs.

The vocabulary's splitting pattern has no match across white space and its
normaliser changes no character by a neighbour beyond it, so a text's tokens
are those of its runs, and each distinct run is looked at once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

CHUNK = 1 << 20  # bytes split at once; a text may be longer
ROWS = 512
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def runs(data: bytes) -> Iterator[list[bytes]]:
    """Lists of the runs of a text, in order."""
    at = 0
    while at < len(data):
        found = _GAP.search(data, at + CHUNK) if len(data) - at > CHUNK else None
        stop = found.start() if found else len(data)
        yield data[at:stop].split()  # bytes split at ASCII white space only
        at = stop


def texts(column: pa.Array) -> Iterator[bytes]:
    """The texts as bytes; null is empty."""
    for at in range(0, len(column), ROWS):
        for value in column.slice(at, ROWS).cast(pa.binary()).to_pylist():
            yield value or b""


class Bounded(dict):
    """Values by key, computed where missing; emptied when full, which costs time and changes nothing."""

    def __init__(self, compute, limit: int) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
