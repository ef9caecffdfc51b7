"""Counter-based random numbers.

Every draw is a pure function of its labels (replicate, unit, ...), so it does
not depend on partitioning, survives recomputation after an executor loss, and
can be reproduced by any engine that has md5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 4294967296.0  # first 32 bits of the digest


def _as_column(part) -> Column:
    if isinstance(part, Column):
        return part
    return F.lit(part)


def uniform(*labels) -> Column:
    """Uniform number in [0, 1) keyed by ``labels``."""
    key = F.concat_ws(":", *[_as_column(p).cast("string") for p in labels])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(_RANGE)


def draw_index(n, *labels) -> Column:
    """Integer in 0..n-1 keyed by ``labels``."""
    return F.floor(uniform(*labels) * _as_column(n)).cast("bigint")


# --- the same numbers for whole arrays, inside a task ---------------------------

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LANES = 8192  # messages hashed together: their words stay in the processor's cache


def _first_word(words: list) -> np.ndarray:
    """First four digest bytes of one-block md5 messages; a word is an array, or an int all messages share."""
    size = next(len(w) for w in words if not isinstance(w, int))
    a, b, c, d = (np.full(size, v, np.uint32) for v in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            f ^= d
        elif turn == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            f ^= c
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.bitwise_not(d, out=f), b, out=f)
            f ^= c
        f += a
        if isinstance(words[at], int):
            f += np.uint32((_SINES[i] + words[at]) % 2**32)
        else:
            f += np.uint32(_SINES[i])
            f += words[at]
        shift = _SHIFTS[turn][i % 4]
        np.right_shift(f, 32 - shift, out=t)
        f <<= shift
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_START[0])).byteswap()


class Keys:
    """Last labels of many draws, each with its leading colon, held by length."""

    def __init__(self, tails: list[bytes]) -> None:
        self.tails, lengths = tails, np.array([len(t) for t in tails])
        self.parts = []
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            joined = b"".join(tails[i] for i in at)
            self.parts.append((int(length), at, np.frombuffer(joined, np.uint8).reshape(len(at), length)))

    def first_words(self, head: str) -> np.ndarray:
        """Numerators of ``uniform(head, label)``: the first 32 bits of md5(head + tail)."""
        head, out = head.encode(), np.empty(len(self.tails), np.uint32)
        for length, at, tails in self.parts:
            size = len(head) + length
            if size > 55:  # more than one block
                out[at] = [int.from_bytes(hashlib.md5(head + self.tails[i]).digest()[:4], "big") for i in at]
                continue
            plain = np.zeros(64, np.uint8)
            plain[: len(head)] = np.frombuffer(head, np.uint8)
            plain[size] = 0x80
            plain[56:58] = (8 * size) % 256, 8 * size // 256
            first, last = len(head) // 4, max(-(-size // 4), len(head) // 4 + 1)  # words that differ
            shared = [int(v) for v in plain.view("<u4")]
            for lo in range(0, len(at), _LANES):
                part = tails[lo : lo + _LANES]
                block = np.tile(plain[4 * first : 4 * last], (len(part), 1))
                block[:, len(head) - 4 * first : size - 4 * first] = part
                columns = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False)
                out[at[lo : lo + _LANES]] = _first_word([*shared[:first], *columns, *shared[last:]])
        return out

    def orders(self, seed, reps) -> Iterator[tuple[int, np.ndarray]]:
        """(rep, numbers by position): numbers from 0 in order of ``uniform(seed, rep, label)``, ties by number."""
        number = np.arange(len(self.tails), dtype=np.uint64)
        for rep in reps:
            slots = (self.first_words(f"{seed}:{rep}").astype(np.uint64) << np.uint64(32)) | number
            slots.sort()
            yield rep, (slots & np.uint64(0xFFFFFFFF)).astype(np.int64)
