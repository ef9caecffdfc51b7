"""Token ids of texts, for vocabularies whose tokens never cross ASCII white space.

A batch of texts is split at white space and its runs are dictionary-encoded by
Arrow, so Python sees each distinct run of a batch once. The ids of known runs
lie one behind the other in one buffer; the ids of the batch are gathered from
it without a loop over words.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH = 4 << 20  # bytes split at once; a text may be longer
KNOWN = 1_500_000  # runs a worker remembers
TOGETHER = 2_000  # unknown runs encoded at once
TAIL = ".,;:!?"  # marks that begin a piece of their own behind a letter
_GAP = re.compile(rb"[\x20\x09-\x0D]")


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype) -> None:
        self.data, self.used = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(end, 2 * self.used) - self.used, self.data.dtype)])
        self.data[self.used : end] = values
        self.used = end


class Encoder:
    """Ids by run. Unknown runs are encoded together, with something between them that marks where each one ends."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = next(iter(self.tokenizer.get_added_tokens_decoder().items()), None)
        self.mark, self.between = (special[0], special[1].content) if special else (-1, "")
        model = json.loads(self.tokenizer.to_str())["model"]
        self.suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.first, self.count = Grown("<u4"), Grown(np.int64), Grown(np.int64)
        self.first.add(np.zeros(1, np.int64))
        self.count.add(np.zeros(1, np.int64))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.first.add(self.flat.used + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.flat.add(ids)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the runs with these numbers, one behind the other."""
        counts = self.count.data[code]
        at = np.arange(int(counts.sum()))
        at += np.repeat(self.first.data[code] - (np.cumsum(counts) - counts), counts)
        return self.flat.data[at], counts

    def _letters(self, words: list[str]) -> None:
        """Words of ASCII letters: a blank parts them, and each is one piece, which ends in the one token that ends a piece."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = self.ids(" ".join(some))
            self._add(some, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))

    def _others(self, words: list[str]) -> None:
        """Any words; the mark parts them, where they do not hold its start."""
        start = self.between[:2]
        alone = [w for w in words if not start or start in w]
        for word in alone:
            ids = self.ids(word)
            self._add([word], ids, np.array([len(ids)]))
        words = [w for w in words if start and start not in w]
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = self.ids(self.between.join(some))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            self._add(some, ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)

    def _learn(self, words: list[str]) -> None:
        """Runs of ASCII letters with closing marks are put together from both, the others are encoded whole."""
        runs = pa.array(words, pa.string())
        core = pc.ascii_rtrim(pc.ascii_lower(runs), TAIL)
        simple = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False) if self.suffix else np.zeros(len(words), bool)
        cores = core.to_pylist()
        self._letters([w for w in dict.fromkeys(c for c, s in zip(cores, simple) if s) if w not in self.number])
        tails = [w[len(c) :] if s else "" for w, c, s in zip(words, cores, simple)]
        self._others([w for w in dict.fromkeys([*tails, *(w for w, s in zip(words, simple) if not s)]) if w not in self.number])
        both = [i for i in np.flatnonzero(simple) if words[i] not in self.number]
        if both:
            code = np.array([(self.number[cores[i]], self.number[tails[i]]) for i in both]).ravel()
            ids, counts = self._gather(code)
            self._add([words[i] for i in both], ids, counts.reshape(-1, 2).sum(1))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each distinct run, learnt where unknown."""
        missing = [w for w in words if w not in self.number]
        if len(self.number) + 2 * len(missing) > KNOWN:
            self.forget()  # costs time and changes nothing
            missing = [w for w in words if w]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): row i owns ids[bounds[i]:bounds[i + 1]]. No nulls."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        try:
            words = coded.dictionary.to_pylist()
        except UnicodeDecodeError:  # bytes that are no UTF-8; two such runs may then read the same
            words = [w.decode("utf-8", "replace") for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        if not words:
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        ids, counts = self._gather(self.numbers(words)[coded.indices.to_numpy()])
        return ids, np.concatenate([[0], np.cumsum(counts)])[parts.offsets.to_numpy()]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row; a null is empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(column):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + BATCH, "right")))
            some = column.slice(at, stop - at).fill_null("")
            if ends[stop - 1] - before <= BATCH:
                ids, bounds = self.rows(some)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    yield ids[a:b]
            else:  # one long text
                yield np.concatenate([self.rows(part)[0] for part in _parts(some)])
            at = stop


def _parts(text: pa.Array) -> Iterator[pa.Array]:
    """A long text cut at white space."""
    data = text.cast(pa.binary())[0].as_py()
    at = 0
    while at < len(data):
        found = _GAP.search(data, at + BATCH) if len(data) - at > BATCH else None
        stop = found.start() if found else len(data)
        yield pa.array([data[at:stop]], pa.binary()).view(pa.string())
        at = stop


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Made once per worker process and file."""
    return Encoder(path)
