"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a piece form a linked list; a heap holds its adjacent pairs by
(rank, position). The lowest is popped, the pair is merged, and the two new
neighbours are pushed; stale entries are skipped. The count is the number of
symbols at first minus the number of merges: no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.token_words import Bounded, runs, texts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 500_000


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Counter:
    """Counts tokens of runs for a vocabulary file with lower-casing, a word-end suffix and byte-level symbols."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = [ids[c] for c in byte_symbols()]
        self.last = [ids[c + end] for c in byte_symbols()]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.counts = Bounded(self.run, CACHE)

    def run(self, data: bytes) -> int:
        """Tokens of a run without ASCII white space; a special string in it is one token."""
        text = data.decode("utf-8", "replace")
        total = 0
        if "<|" in text:
            total = len(self.special.findall(text))
            parts = self.special.split(text)
        else:
            parts = [text]
        for part in parts:
            plain = part if part.isascii() else unicodedata.normalize("NFC", part)
            plain = plain.lower() if plain.isascii() else "".join(c.lower() for c in plain)
            for piece in self.pattern.findall(plain):
                total += self.piece(piece.encode())
        return total

    def piece(self, data: bytes) -> int:
        n = len(data)
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            if found := merges.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = merges.get((symbol[i], symbol[j]))
            if found is None or found[0] != rank:
                continue  # one side has been merged since
            symbol[i], symbol[j] = made, -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, symbol[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbol[h], made))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return count

    def text(self, data: bytes) -> int:
        count = self.counts.__getitem__
        return sum(sum(map(count, part)) for part in runs(data))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """Made once per worker process and file."""
    return Counter(path)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``, in one pass without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are
    counted whole. Repeated rows are counted each; other columns are ignored.
    """
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            size, tokens = [], []
            for data in texts(batch.column(1)):
                size.append(len(data))
                tokens.append(own.text(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
