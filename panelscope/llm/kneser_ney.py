"""Interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in sorted hash arrays.

1. Tasks hash the training words, merge equal ones and send them in blocks to
   buckets by the leading bits of the hash; each bucket is merged into a sorted
   array. A word's number is its place in all arrays.
2. Tasks merge equal pairs of neighbours and send them in blocks to buckets by
   the first word (for words with more than a bucket's share of all tokens, by
   the pair). A bucket becomes a sorted array of pair hashes with counts; its
   sums by first and by second word go on to the buckets of these words.
3. A word's bucket adds up what its discounts need.

Pair hashes are a bijection of the two word numbers, so pairs cannot collide;
words are told apart by 64 bits. Arrays lie in the shared folder as plain
files, which workers memory-map. The driver sees only sums and file sizes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.words import hashed_rows, mix
from panelscope.sources.durable import shared_folder

U = np.uint64
END = U(0x6C62272E07BB0142)  # the hash of the end of a text
BEGIN = U(0xFFFFFFFF)  # the number of the begin of a text, a context only
HELD = 1 << 21  # entries a task holds before it sends them
FOLDS, HELD_OUT = 7, 2
WORD = np.dtype([("count", "<u8"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("before", "<u4")])
BLOCK = "bucket long, kind int, keys binary, counts binary"


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix((first << U(32)) | second)


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> U(32))
    x = x * U(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x = x ^ (x >> U(29)) ^ (x >> U(58))
    x = x * U(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return x ^ (x >> U(33))


# files in the shared folder


def _store(folder: str):
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a repeated task does no harm."""
    store, path = _store(folder)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(array.tobytes())
    store.move(part, f"{path}/{name}")


@lru_cache(maxsize=20_000)
def _array(folder: str, name: str, kind: str) -> np.ndarray:
    """A memory-mapped file; from a remote store it is copied to a file that has no name once it is mapped."""
    store, path = _store(folder)
    dtype = WORD if kind == "word" else np.dtype(kind)
    info = store.get_file_info(f"{path}/{name}")
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    fd, own = tempfile.mkstemp()
    with os.fdopen(fd, "wb") as out, store.open_input_stream(f"{path}/{name}") as data:
        while block := data.read(1 << 24):
            out.write(block)
    found = np.memmap(own, dtype, "r")
    os.unlink(own)
    return found


# blocks of (key, count) on their way to a bucket


def _blocks(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray, kind: int) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    keys, counts, buckets = keys[order], counts[order], buckets[order]
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.zeros(0, int)
    ends = np.append(starts[1:], len(buckets))
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[starts].astype(np.int64)), pa.array([kind] * len(starts), pa.int32()), pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(starts, ends)], pa.binary())],
        ["bucket", "kind", "keys", "counts"],
    )


def _sent(parts: Iterator[np.ndarray], bucket_of) -> Iterator[pa.RecordBatch]:
    """Merges equal keys of a task, HELD entries at a time."""
    keys, counts = np.zeros(0, U), np.zeros(0, np.uint64)
    for part in parts:
        some = merged(part, np.ones(len(part), np.uint64))
        keys, counts = np.concatenate((keys, some[0])), np.concatenate((counts, some[1]))
        if len(keys) > HELD:
            keys, counts = merged(keys, counts)
            if len(keys) > HELD // 2:
                yield _blocks(keys, counts, bucket_of(keys), 0)
                keys, counts = keys[:0], counts[:0]
    if len(keys):
        keys, counts = merged(keys, counts)
        yield _blocks(keys, counts, bucket_of(keys), 0)


def _joined(table: pa.Table, kind: int, width=U) -> tuple[np.ndarray, np.ndarray]:
    rows = [(k, c) for k, c, x in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), table.column("kind").to_pylist()) if x == kind]
    keys = np.frombuffer(b"".join(k for k, _ in rows), width)
    return keys, np.frombuffer(b"".join(c for _, c in rows), np.uint32).astype(np.uint64)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens with an END behind each text, bounds of the texts)."""
    for row, found, bounds in hashed_rows(batch.column(batch.schema.names.index("text"))):
        yield row, np.insert(found, bounds[1:], END), bounds + np.arange(len(bounds))


class Words:
    """Numbers and statistics of words in the memory-mapped arrays."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...]) -> None:
        self.folder, self.bits = folder, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the training texts don't have it."""
        unique, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(unique), -1, np.int64)
        shift = U(64 - self.bits)
        bounds = np.searchsorted(unique >> shift, np.arange((1 << self.bits) + 1, dtype=U))
        for b in np.flatnonzero(np.diff(bounds)):
            part = unique[bounds[b] : bounds[b + 1]]
            held = _array(self.folder, f"words-{b}", "<u8")
            if len(held):
                at = np.minimum(np.searchsorted(held, part), len(held) - 1)
                out[bounds[b] : bounds[b + 1]] = np.where(held[at] == part, at + self.starts[b], -1)
        return out[back]

    def looked_up(self, numbers: np.ndarray, name: str, kind: str) -> np.ndarray:
        """The row of each word in a file that lies beside its array; zeros for -1."""
        unique, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(unique), WORD if kind == "word" else kind)
        bounds = np.searchsorted(unique, self.starts)
        for b in np.flatnonzero(np.diff(bounds)):
            held = _array(self.folder, f"{name}-{b}", kind)
            out[bounds[b] : bounds[b + 1]] = held[unique[bounds[b] : bounds[b + 1]] - self.starts[b]]
        return out[back]


@lru_cache(maxsize=2)
def _words(folder: str, bits: int, sizes: tuple[int, ...]) -> Words:
    return Words(folder, bits, sizes)


def _neighbours(tokens: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The number of the word before each token; BEGIN at the start of a text."""
    before = np.empty(len(tokens), U)
    before[1:] = numbers[:-1]
    before[bounds[:-1]] = BEGIN
    return before


def _first_bucket(first: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """By the first word; by the pair for hot words."""
    shift = U(64 - bits)
    return np.where(np.isin(first, hot), keys >> shift, mix(first + U(1)) >> shift)


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if not (t1 and t2):
        return 0.5, 1.0, 1.5
    y = t1 / (t1 + 2 * t2)
    d1 = 1 - 2 * y * t2 / t1
    d2 = 2 - 3 * y * t3 / t2
    d3 = 3 - 4 * y * t4 / t3 if t3 else 1.5
    return min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


class Model:
    """Sums that the driver holds, and the folder of the arrays."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...], tokens: int, begin: np.ndarray, pairs: list[int], words: list[int], hot: np.ndarray) -> None:
        self.folder, self.bits, self.sizes, self.tokens, self.hot = folder, bits, sizes, tokens, hot
        self.types = sum(sizes)
        self.pair_d, self.word_d = discounts(pairs[:4]), discounts(words[:4])
        self.kinds = pairs[4]  # distinct pairs
        self.begin = begin  # total, n1, n2, n3 of the begin of a text
        n3 = words[5]
        self.word_rest = self.word_d[0] * words[0] + self.word_d[1] * words[1] + self.word_d[2] * n3

    def scores(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """known, log10 of the base and log10 of the model, by token."""
        words = _words(self.folder, self.bits, self.sizes)
        numbers = words.numbers(tokens)
        stats = words.looked_up(numbers, "stats", "word")
        base = np.log10((stats["count"] + 1.0) / (self.tokens + 1.0 * (self.types + 1)))
        if self.kinds:
            cont = stats["before"].astype(float)
            lower = (np.maximum(cont - _discount(stats["before"], self.word_d), 0) + self.word_rest / (self.types + 1)) / self.kinds
        else:
            lower = np.full(len(tokens), 1.0 / (self.types + 1))
        context = np.zeros((4, len(tokens)))
        for i, name in enumerate(("total", "n1", "n2", "n3")):
            context[i, 1:] = stats[name][:-1]
            context[i, bounds[:-1]] = self.begin[i]
        total = context[0]
        before = _neighbours(tokens, bounds, numbers.astype(U))
        count = self._pair_counts(before, numbers)
        d = self.pair_d
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = (d[0] * context[1] + d[1] * context[2] + d[2] * context[3]) / total
            high = np.maximum(count - _discount(count, d), 0) / total + rest * lower
        return stats["count"] > 0, base, np.log10(np.where(total > 0, high, lower))

    def _pair_counts(self, before: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        at = np.flatnonzero((numbers >= 0) & (before <= BEGIN))
        first = before[at]
        keys = pair_hash(first, numbers[at].astype(U))
        buckets = _first_bucket(first, keys, self.hot, self.bits)
        order = np.lexsort((keys, buckets))
        keys, buckets = keys[order], buckets[order]
        bounds = np.searchsorted(buckets, np.arange((1 << self.bits) + 1, dtype=U))
        found = np.zeros(len(keys), np.int64)
        for b in np.flatnonzero(np.diff(bounds)):
            held = _array(self.folder, f"pairs-{b}", "<u8")
            if len(held):
                part = keys[bounds[b] : bounds[b + 1]]
                place = np.minimum(np.searchsorted(held, part), len(held) - 1)
                count = _array(self.folder, f"counts-{b}", "u1")[place].astype(np.int64)
                for i in np.flatnonzero((count == 255) & (held[place] == part)):
                    more, many = _array(self.folder, f"more-{b}", "<u8"), _array(self.folder, f"many-{b}", "<u8")
                    count[i] = many[np.searchsorted(more, part[i])]
                found[bounds[b] : bounds[b + 1]] = np.where(held[place] == part, count, 0)
        out[at[order]] = found
        return out


def _seen(counts: np.ndarray) -> list[int]:
    """How many are seen once, twice, three and four times, at all, and three times or more."""
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int((counts > 0).sum()), int((counts >= 3).sum())]


def train(texts: DataFrame) -> Model:
    """The model of the column ``text``; nulls are empty texts."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    store, path = _store(folder)
    store.create_dir(path)
    texts = texts.select("text")
    bits = max(4, (4 * texts.rdd.getNumPartitions() - 1).bit_length())

    def words_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent((tokens for batch in batches for _, tokens, _ in _tokens(batch)), lambda keys: keys >> U(64 - bits))

    def words_merged(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = merged(*_joined(table, 0))
        _write(folder, f"words-{bucket}", keys)
        _write(folder, f"wordcounts-{bucket}", counts.astype("<u8"))
        return pa.table({"bucket": [bucket], "size": [len(keys)], "total": [int(counts.sum())]})

    made = texts.mapInArrow(words_sent, BLOCK).groupBy("bucket").applyInArrow(words_merged, "bucket long, size long, total long").collect()
    size = {r["bucket"]: r["size"] for r in made}
    sizes = tuple(size.get(b, 0) for b in range(1 << bits))
    tokens = sum(r["total"] for r in made)
    share = max(1, tokens >> bits)

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for batch in batches:
            for b in batch.column(0).to_pylist():
                at = np.flatnonzero(_array(folder, f"wordcounts-{b}", "<u8") > share) + starts[b]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["number"])

    # fewer than 1 << bits words can have more than a bucket's share
    hot = np.array([r["number"] for r in spark.range(len(sizes)).mapInArrow(hot_words, "number long").collect()] + [int(BEGIN)], U)

    def pairs_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(folder, bits, sizes)

        def parts():
            for batch in batches:
                for _, tokens, bounds in _tokens(batch):
                    numbers = words.numbers(tokens).astype(U)
                    yield pair_hash(_neighbours(tokens, bounds, numbers), numbers)

        yield from _sent(parts(), lambda keys: _first_bucket(unmix(keys) >> U(32), keys, hot, bits))

    def pairs_merged(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = merged(*_joined(table, 0))
        _write(folder, f"pairs-{bucket}", keys)
        _write(folder, f"counts-{bucket}", np.minimum(counts, 255).astype("u1"))
        many = counts >= 255
        _write(folder, f"more-{bucket}", keys[many])
        _write(folder, f"many-{bucket}", counts[many].astype("<u8"))
        pair = unmix(keys)
        first, second = pair >> U(32), pair & BEGIN
        starts = np.concatenate(([0], np.cumsum(sizes))).astype(U)
        home = lambda numbers: np.searchsorted(starts, numbers, "right").astype(np.int64) - 1
        out = []
        ones = np.ones(len(keys), np.uint64)
        for kind, number, value in ((1, second, ones), (2, first, counts), (3, first, (counts == 1) * ones), (4, first, (counts == 2) * ones), (5, first, (counts >= 3) * ones)):
            number, value = merged(number, value.astype(np.uint64))
            number, value = number[value > 0], value[value > 0]
            big = value >> U(32)
            if big.any():
                raise OverflowError("a pair's sum does not fit 32 bits; use more buckets")
            own = np.where(number == BEGIN, -1, home(number))
            out.append(_blocks(number.astype(np.uint32), value, own, kind))
        out.append(pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([9], pa.int32()), pa.array([np.array(_seen(counts), U).tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["bucket", "kind", "keys", "counts"]))
        return pa.Table.from_batches(out)

    def words_finished(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # the begin of texts, and sums over all pairs
            begin = [int(_joined(table, k, np.uint32)[1].sum()) for k in (2, 3, 4, 5)]
            sums = [np.frombuffer(k, U) for k, x in zip(table.column("keys").to_pylist(), table.column("kind").to_pylist()) if x == 9]
            return pa.table({"bucket": [-1], "sums": pa.array([begin + np.sum(sums, 0).astype(np.int64).tolist()], pa.list_(pa.int64()))})
        start = sum(sizes[:bucket])
        stats = np.zeros(sizes[bucket], WORD)
        stats["count"] = _array(folder, f"wordcounts-{bucket}", "<u8")
        for kind, name in ((1, "before"), (2, "total"), (3, "n1"), (4, "n2"), (5, "n3")):
            number, value = _joined(table, kind, np.uint32)
            np.add.at(stats[name], number.astype(np.int64) - start, value.astype(stats[name].dtype))
        _write(folder, f"stats-{bucket}", stats)
        return pa.table({"bucket": [bucket], "sums": pa.array([_seen(stats["before"])], pa.list_(pa.int64()))})

    pairs = texts.mapInArrow(pairs_sent, BLOCK).groupBy("bucket").applyInArrow(pairs_merged, BLOCK)
    done = pairs.groupBy("bucket").applyInArrow(words_finished, "bucket long, sums array<long>").collect()
    words = np.sum([r["sums"] for r in done if r["bucket"] >= 0] or [[0] * 6], 0).tolist()
    rest = next((r["sums"] for r in done if r["bucket"] < 0), [0] * 10)
    return Model(folder, bits, sizes, tokens, np.array(rest[:4], float), rest[4:], words, hot)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Rows whose crc32 of the id as text leaves the remainder ``held_out`` are
    scored only, the others are also learned from; a null id counts as an empty
    text. A null text is empty: its one token is the end. Repeated rows count
    each. Without training rows every token is unknown. Other columns are
    ignored, whatever their names. Perplexity is 10 ** (-score / n_tokens).
    """
    rest = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (rest == held_out).alias("held_out"))
    model = train(base.filter(~F.col("held_out")))
    kind = base.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((4, n))
            for row, tokens, bounds in _tokens(batch):
                values = (np.ones(len(tokens)), *model.scores(tokens, bounds))
                for i, value in enumerate(values):
                    sums[i, row : row + len(bounds) - 1] = np.add.reduceat(value.astype(float), bounds[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(n, model.tokens, np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return base.mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
