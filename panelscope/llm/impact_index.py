"""Exact top-k inner products on an impact-ordered index, a score at a time.

Vectors are dealt into blocks. A block keeps, for every dimension, its postings
sorted by component, so that a query with a positive weight reads them from the
top and one with a negative weight from the bottom. Weight times distance from
the far end of the list is an impact >= 0, and a score is a constant of the
query plus the impacts of its postings. Segments are processed over all
dimensions by descending impact level. After each level a vector's score is at
most what it has gathered plus, for each posting not met, the level, or the
highest impact of a list that lies below the level as a whole; the vectors
ahead are rescored, which bounds the k-th best score from below. When the
vectors still possible cost less to rescore than the next level to read, or
nothing is left, all of them, ties included, are rescored exactly. Nothing
else ends a search.

Query chunks meet vector blocks by their numbers; both have fixed sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5
SCALE = 256
BLOCK = 16384  # vectors of a block
CHUNK = 4096  # queries that meet a block at once
LEVELS = 5
FALL = 0.4  # of the level from one to the next; the last is 0
LISTS = 8  # posting lists added up at once
AHEAD = 4  # times k vectors are rescored after a level
RESCORED = 1.0  # components rescored for a posting of the next level


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """floor(SCALE * x) as float64, missing components 0."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return np.floor(out * SCALE)


def _rows(table: pa.Table) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for part in table.column("vector").chunks for v in part.to_numpy(zero_copy_only=False)]


class Index:
    """Postings of a block by dimension, in order of the component."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.largest = np.abs(values).max(initial=0)
        order = np.argsort(values, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, 0).T)
        self.found, self.parts = np.empty(LISTS * len(ids), np.int64), np.empty(LISTS * len(ids))  # postings being added up

    def cuts(self, query: np.ndarray, used: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Postings of impact at least the level, by dimension and level; level 0 takes all."""
        n = len(self.ids)
        out = np.empty((len(used), len(levels)), np.int64)
        for i, d in enumerate(used):
            column, reach = self.sorted[d], levels / abs(query[d])
            if query[d] > 0:  # from the top
                out[i] = n - np.searchsorted(column, column[0] + reach, "left")
            else:
                out[i] = np.searchsorted(column, column[-1] - reach, "right")
        return out

    def possible(self, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """A mask that holds every vector of the block's top k and its ties."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        far = np.where(query > 0, self.sorted[:, 0], self.sorted[:, -1]) * query  # what a vector scores at least, by dimension
        most = np.abs(query) * (self.sorted[:, -1] - self.sorted[:, 0])  # the highest impact, by dimension
        if n - own.sum() <= k or not most.any():
            return ~own
        levels = np.append(most.max() * FALL ** np.arange(1.0, LEVELS), 0.0)
        cuts = self.cuts(query, used, levels)
        unit = 2.0 ** len(used).bit_length()  # sums hold whole impacts times this, plus the postings met
        sums, floor, before = np.zeros(n), -1.0, np.zeros(len(used), np.int64)
        for step, level in enumerate(levels):
            stops = np.maximum(cuts[:, step], before)
            for at in range(0, len(used), LISTS):
                end = 0
                for i in range(at, min(at + LISTS, len(used))):
                    d, start, stop = used[i], before[i], stops[i]
                    if stop > start:
                        postings = slice(n - stop, n - start) if query[d] > 0 else slice(start, stop)
                        here = slice(end, end := end + stop - start)
                        self.found[here] = self.order[d, postings]
                        np.multiply(self.sorted[d, postings], query[d] * unit, out=self.parts[here])
                        self.parts[here] += 1 - far[d] * unit
                if end:
                    sums += np.bincount(self.found[:end], self.parts[:end], n)
            before = stops
            gathered = np.floor(sums / unit)
            met = sums - gathered * unit
            # the best so far are rescored: the k-th of their scores is a bound for the k-th best of all
            gathered[own] = -1.0
            ahead = np.argpartition(gathered, n - min(n, AHEAD * k))[n - min(n, AHEAD * k) :]
            ahead = ahead[~own[ahead]]
            if len(ahead) >= k:
                floor = max(floor, np.partition(self.values[ahead] @ query, len(ahead) - k)[len(ahead) - k] - far.sum())
            # a posting not met has an impact of at most the level and its list's highest; two units more guard the division in the cuts
            opened = stops > 0
            upper = gathered + (opened.sum() - met) * (level + 2.0) + most[used][~opened].sum()
            mask = (upper >= floor) & ~own
            if level and mask.sum() * len(used) <= RESCORED * (cuts[:, step + 1].sum() - stops.sum()):
                break
        return mask

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k, ties to the smaller id."""
        own = self.ids == query_id
        size = np.abs(query).sum() * self.largest
        if size < 2**50 / (len(query) + 1):
            at = np.flatnonzero(self.possible(query, own, k))
            scores = (self.values[at] @ query).astype(np.int64)
        else:  # beyond exact floats: whole numbers of any size
            at = np.flatnonzero(~own)
            whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
            scores = whole(self.values[at]) @ whole(query)
        best = np.lexsort((self.ids[at], np.array([-s for s in scores], scores.dtype)))[:k] if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k], int)
        return self.ids[at[best]], scores[best]


def _search(block: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if block.num_rows and queries.num_rows:
        vectors, wanted = _rows(block), _rows(queries)
        width = max(map(len, vectors + wanted))
        index = Index(np.array(block.column("vec_id").to_pylist(), np.int64), _matrix(vectors, max(1, width)))
        for query_id, query in zip(queries.column("vec_id").to_pylist(), _matrix(wanted, max(1, width))):
            ids, scores = index.top(query, query_id, k)
            out["query_id"] += [query_id] * len(ids)
            out["vec_id"] += ids.tolist()
            out["score"] += [int(s) for s in scores]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False)))


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    Components become floor(256 x). Rows without an id or with an unusable
    vector take no part; vectors of unequal length are compared as if filled
    with zeros. Rows that share the query's id are its own; repeated rows are
    candidates each. Other columns are ignored. ``is_query`` may use any column
    of ``vectors``.
    """
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    base = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = rows.filter(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    n, q = base.count(), asked.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-q // CHUNK))
    dealt = lambda count: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = base.withColumn("block", dealt(blocks)).withColumn("chunk", every(chunks))
    right = asked.distinct().withColumn("chunk", dealt(chunks)).withColumn("block", every(blocks))

    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        return _search(block, queries, k)

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
