"""Votes of a forest on rows with one feature replaced, in arrays.

A value matters to a tree only by the thresholds it lies between, so a row is
one small code per feature.  A code rules out leaves of a tree; the leaf that
a row reaches is the first one that no feature rules out.  With one feature
replaced, only that feature's leaves change, and the votes are summed in the
order of the trees, as the fitted model does: probabilities are equal to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Keys
from ..sources.durable import count_rows, durable, spread, with_rows

MOST_LEAVES = 64  # of a tree: one bit each
ROWS = 2048  # voted on at once: their leaves stay in the processor's cache
SHARES = 2  # tasks that share the features of a replicate


@dataclass
class Ballot:
    """A forest by feature: ``cuts`` of its numeric slot (None: one-hot), leaves left by (tree, code), trees that split on it."""

    slots: dict[str, tuple[int, int]]
    cuts: dict[str, np.ndarray | None]
    leaves: dict[str, np.ndarray]
    trees: dict[str, np.ndarray]
    votes: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): where the values of each feature lie among its thresholds; a one-hot value's place, 0 for none."""
        out = np.zeros((len(x), len(self.slots)), np.uint16)
        for at, (name, (first, stop)) in enumerate(self.slots.items()):
            if self.cuts[name] is not None:
                out[:, at] = np.searchsorted(self.cuts[name], x[:, first])
            elif stop > first:
                held = x[:, first:stop] > 0.5
                out[:, at] = np.where(held.any(axis=1), held.argmax(axis=1) + 1, 0)
        return out

    def probabilities(self, rows: np.ndarray, donors: np.ndarray, features: Sequence[int]) -> Iterator[np.ndarray]:
        """For each of the features (by number, rising), the second class's probability of ``rows`` (codes) with that feature's code from ``donors``."""
        names = list(self.slots)
        own = [np.take(self.leaves[n], rows[:, i], axis=1) for i, n in enumerate(names)]
        after = [np.full_like(own[0], ~np.uint64(0))]
        for left in own[:0:-1]:
            after.append(after[-1] & left)
        after.reverse()
        before, at = np.full_like(own[0], ~np.uint64(0)), 0
        base = self._votes(before if not own else after[0] & own[0], slice(None))
        for feature in features:
            while at < feature:
                before, at = before & own[at], at + 1
            trees = self.trees[names[feature]]
            cast = base
            if len(trees):
                left = before[trees] & after[feature][trees] & np.take(self.leaves[names[feature]][trees], donors[:, feature], axis=1)
                cast = base.copy()
                cast[trees] = self._votes(left, trees)
            total = cast.sum(axis=0)  # tree by tree
            whole = total.real + total.imag
            yield np.divide(total.imag, whole, out=total.imag.copy(), where=whole != 0)

    def _votes(self, left: np.ndarray, trees) -> np.ndarray:
        """Votes (first class, second class as imaginary part) of the first leaf left, by (tree, row)."""
        first = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        first += (np.arange(len(self.votes)) * MOST_LEAVES)[trees][:, None]
        return np.take(self.votes.ravel(), first)


def ballot(trees: Sequence[dict[str, np.ndarray]], slots: dict[str, tuple[int, int]], one_hot: Sequence[str]) -> Ballot | None:
    """The forest by feature, or None where a tree has more than ``MOST_LEAVES`` leaves or no votes of two classes."""
    if any(t["votes"] is None or (t["feature"] < 0).sum() > MOST_LEAVES for t in trees):
        return None
    cuts = {}
    for name, (first, _) in slots.items():
        found = [t["threshold"][t["feature"] == first] for t in trees]
        cuts[name] = None if name in one_hot else np.unique(np.concatenate(found))
    sizes = {n: (len(cuts[n]) if cuts[n] is not None else slots[n][1] - slots[n][0]) + 1 for n in slots}
    if any(s > 1 << 16 for s in sizes.values()):
        return None
    of_slot = {s: n for n, (first, stop) in slots.items() for s in range(first, stop)}
    leaves = {n: np.full((len(trees), s), ~np.uint64(0)) for n, s in sizes.items()}
    votes = np.zeros((len(trees), MOST_LEAVES), complex)
    for k, tree in enumerate(trees):
        numbered = 0

        def visit(node: int, k=k, tree=tree) -> int:
            """The leaves under a node as bits."""
            nonlocal numbered
            feature = int(tree["feature"][node])
            if feature < 0:
                votes[k, numbered] = complex(*tree["votes"][node])
                numbered += 1
                return 1 << (numbered - 1)
            left, right = visit(int(tree["left"][node])), visit(int(tree["right"][node]))
            name = of_slot[feature]
            if cuts[name] is None:
                goes_right = np.arange(sizes[name]) == feature - slots[name][0] + 1
            else:
                goes_right = np.arange(sizes[name]) > np.searchsorted(cuts[name], tree["threshold"][node])
            gone = np.where(goes_right, np.uint64(left), np.uint64(right))
            leaves[name][k] &= ~gone
            return left | right

        visit(0)
    used = {n: np.array([k for k, t in enumerate(trees) if ((t["feature"] >= a) & (t["feature"] < b)).any()], int) for n, (a, b) in slots.items()}
    return Ballot(slots, cuts, leaves, used, votes)


def auc(keys: np.ndarray) -> float | None:
    """Area under the ROC curve, ties half, from sorted keys: a score's bits and, last, whether the row is positive."""
    if not len(keys):
        return None
    score, positive = keys >> np.uint64(1), (keys & np.uint64(1)).astype(np.int64)
    last = np.append(np.flatnonzero(score[1:] != score[:-1]), len(keys) - 1)
    tp = positive.cumsum()[last]
    pos, n = np.diff(tp, prepend=0), np.diff(last, prepend=-1)
    total, rest = int(tp[-1]), len(keys) - int(tp[-1])
    twice = int(((n - pos) * (2 * (total - tp) + pos)).sum())
    return twice / 2 / (float(total) * rest) if total and rest else None


def _pairs(tails: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the rows whose donors they take: all of their key, which is not null. Rows are sorted by key."""
    n = len(tails)
    new = np.ones(n, bool)
    new[1:] = pc.not_equal(tails[1:], tails[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    keyed = pc.greater(pc.binary_length(tails), 0).to_numpy(zero_copy_only=False)
    size, first = np.repeat(size, size), np.repeat(first, size)
    size = np.where(keyed, size, 0)
    row = np.repeat(np.arange(n), size)
    return row, first[row] + np.arange(len(row)) - np.repeat(size.cumsum() - size, size)


def replaced_areas(
    forest: Ballot, coded: DataFrame, key: str, features: Sequence[str], n_repeats: int, seed: int
) -> DataFrame:
    """(feature, rep, roc_auc) with each feature's values from the donors of ``permuted_values``.

    ``coded`` has row numbers ``_i`` in order of key, key, ``_y`` (whether the row is positive) and ``_codes``, and few
    enough rows for a task to hold. They travel to every task; a task takes some features of one replicate.
    """
    numbered = durable(coded)
    rows, shares = count_rows(numbered), min(SHARES, len(features))
    tail = F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit("")).cast("binary")
    tasks = int(n_repeats) * shares
    travelling = spread(with_rows(numbered.select("_i", "_y", "_codes", tail.alias("_tail")), rows), tasks)
    names, asked = list(forest.slots), list(features)

    def areas(table: pa.Table) -> pa.Table:
        task = table.column("_task")[0].as_py()
        rep, share = task // shares + 1, task % shares
        table = table.sort_by("_i")
        tails = table.column("_tail").combine_chunks()
        tails = tails.combine_chunks() if isinstance(tails, pa.ChunkedArray) else tails
        codes = np.frombuffer(b"".join(table.column("_codes").to_pylist()), np.uint16).reshape(len(table), len(names))
        positive = table.column("_y").to_numpy().astype(np.uint64)
        row, key_row = _pairs(tails)
        [(_, order)] = Keys(tails.to_pylist()).orders(seed, [rep])
        del table, tails
        donor = np.empty(len(order), np.int64)
        donor[order] = np.arange(len(order))
        donor = donor[key_row]
        mine = asked[share::shares]
        at = [names.index(f) for f in mine]
        rising = np.argsort(at, kind="stable")
        found = np.empty((len(mine), len(row)), np.uint64)
        for lo in range(0, len(row), ROWS):
            part = row[lo : lo + ROWS]
            own, given = codes[part], codes[donor[lo : lo + ROWS]]
            for i, p in zip(rising, forest.probabilities(own, given, [at[i] for i in rising])):
                found[i, lo : lo + ROWS] = p.view(np.uint64) << np.uint64(1) | positive[part]
        found.sort(axis=1)
        done = mine if len(row) else []
        return pa.table({
            "feature": pa.array(done, pa.string()), "rep": pa.array([rep] * len(done), pa.int32()),
            "roc_auc": pa.array([auc(keys) for keys in found[: len(done)]], pa.float64()),
        })

    copies = travelling.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return copies.repartitionByRange(tasks, "_task").groupBy("_task").applyInArrow(areas, "feature string, rep int, roc_auc double")
