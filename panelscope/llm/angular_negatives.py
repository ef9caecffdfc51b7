"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions. By the
triangle inequality of angles, the angle between an anchor and a row lies
between the largest difference and the smallest sum of their angles to a
direction. The cosines of both ends, multiplied by the norms and widened by more
than any rounding, bound the integer score. Rows are scored in whole numbers
only where these bounds can reach the best positives or overlap the window of
scores in which a negative is wanted.

The directions are the mean directions of the most frequent labels, and the
axes where labels are fewer. They decide how many rows are scored, never what is
returned. Chunks of anchors meet blocks of rows by their numbers; both have a
fixed size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.impact_index import usable
from panelscope.sources.durable import durable

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
PERCENT = 80  # a negative scores at least this share of its positive
DIRECTIONS = 16
BLOCK = 8192  # rows of a block
CHUNK = 1024  # anchors that meet a block at once
TOGETHER = 32  # anchors whose rows are scored by one product
SLACK = 1e-5  # two angles: the arc cosine of a value wrong by 1e-11 is wrong by less than 5e-6
MOST = (1 << 63) - 1  # scores beyond a long count as the nearest one
EXACT = 2.0**52  # products of norms up to which whole numbers in doubles are exact


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, missing components 0."""
    out = np.zeros((len(column), width))
    for row, v in zip(out, column.to_pylist()):
        row[: len(v)] = v
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((len(v) for c in columns for v in c.to_pylist()), default=0)


def angles(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each unit direction; rows of length 0 or beyond doubles count as upright to all."""
    size = np.sqrt((vectors**2).sum(1))
    fine = (size > 0) & np.isfinite(size)
    unit = vectors / np.where(fine, size, 1.0)[:, None] * fine[:, None]
    return np.arccos(np.clip(unit @ directions.T, -1.0, 1.0))


def bounds(norm: float, angle: np.ndarray, norms: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the integer scores of an anchor with rows, by their norms and stored angles."""
    least = np.abs(stored - angle).max(1, initial=0.0) - SLACK
    total = stored + angle
    most = np.minimum(total, 2 * math.pi - total).min(1, initial=math.pi) + SLACK
    size = norm * norms
    wide = 1.0 + 1e-9 * size
    upper = np.where(least <= 0, 1.0, np.cos(np.minimum(np.maximum(least, 0.0), math.pi))) * size + wide
    lower = np.where(most >= math.pi, -1.0, np.cos(np.minimum(most, math.pi))) * size - wide
    fine = np.isfinite(size)
    return np.clip(np.where(fine, lower, -np.inf), -MOST, MOST), np.clip(np.where(fine, upper, np.inf), -MOST, MOST)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _scores(rows: np.ndarray, anchors: np.ndarray, size: float) -> np.ndarray:
    """Integer inner products, one line per row; by whole numbers of any size where doubles are not exact."""
    if size < EXACT:
        return np.rint(rows @ anchors.T).astype(np.int64)
    out = np.zeros((len(rows), len(anchors)), np.int64)
    if len(rows):
        out[:] = np.clip(_whole(rows) @ _whole(anchors).T, -MOST, MOST)
    return out


class Block:
    """Rows of a block with their stored angles."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.ids = table.column("vec_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = _matrix(table.column("vector"), width)
        self.norms = table.column("norm").to_numpy()
        self.angles = np.array(table.column("angles").to_pylist(), np.float64).reshape(len(self.ids), -1)

    def order(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
        """Positions in ``at`` of the best k: higher scores first, then smaller ids."""
        return np.lexsort((self.ids[at], -scores))[:k].tolist()


def _meet(block: Block, anchors: pa.Table, width: int, possible, found) -> None:
    """Scores of the rows that ``possible(i, lower, upper)`` marks for anchor i go to ``found(i, rows, scores)``."""
    wanted = _matrix(anchors.column("vector"), width)
    norms = anchors.column("norm").to_numpy()
    own = np.array(anchors.column("angles").to_pylist(), np.float64).reshape(len(norms), -1)
    most = block.norms.max(initial=0.0)
    for at in range(0, len(norms), TOGETHER):
        some = range(at, min(at + TOGETHER, len(norms)))
        masks = [possible(i, *bounds(norms[i], own[i], block.norms, block.angles)) for i in some]
        rows = np.flatnonzero(np.any(masks, 0))
        scores = _scores(block.vectors[rows], wanted[at : at + TOGETHER], most * norms[at : at + TOGETHER].max())
        for i, mask, column in zip(some, masks, scores.T):
            held = mask[rows]
            found(i, rows[held], column[held])


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "score": []}
    if rows.num_rows and anchors.num_rows:
        width = _width(rows.column("vector"), anchors.column("vector"))
        block = Block(rows, width)
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()

        def possible(i, lower, upper):
            mask = (block.labels == labels[i]) & (block.ids != ids[i])
            if mask.sum() > k:  # the k-th highest lower bound is reached by k rows
                mask &= upper >= np.partition(lower[mask], -k)[-k]
            return mask

        def found(i, at, scores):
            for j in block.order(at, scores, k):
                for column, value in zip(out.values(), (int(ids[i]), int(block.ids[at[j]]), int(scores[j]))):
                    column.append(value)

        _meet(block, anchors, width, possible, found)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def _negatives(rows: pa.Table, anchors: pa.Table, k: int, percent: int) -> pa.Table:
    out: dict[str, list] = {"anchor_id": [], "place": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []}
    if rows.num_rows and anchors.num_rows:
        width = _width(rows.column("vector"), anchors.column("vector"))
        block = Block(rows, width)
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        # a window is empty where the positive's score is negative, as its share then lies above it
        windows = [[w for w in ws if w["score"] >= 0] for ws in anchors.column("positives").to_pylist()]

        def possible(i, lower, upper):
            mask = np.zeros(len(block.ids), bool)
            for w in windows[i]:
                mask |= (upper >= percent * w["score"] / 100 - 1) & (lower <= w["score"])
            return mask & (block.labels != labels[i])

        def found(i, at, scores):
            for w in windows[i]:
                top = w["score"]
                inside = np.flatnonzero((scores <= top) & (scores >= -(-percent * top // 100)))
                for j in block.order(at[inside], scores[inside], k):
                    for column, value in zip(out.values(), (int(ids[i]), w["place"], w["positive_id"], top, int(block.ids[at[inside[j]]]), int(scores[inside[j]]))):
                        column.append(value)

        _meet(block, anchors, width, possible, found)
    return pa.table({c: pa.array(v, pa.int32() if c == "place" else pa.int64()) for c, v in out.items()})


def reference_directions(rows: DataFrame, width: int, count: int = DIRECTIONS) -> np.ndarray:
    """Unit mean vectors of the most frequent labels, then axes; ``count`` of them at most reach the driver."""
    labels = [r.label for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(count).collect()]

    def partial(batches):
        sums = {label: np.zeros(width) for label in labels}
        for batch in batches:
            own, of = _matrix(batch.column("vector"), width), batch.column("label").to_numpy()
            for label, total in sums.items():
                total += own[of == label].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["label", "sums"])

    parts = rows.select("label", "vector").mapInArrow(partial, "label long, sums array<double>").select("label", F.posexplode("sums").alias("d", "x"))
    found = {(r.label, r.d): r.x for r in parts.groupBy("label", "d").agg(F.sum("x").alias("x")).collect()}
    means = np.array([[found.get((label, d), 0.0) for d in range(width)] for label in labels]).reshape(len(labels), width)
    size = np.sqrt((means**2).sum(1))
    means = means[(size > 0) & np.isfinite(size)] / size[(size > 0) & np.isfinite(size), None]
    return np.concatenate([means, np.eye(max(0, min(width, count - len(means))), width)])


def stored_rows(vectors: DataFrame, is_anchor: Column, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, vector, norm, angles, asked, block: every usable row, written with its angles and block."""
    asked = F.coalesce(is_anchor, F.lit(False)).alias("asked")
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(F.col(vector), lambda x: F.lit(float(SCALE)) * x.cast("double")).alias("vector"), asked)
    # beyond 2^53 a double is whole
    rows = rows.filter(F.forall("vector", lambda x: F.abs(x) < float("inf"))).withColumn("vector", F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    directions = reference_directions(rows, width)

    def measured(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = _matrix(table.column("vector"), directions.shape[1])
            with np.errstate(over="ignore"):
                norm, angle = np.sqrt((own**2).sum(1)), angles(own, directions)
            yield from table.append_column("norm", pa.array(norm)).append_column("angles", pa.array(list(angle), pa.list_(pa.float64()))).to_batches()

    schema = "vec_id long, label long, vector array<double>, asked boolean, norm double, angles array<double>"
    blocks = max(1, -(-n // BLOCK))
    return durable(rows.mapInArrow(measured, schema).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the ``positives`` rows of its label that score
    highest; for each, the ``negatives`` highest-scoring rows of other labels
    whose score is at least ``percent`` % of the positive's and at most equal.
    Components become floor(256 x), scores are integer inner products, ties go
    to the smaller id. Rows without an id or a label, or with a vector that is
    null or holds a null or non-finite component, take no part; vectors of
    unequal length are compared as if filled with zeros. Rows that share the
    anchor's id are its own and never its positives; repeated rows are
    candidates each. Of several rows with an anchor's id, the one with the
    smallest (label, vector) is the anchor. Scores beyond a long count as the
    nearest long. ``is_anchor`` may use any column of ``vectors``; other
    columns are ignored. An empty table gives an empty result.
    """
    rows = stored_rows(vectors, is_anchor, key, vector, label)
    base = rows.select("vec_id", "label", "vector", "norm", "angles", "block")
    one = rows.filter("asked").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "norm", "angles")).alias("row"))
    anchors = durable(one.select("vec_id", "row.*"))
    # a table's blocks and chunks follow from its row count, which is read from file footers
    blocks, chunks = max(1, -(-rows.count() // BLOCK)), max(1, -(-anchors.count() // CHUNK))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = base.withColumn("chunk", every(chunks)).groupBy("block", "chunk")
    dealt = lambda asked: asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))).withColumn("block", every(blocks)).groupBy("block", "chunk")

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        return _positives(block, asked, positives)

    def mined(block: pa.Table, asked: pa.Table) -> pa.Table:
        return _negatives(block, asked, negatives, percent)

    found = left.cogroup(dealt(anchors)).applyInArrow(best, "anchor_id long, positive_id long, score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    kept = found.withColumn("place", place).filter(F.col("place") <= positives)
    windows = durable(kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives")))
    asked = anchors.join(windows, anchors.vec_id == windows.anchor_id).drop("anchor_id")
    pairs = left.cogroup(dealt(asked)).applyInArrow(mined, "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
