"""Jaccard join of shingle sets with PartEnum signatures.

Sets of sizes [l, l / J] form a band; two sets that reach the similarity J lie
in one band or in neighbours, so each set is signed under its own band and the
next. Under a band whose largest size is R, such a pair differs in at most
k = floor(2 R (1 - J) / (1 + J)) features. The feature domain is cut into n1
partitions of n2 parts each, by value, and every choice of n2 - k2 parts of a
partition is signed: with floor(k / (k2 + 1)) < n1, some partition has at most
k2 differences, so some choice has none and the pair shares its signature.

* Small k: k2 = 1, n2 = 3 (two of three parts).
* Larger k: one partition of n2 = k + 1 + spare parts, signed one by one.

A choice without any feature would be shared by sets that have nothing in
common. A pair agrees on ``spare + 1`` choices at least, so a set with no more
than ``spare`` empty ones leaves them out; otherwise it is signed again with
the domain dealt anew, which its partners with as many empty choices do too.

Equal sets are one node (a 64-bit identity), so copies cost nothing. Buckets of
a signature are linked as stars; only where a bucket still holds several
components are the pairs between components looked at, and only those whose
sizes and outlines (parities of the features in 512 cells, in 2,048 more for
large sets; a lower bound of the difference) allow the similarity. That is
judged in arrays, where a pair takes nanoseconds, not as a row of a join; large
buckets are cut into cells. The similarity is always counted exactly on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.components import components
from panelscope.llm.words import hashed_rows, mix
from panelscope.sources.durable import durable

NUM, DEN = 85, 100  # similarity at least NUM / DEN
WIDTH = 4
DEALS = 5  # how often the domain is dealt anew; in the last deal empty choices are signed too
FEW = 16  # k below it: two of three parts
HUBS = 4
TURNS = 2  # each with other hubs
OUTLINE = 8  # words of 64 bits: 512 cells
WIDE = 32  # as many words more for sets of LARGE features and more, whose differences fill 512 cells
LARGE = 800
CELL = 4096  # members of a bucket that meet in one group; the pairs of a larger bucket are dealt over several
SMALL = 32  # cells up to this size are compared together, larger ones alone
U = np.uint64


def band_starts(num: int = NUM, den: int = DEN, most: int = 1 << 31) -> np.ndarray:
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * den // num + 1)
    return np.array(starts)


def differences(largest: int, num: int = NUM, den: int = DEN) -> int:
    """Most features in which two sets of at most ``largest`` features differ at the similarity."""
    return (den - num) * 2 * largest // (den + num)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of runs of ``width`` words; a shorter text is one run; sorted."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    total = np.full(n - size + 1, size, U)
    for i in range(size):
        total = mix(total * U(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i])
    return np.unique(total)


def identity(features: np.ndarray) -> int:
    """64 bits that stand for the set."""
    if not len(features):
        return 0
    with np.errstate(over="ignore"):
        total = mix(features ^ U(0x2545F4914F6CDD1D)).sum(dtype=U) + U(len(features))
    return int(mix(np.array([total], U)).view(np.int64)[0])


def _signed(features: np.ndarray, tag: int, k: int, deal: int, out: list[np.ndarray]) -> None:
    if k == 0:
        return  # only an equal set is similar, and equal sets are one node
    if k < FEW:
        n1, n2, spare = k // 2 + 1, 3, 0
    else:
        spare = 2 + k // 16
        n1, n2 = 1, k + 1 + spare
    seed = U((tag * DEALS + deal + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    order = features if deal == 0 else np.sort(mix(features + seed))
    # parts by value: the top 32 bits scaled, so that each part is a run of the sorted features
    part = ((order >> U(32)) * U(n1 * n2)) >> U(32)
    bounds = np.searchsorted(part, np.arange(n1 * n2 + 1, dtype=U))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(order + seed), dtype=U)))
    of_part = (sums[bounds[1:]] - sums[bounds[:-1]]).reshape(n1, n2)
    held = np.diff(bounds).reshape(n1, n2)
    if n1 > 1 or k < FEW:
        choices = [(0, 1), (0, 2), (1, 2)]
        value = np.stack([mix(of_part[:, a] + seed) + of_part[:, b] * U(3) + U(c) for c, (a, b) in enumerate(choices)], 1)
        empty = np.stack([held[:, a] + held[:, b] == 0 for a, b in choices], 1)
    else:
        value, empty = of_part, held == 0
    place = np.arange(value.size, dtype=U).reshape(value.shape)
    value = mix(value + place * U(0xD6E8FEB86659FD93) + seed)
    if deal < DEALS - 1:
        if empty.sum() > spare:
            _signed(features, tag, k, deal + 1, out)
        value = value[~empty]
    out.append(value.ravel())


def signatures(features: np.ndarray, starts: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The signatures of a sorted set under its band and the next one."""
    out: list[np.ndarray] = []
    if len(features):
        band = int(np.searchsorted(starts, len(features), "right"))
        for tag in (band, band + 1):
            _signed(features, tag, differences(int(starts[tag]) - 1, num, den), 0, out)
    return np.concatenate(out) if out else np.zeros(0, U)


def outline(features: np.ndarray, words: int = OUTLINE) -> np.ndarray:
    """Parities of the features in cells by their leading bits.

    A feature that two sets share changes a cell of both, so they differ in at
    least as many features as their outlines in bits, however large they are.
    """
    cells = 64 * words
    cell = (features >> U(64 - (cells.bit_length() - 1))).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=cells).astype(np.uint8) & 1).view(np.int64)


def _sets(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray]]:
    for row, found, bounds in hashed_rows(batch.column(text)):
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            yield row + i, shingles(found[a:b])


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(len(s), identity(s), outline(s), outline(s, WIDE) if len(s) >= LARGE else None) for _, s in _sets(batch, "text")]
        size, node, bits, wide = zip(*sets) if sets else ((), (), (), ())
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * OUTLINE), pa.array(np.concatenate(bits) if sets else np.zeros(0, np.int64)))
        columns = [batch.column("doc_id"), batch.column("mark"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), bits, pa.array(wide, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "node", "bits", "wide"])


def _rows(parts: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    lengths = [len(p) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths))], ["sig", "node"])


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    starts, seen = band_starts(), set()
    for batch in batches:
        parts, nodes, held = [], [], 0
        for _, features in _sets(batch, "text"):
            node = identity(features)
            if not len(features) or node in seen:  # copies within a task are signed once
                continue
            if len(seen) < 200_000:  # only spares work; further copies are merged later
                seen.add(node)
            parts.append(signatures(features, starts))
            nodes.append(node)
            held += len(parts[-1])
            if held > 200_000:
                yield _rows(parts, nodes)
                parts, nodes, held = [], [], 0
        if parts:
            yield _rows(parts, nodes)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, parts, held = [], [], 0
        wanted = batch.column("node").to_pylist()
        for row, features in _sets(batch, "text"):
            if identity(features) == wanted[row]:  # ids may repeat with other texts
                nodes.append(wanted[row])
                parts.append(features.view(np.int64))
                held += len(features)
            if nodes and (held > 500_000 or row == batch.num_rows - 1):
                bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts)))], ["node", "features"])
                nodes, parts, held = [], [], 0


def _similar(base: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the similarity; features are made only for sets in a pair, from one text each."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes, "node").select("node", "mark")
    sets = durable(base.join(wanted, "mark").mapInArrow(_feature_rows, "node long, features array<long>").groupBy("node").agg(F.any_value("features").alias("features")))
    left = sets.select(F.col("node").alias("u"), F.col("features").alias("fu"))
    right = sets.select(F.col("node").alias("v"), F.col("features").alias("fv"))
    both = pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("fu", "fv")))
    return both.filter(DEN * F.col("common") >= NUM * (F.size("fu") + F.size("fv") - F.col("common"))).select("u", "v")


def _possible(a: str, b: str) -> Column:
    """Sizes and outlines of two nodes (structs) allow the similarity."""
    x, y = F.col(a), F.col(b)
    apart = sum((F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in range(OUTLINE)), F.lit(0))
    sizes = (DEN * x["size"] >= NUM * y["size"]) & (DEN * y["size"] >= NUM * x["size"])
    return sizes & ((DEN + NUM) * apart <= (DEN - NUM) * (x["size"] + y["size"]))


class _Cells:
    """Members of buckets in arrays, sorted by cell and part."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.key = [batch.column(c).to_numpy() for c in ("sig", "low", "high")]
        self.part, self.node, self.root, self.size = (batch.column(c).to_numpy() for c in ("part", "node", "root", "size"))
        self.bits = batch.column("bits").flatten().to_numpy().view(U).reshape(-1, OUTLINE)
        wide = batch.column("wide")
        self.wide = wide.flatten().to_numpy().view(U).reshape(-1, WIDE)
        held = wide.is_valid().to_numpy(zero_copy_only=False)
        self.wide_at = np.where(held, np.cumsum(held) - 1, -1)

    def bounds(self) -> np.ndarray:
        """First rows of the cells, and the number of rows."""
        changes = [np.flatnonzero(k[1:] != k[:-1]) + 1 for k in self.key]
        return np.unique(np.concatenate([[0, len(self.part)], *changes]))

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows (i, j) in different components whose sizes and outlines allow the similarity."""
        low, high = self.key[1][i], self.key[2][i]
        keep = (self.root[i] != self.root[j]) & ((low == high) | (self.part[i] != self.part[j]))
        i, j = i[keep], j[keep]
        a, b = self.size[i], self.size[j]
        keep = (DEN * a >= NUM * b) & (DEN * b >= NUM * a)
        i, j, most = i[keep], j[keep], (DEN - NUM) * (a + b)[keep]
        keep = (DEN + NUM) * np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64) <= most
        i, j, most = i[keep], j[keep], most[keep]
        x, y = self.wide_at[i], self.wide_at[j]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        far = (DEN + NUM) * np.bitwise_count(self.wide[x[both]] ^ self.wide[y[both]]).sum(axis=1, dtype=np.int64) > most[both]
        keep = np.ones(len(i), bool)
        keep[both[far]] = False
        return i[keep], j[keep]

    def _within(self, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of one cell, some rows against all that follow at a time."""
        words = np.ascontiguousarray(self.bits[first:stop].T)
        most = 2 * (DEN - NUM) * int(self.size[first:stop].max()) // (DEN + NUM)
        for at in range(0, stop - first, 64):
            apart = np.zeros((min(64, stop - first - at), stop - first - at), np.uint16)
            for w in words:
                apart += np.bitwise_count(w[at : at + 64, None] ^ w[None, at:])
            i, j = np.nonzero(apart <= most)
            after = j > i
            yield self.possible(first + at + i[after], first + at + j[after])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs (i, j) of rows of one cell."""
        bounds = self.bounds()
        sizes = np.diff(bounds)
        for c in np.flatnonzero(sizes > SMALL):
            yield from self._within(int(bounds[c]), int(bounds[c + 1]))
        stop = np.repeat(np.where(sizes > SMALL, 0, bounds[1:]), sizes)
        row = np.arange(len(stop))
        for step in range(1, SMALL):
            row = row[row + step < stop[row]]
            if not len(row):
                break
            yield self.possible(row, row + step)


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = _Cells(batch)
        for i, j in cells.pairs():
            if len(i):
                u, v = cells.node[i], cells.node[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    rest = None  # rows of a cell that may go on in the next batch
    for batch in batches:
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows:
            last = int(_Cells(batch).bounds()[-2])
            yield from found(batch.slice(0, last)) if last else ()
            rest = batch.slice(last)
    if rest is not None:
        yield from found(rest)


def _between(members: DataFrame, cell: int = CELL) -> DataFrame:
    """u, v: pairs of members of a bucket that are in different components and may be similar, each once.

    ``members`` has sig, node, root, look and the number of members of the bucket. A bucket of more than ``cell``
    is cut into parts by node, and two parts, or one with itself, meet in a cell of their own.
    """
    parted = members.withColumn("parts", F.ceil(F.col("members") / cell).cast("int"))
    parted = parted.withColumn("part", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ("part", "node", "root", F.col("look.size").alias("size"), F.col("look.bits").alias("bits"), F.col("look.wide").alias("wide"))
    cells = parted.select("sig", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), *columns)
    cells = cells.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high", "part")
    return cells.mapInArrow(_possible_pairs, "u long, v long").distinct()


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """u, v: pairs of members of a bucket with its hubs that are in different components and may be similar.

    Several hubs for each bucket, so that one odd hub doesn't leave its bucket in pieces; the order of the nodes is the
    same in all buckets, so that buckets of one group have the same hubs. Pairs are judged where they arise.
    """
    bucket = W.partitionBy("sig").orderBy(F.xxhash64("node", F.lit(turn)), "node").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    members = members.withColumn("look", F.struct("look.size", "look.bits"))  # few pairs: the wide outlines stay on disk
    member = F.struct("node", "root", "look")
    hubs = F.array(F.last(member).over(bucket), *[F.nth_value(member, j).over(bucket) for j in range(1, HUBS)])
    pairs = members.withColumn("hubs", hubs).select("node", "root", F.col("look").alias("lu"), F.explode("hubs").alias("hub")).filter(F.col("root") != F.col("hub.root"))
    pairs = pairs.select(F.col("node").alias("u"), F.col("hub.node").alias("v"), "lu", F.col("hub.look").alias("lv")).filter(_possible("lu", "lv"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, mark: the mark stands for id and text, also where the id is null."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_mark(key, text).alias("mark"))


def row_mark(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("long"), F.col(text).isNull(), F.col(text))


def linked_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark, n_shingles, root, component_id: as ``jaccard_components``, with the row's mark and the component's node (null for empty sets)."""
    base = _marked(docs, key, text)
    ids = durable(base.mapInArrow(_identities, "doc_id long, mark long, n_shingles long, node long, bits array<long>, wide array<long>"))
    nodes = ids.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("mark").alias("mark"), F.max("n_shingles").alias("size"), F.any_value("bits").alias("bits"), F.any_value("wide").alias("wide"))
    nodes = durable(nodes.select("node", "first", "mark", F.struct("size", "bits", "wide").alias("look")))
    signed = base.select("text").mapInArrow(_signature_rows, "sig long, node long")
    bucket = W.partitionBy("sig").orderBy("node")
    members = signed.withColumn("hub", F.first("node").over(bucket)).filter("node != hub")
    members = members.select("sig", F.explode(F.array("node", "hub")).alias("node")).distinct()
    members = durable(members.join(nodes.select("node", "look"), "node"))

    every, links, tried = members.withColumn("root", F.col("node")), None, None
    for turn in range(TURNS):
        stars = _stars(every, turn)
        stars = durable(stars if tried is None else stars.join(tried, ["u", "v"], "left_anti"))
        tried = stars if tried is None else tried.union(stars)
        found = durable(_similar(base, nodes, stars))
        links = found if links is None else links.union(found)
        roots = durable(components(links))
        every = every.drop("root", "members").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = every.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("members")).filter("a != b").select("sig", "members")
        every = durable(every.join(mixed, "sig"))
    between = _between(every).join(tried, ["u", "v"], "left_anti")
    more = durable(_similar(base, nodes, durable(between)))
    if more.count():
        roots = durable(components(links.union(more)))
    first = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = first.join(smallest, "root").select("node", "root", "component_id")
    columns = ("doc_id", "mark", "n_shingles", "root", "component_id")
    linked = ids.filter("n_shingles > 0").join(by_node, "node").select(*columns)
    alone = ids.filter("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Null and empty texts have no shingles and are linked with nothing: their
    component is their own id. Repeated rows and equal texts are one set. Rows
    with a null id are linked like others, but a null is never the smallest id
    unless the component has no other. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    return linked_rows(docs, key, text).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component, and each empty text once per id.

    The row with the smallest id stays, a null id last; of several texts with
    that id, the one with the smallest mark; repeated rows stay once. Columns of
    any name are kept as they are. An empty table gives an empty result.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    group = F.struct("root", F.when(F.col("root").isNull(), F.col("mark")).alias("own"))
    kept = linked_rows(docs, key, text).groupBy(group.alias("group")).agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("rows"))
    kept = kept.select("place.mark", (F.col("rows") > 1).alias("several"))
    rows = docs.select(F.struct("*").alias("doc"), row_mark(key, text).alias("mark")).join(kept, "mark")
    once = rows.filter("not several").select("doc").union(rows.filter("several").dropDuplicates(["mark"]).select("doc"))
    return once.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
