"""Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

The leaves of a tree are cut into aligned subtrees of 2^``HEIGHT`` leaves. Each
is one row: its nodes lie in one array, recursively split at half height, the
upper half first and then the lower subtrees from left to right. The roots of
these blocks are the leaves of the next level of blocks, until one is left, and
the roots of all trees are the leaves of one more tree. The place of a node in
its array follows from its depth and number alone, and serves both construction
and the retrieval of siblings. Spark carries blocks, never a whole tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.operators.ordering import row_numbers, running_totals
from panelscope.sources.durable import durable

HEIGHT = 10  # levels above the leaves of a block
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of nodes ``number`` at ``depth`` below the root of a subtree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return address(top, depth, number)
    below, low = depth - top, levels - top
    return (1 << top) - 1 + (number >> below) * ((1 << low) - 1) + address(low, below, number & ((1 << below) - 1))


@lru_cache(maxsize=64)
def layout(height: int) -> list[np.ndarray]:
    """Places of all nodes of a block by level above its leaves."""
    return [address(height + 1, height - level, np.arange(1 << (height - level))) for level in range(height + 1)]


def height_of(leaves: int) -> int:
    """Levels above this many leaves."""
    return max(0, leaves - 1).bit_length()


def combine(*digests: bytes) -> bytes:
    """The digest of digests, joined as hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


class Subtree:
    """A block: ``count`` leaves of an aligned subtree with ``height`` levels above them."""

    def __init__(self, count: int, height: int, nodes: bytes | None = None) -> None:
        self.counts = [-(-count // (1 << level)) for level in range(height + 1)]
        self.places, self.height = layout(height), height
        self.nodes = bytearray(DIGEST * ((2 << height) - 1)) if nodes is None else nodes

    def node(self, level: int, number: int) -> bytes:
        at = DIGEST * int(self.places[level][number])
        return bytes(self.nodes[at : at + DIGEST])

    def put(self, level: int, number: int, digest: bytes) -> None:
        at = DIGEST * int(self.places[level][number])
        self.nodes[at : at + DIGEST] = digest

    def build(self, leaves: Sequence[bytes]) -> Subtree:
        for number, digest in enumerate(leaves):
            self.put(0, number, digest)
        for level in range(1, self.height + 1):
            below = self.counts[level - 1]
            for number in range(self.counts[level]):
                pair = range(2 * number, min(2 * number + 2, below))
                self.put(level, number, combine(*[self.node(level - 1, i) for i in pair]))
        return self

    def siblings(self, number: int) -> list[bytes]:
        """From the leaf up to below the root; an empty one where a node is alone."""
        found = []
        for level in range(self.height):
            other = number ^ 1
            found.append(self.node(level, other) if other < self.counts[level] else b"")
            number >>= 1
        return found

    def fold(self, number: int, digest: bytes) -> bytes:
        """The root that this digest as leaf ``number`` gives with the stored siblings."""
        for level, other in enumerate(self.siblings(number)):
            digest = combine(other, digest) if (number >> level) & 1 else combine(digest, other)
        return digest


def path_fold(digest: bytes, number: int, siblings: Sequence[bytes]) -> bytes:
    """As ``fold``, with the siblings of levels one above the other."""
    for other in siblings:
        digest = combine(other, digest) if number & 1 else combine(digest, other)
        number >>= 1
    return digest


# A path is kept as a list of siblings, empty where a node is alone.
_BLOCK = "tree string, block long, count int, height int, nodes binary, root binary"


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("position")
    first = table.column("at")[0].as_py()
    # a first block with room left is the only one of its tree
    height = HEIGHT if first["block"] else min(HEIGHT, height_of(table.num_rows))
    tree = Subtree(table.num_rows, height).build(table.column("digest").to_pylist())
    row = {**first, "count": table.num_rows, "height": height, "nodes": bytes(tree.nodes), "root": tree.node(height, 0)}
    return pa.Table.from_pylist([{c: row[c] for c in _SCHEMA.names}], _SCHEMA)


_SCHEMA = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("count", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())])


def _spread(table: pa.Table) -> pa.Table:
    """The path of each leaf of a block, up to its tree's root."""
    out: dict[str, list] = {"tree": [], "position": [], "path": []}
    for row in table.to_pylist():
        own = Subtree(row["count"], row["height"], row["nodes"])
        for number in range(row["count"]):
            for column, value in zip(out.values(), (row["tree"], (row["block"] << HEIGHT) + number, own.siblings(number) + row["path"])):
                column.append(value)
    return pa.table(out, pa.schema([("tree", pa.string()), ("position", pa.int64()), ("path", pa.list_(pa.binary()))]))


def _at(position: str = "position") -> Column:
    """Tree and block as one value: rows dealt by ``tree`` alone would do for a grouping by both, and a large tree would be one task."""
    return F.struct("tree", F.shiftright(position, HEIGHT).alias("block")).alias("at")


def forest(leaves: DataFrame) -> list[DataFrame]:
    """Blocks by level, from the leaves up, of the trees in ``leaves`` (tree, position, digest).

    A level has ``last``, the number of the tree's last block; the next one holds the trees of more than one block.
    """
    levels: list[DataFrame] = []
    while True:
        blocks = durable(leaves.select("position", "digest", _at()).groupBy("at").applyInArrow(_build, _BLOCK))
        last = durable(blocks.groupBy("tree").agg(F.max("block").alias("last")))
        levels.append(blocks.join(last, "tree"))
        if last.filter("last > 0").isEmpty():
            return levels
        leaves = blocks.join(last.filter("last > 0"), "tree").select("tree", F.col("block").alias("position"), F.col("root").alias("digest"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, root."""
    found = [blocks.filter("last = 0").select("tree", "root") for blocks in levels]
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]


def with_paths(levels: list[DataFrame]) -> DataFrame:
    """The lowest blocks with ``path``, the siblings from the block's root up to the tree's."""

    def spread(batches):
        for batch in batches:
            yield from _spread(pa.Table.from_batches([batch])).to_batches()

    blocks = None
    for own in reversed(levels):
        if blocks is None:
            blocks = own.withColumn("path", F.array().cast("array<binary>"))
        else:
            paths = blocks.mapInArrow(spread, "tree string, position long, path array<binary>").withColumnRenamed("position", "block")
            blocks = own.join(paths, ["tree", "block"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<binary>")))
        if own is not levels[0]:
            blocks = durable(blocks)
    return blocks


def leaf_paths(levels: list[DataFrame]) -> DataFrame:
    """tree, position, path: the siblings of every leaf up to its tree's root. For trees of few leaves."""

    def spread(batches):
        for batch in batches:
            yield from _spread(pa.Table.from_batches([batch])).to_batches()

    return with_paths(levels).mapInArrow(spread, "tree string, position long, path array<binary>")


def _prove(rows: pa.Table, blocks: pa.Table, kind: pa.DataType) -> pa.Table:
    """Proofs of the rows of one block."""
    block = blocks.to_pylist()[0]
    own = Subtree(block["count"], block["height"], block["nodes"])
    out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
    for doc_id, position, leaf, other in zip(*[rows.column(c).to_pylist() for c in ("doc_id", "position", "leaf", "tampered")]):
        number = position - (block["block"] << HEIGHT)
        siblings = own.siblings(number)
        given = other if other is not None else leaf
        subroot = path_fold(path_fold(given, number, siblings), block["block"], block["path"])
        folded = path_fold(subroot, block["order"], block["upper"])
        proof = sha256(b"".join([*siblings, *block["path"], *block["upper"]]).hex().encode())
        values = (doc_id, leaf.hex(), block["subroot"].hex(), block["top"].hex(), proof.hexdigest(), folded.hex(), folded == block["top"])
        for column, value in zip(out.values(), values):
            column.append(value)
    kinds = {"doc_id": kind, "verified": pa.bool_()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})


def field_text(value: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, key: str = "doc_id", tree: str = "lang", fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    Leaves are digests of ``fields``; trees are the values of ``tree`` in UTF-8
    byte order, null first, and a tree's leaves ascend by ``key``, null first.
    ``folded_root`` is folded from the row as it would be with the columns
    ``tampered`` where ``where`` holds, with the stored siblings. Rows that
    share a key are ordered by digest, so repeated rows stand side by side, each
    with a leaf and a proof of its own. Nulls and empty texts differ; texts of
    any length are hashed whole. Other columns are ignored. An empty table gives
    an empty result.
    """
    changed = leaf_digest(*[(tampered or {}).get(c, F.col(c)) for c in fields])
    other = F.when(F.coalesce(where, F.lit(False)), changed) if where is not None else F.lit(None).cast("binary")
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # null becomes the first of all names
    row = F.struct(F.col(key).alias("doc_id"), leaf_digest(*[F.col(c) for c in fields]).alias("leaf"), other.alias("tampered"))
    counted = durable(docs.select(name.alias("tree"), row.alias("row")).groupBy("tree", "row").agg(F.count(F.lit(1)).alias("n")))
    placed = running_totals(counted, "row", {"upto": "n"}, ["tree"])
    position = F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("position")
    rows = durable(placed.select("tree", "row.*", position))
    levels = forest(rows.select("tree", "position", F.col("leaf").alias("digest")))
    subroots = durable(row_numbers(roots(levels), "tree", "order", start=0))
    above = forest(subroots.select(F.lit("").alias("tree"), F.col("order").alias("position"), F.col("root").alias("digest")))
    top = roots(above).first()  # one digest
    upper = leaf_paths(above).select(F.col("position").alias("order"), F.col("path").alias("upper"))
    known = subroots.withColumnRenamed("root", "subroot").join(upper, "order").withColumn("top", F.unhex(F.lit(bytes(top.root).hex() if top else None)))
    blocks = with_paths(levels).join(known, "tree")

    kind = rows.schema["doc_id"].dataType.simpleString()

    def proved(leaves: pa.Table, block: pa.Table) -> pa.Table:
        return _prove(leaves, block, leaves.schema.field("doc_id").type)

    dealt = rows.select("doc_id", "position", "leaf", "tampered", _at()).groupBy("at")
    known = blocks.select("*", F.struct("tree", "block").alias("at")).groupBy("at")
    return dealt.cogroup(known).applyInArrow(proved, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
