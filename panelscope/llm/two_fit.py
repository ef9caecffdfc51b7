"""Packing documents into few sequences: best-two-fit in randomised groups.

Documents are dealt into groups of about ``GROUP`` rows. Whole sequences are cut
off documents longer than a sequence; what is left, and every other document,
is packed within its group. A sequence is filled greedily with the longest
document that fits. If room is left, its shortest document is taken out again
and the two unpacked documents that fill the wider gap best take its place,
where they fill it better. The lengths still unpacked are the bits of one
number, so the longest that fits is found without a search.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.token_count import default_path
from panelscope.llm.token_ids import encoder

LENGTH = 2048
GROUP = 4096
END = 0


class Stock:
    """Unpacked items by size."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in reversed(range(len(sizes))):
            self.items[sizes[i]].append(i)  # the last of a list is the first item of that size
        self.bits = sum(1 << size for size, found in enumerate(self.items) if found)
        self.upto = [(2 << size) - 1 for size in range(capacity + 1)]

    def longest(self, room: int) -> int:
        """The largest size that fits into ``room``, or -1."""
        return (self.bits & self.upto[room]).bit_length() - 1 if room > 0 else -1

    def take(self, size: int) -> int:
        found = self.items[size].pop()
        if not self.items[size]:
            self.bits ^= 1 << size
        return found

    def put(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.bits |= 1 << size

    def pair(self, gap: int, least: int) -> tuple[int, int] | None:
        """Two unpacked sizes whose sum is as large as possible, at most ``gap`` and above ``least``; the larger first."""
        best, a = None, self.longest(gap - 1)
        while 2 * a > least:
            b = self.longest(min(a, gap - a))
            if b == a and len(self.items[a]) < 2:
                b = self.longest(a - 1)
            if b > 0 and a + b > least:
                best, least = (a, b), a + b
                if least == gap:
                    break
            a = self.longest(a - 1)
        return best


def best_two_fit(sizes: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(sequence, offset) of each size, 1 to ``capacity``; equal sizes are used in the order given."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    stock, sequence = Stock(sizes, capacity), 0
    while stock.bits:
        own: list[tuple[int, int]] = []  # (size, item), longest first
        room = capacity
        while (size := stock.longest(room)) > 0:
            own.append((size, stock.take(size)))
            room -= size
        if room and len(own) > 1:
            size, item = own[-1]
            if found := stock.pair(room + size, size):
                own.pop()
                own += [(s, stock.take(s)) for s in found]
                stock.put(size, item)
        offset = 0
        for size, item in own:
            placed[item] = (sequence, offset)
            offset += size
        sequence += 1
    return placed


def _pack(table: pa.Table, path: str, length: int, end: int) -> pa.Table:
    own = encoder(path)
    table = table.sort_by("at")  # the order in which rows arrive is not fixed
    group = table.column("group")[0].as_py()
    columns: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")}
    rests: list[int] = []  # rows of ``columns`` that share sequences
    made, row = 0, 0
    for doc_ids, texts in zip(table.column("doc_id").chunks, table.column("text").chunks):
        for doc_id, ids in zip(doc_ids.to_pylist(), own.texts(texts)):
            data = ids.tobytes() + end.to_bytes(4, "little")
            for piece, start in enumerate(range(0, len(ids) + 1, length)):
                size = min(length, len(ids) + 1 - start)
                for column, value in zip(columns.values(), (doc_id, piece, start, size, data[4 * start : 4 * (start + size)], made, 0)):
                    column.append(value)
                if size == length:
                    made += 1
                else:
                    rests.append(row)
                row += 1
    for at, (sequence, offset) in zip(rests, best_two_fit([columns["length"][at] for at in rests], length)):
        columns["sequence_id"][at], columns["offset"][at] = made + sequence, offset
    columns["sequence_id"] = [(group << 32) + s for s in columns["sequence_id"]]
    kinds = {"doc_id": table.schema.field("doc_id").type, "piece": pa.int32(), "ids": pa.binary()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()})


def pack_two_fit(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: one row per piece.

    ``ids`` holds the token ids of the piece as little-endian unsigned 32-bit
    numbers; the document's last piece ends with ``end``. A null or empty text
    is one piece that holds ``end`` alone. A document of more than ``length``
    ids is cut into whole sequences and a rest; others are never cut. Repeated
    rows and ids are documents of their own. Ties between equal lengths go by
    the position in the scan, which also deals documents into groups, so
    ``docs`` should be read from a table. Other columns are ignored. An empty
    table gives an empty result.
    """
    path = path or default_path()
    groups = max(1, -(-docs.count() // group))
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    dealt = base.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)))
    kind = base.schema["doc_id"].dataType.simpleString()

    def packed(table: pa.Table) -> pa.Table:
        return _pack(table, path, length, end)

    return dealt.groupBy("group").applyInArrow(packed, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
