"""Packing documents into sequences: first-fit decreasing in randomised groups.

Documents are dealt into groups of about ``GROUP`` rows at random. A document's
ids are cut into whole sequences and a rest; the rests of a group, longest
first, go to the first sequence that has room. The room of the open sequences
is the leaves of a tournament tree whose inner nodes hold the larger room of
their two, so the first fit is found on one path from the root.
"""

from __future__ import annotations

import zlib
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.token_count import default_path
from panelscope.llm.token_ids import encoder

LENGTH = 4096
GROUP = 1024
END = 2


class Rooms:
    """Tournament tree over the room left in each open sequence."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity = capacity
        self.width = 1 << max(0, (most - 1).bit_length())
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of the first sequence with room for ``size``."""
        best, node = self.best, 1
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        offset = self.capacity - best[node]
        best[node] -= size
        slot = node - self.width
        node //= 2
        while node:
            best[node] = max(best[2 * node], best[2 * node + 1])
            node //= 2
        return slot, offset


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(sequence, offset) of each size; ties by position."""
    rooms = Rooms(capacity, max(1, len(sizes)))
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        placed[i] = rooms.place(sizes[i])
    return placed


def _pack(table: pa.Table, path: str, length: int) -> pa.Table:
    own = encoder(path)
    group = table.column("group")[0].as_py()
    columns: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    rests, made = [], 0

    def add(*piece) -> None:
        for column, value in zip(columns.values(), piece):
            column.append(value)

    for ids_column, text_column in zip(table.column("doc_id").chunks, table.column("text").chunks):
        for doc_id, ids in zip(ids_column.to_pylist(), own.texts(text_column)):
            total = len(ids) + 1
            data = ids.tobytes() + END.to_bytes(4, "little")
            for start in range(0, total, length):
                size = min(length, total - start)
                piece = (doc_id, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), total)
                if size == length:
                    add(*piece, made, 0)
                    made += 1
                else:
                    rests.append(piece)
    for piece, (slot, offset) in zip(rests, first_fit_decreasing([r[2] for r in rests], length)):
        add(*piece, made + slot, offset)
    columns["sequence_id"] = [(group << 32) + s for s in columns["sequence_id"]]
    return pa.table({c: pa.array(v, table.schema.field("doc_id").type if c == "doc_id" else pa.int64()) for c, v in columns.items()})


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is one piece that holds the end id alone. Repeated
    rows and ids are documents of their own, dealt to groups apart, since the
    deal goes by the position in the scan. Other columns are ignored. An empty
    table gives an empty result.
    """
    path = path or default_path()
    groups = max(1, -(-docs.count() // group))
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("group"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def packed(table: pa.Table) -> pa.Table:
        return _pack(table, path, length)

    return base.groupBy("group").applyInArrow(packed, schema)
