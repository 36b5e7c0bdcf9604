"""Best-fit-decreasing packing into binary id matrices.

Overlong documents are split into pieces of a full row and a rest. Pieces go, longest
first, to the row with the least room that still holds them. A segment tree over the room
values 0 … window says which rooms some row has; going down it finds the smallest room of
at least a given length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeway.llm.tokens import Block, blocks
from breezeway.session import bound_batches


class Rooms:
    """Rows by the room left in them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = [0] * (2 * self.leaves)  # rows below each node
        self.rows: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.some[node] += change
            node >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove a row of the least room of at least ``length``: (room, row)."""
        node = length + self.leaves
        while not self.some[node]:
            while node & 1:  # right children: nothing more to the right below the parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and offset of each piece, and the number of rows."""
    rooms, n_rows = Rooms(window), 0
    row, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = rooms.take(length)
        room, at = found if found else (window, n_rows)
        n_rows += not found
        row[i], offset[i] = at, window - room
        if room > length:
            rooms.add(room - length, at)
    return row, offset, n_rows


def _matrix(block: Block, window: int, first: int, pad: int, width: str) -> pa.RecordBatch:
    sizes = np.diff(block.starts)
    n_pieces = -(-sizes // window)
    doc = np.repeat(np.arange(len(sizes)), n_pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = nth * window
    length = np.minimum(sizes[doc] - start, window)
    row, offset, n_rows = best_fit(length, window)
    order = np.lexsort((offset, row))
    doc, start, length, row, offset = doc[order], start[order], length[order], row[order], offset[order]
    # where each token of the matrix comes from, and its position inside its piece
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    to = np.repeat(row * window + offset, length) + inside
    ids = np.full(n_rows * window, pad, dtype=width)
    ids[to] = block.ids[np.repeat(block.starts[doc] + start, length) + inside]
    resets = np.zeros(n_rows * window, dtype="<u2")
    resets[to] = inside
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    ends = np.split(offset + length, bounds[1:-1])
    ids_raw, resets_raw = ids.tobytes(), resets.tobytes()
    cut = lambda raw: pa.array(
        [raw[i:i + len(raw) // n_rows] for i in range(0, len(raw), len(raw) // n_rows)], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(first + np.arange(n_rows)), lists(block.keys.take(pa.array(doc))), lists(pa.array(start)),
        pa.array([np.concatenate([[0], e]).astype(np.int32) for e in ends], pa.list_(pa.int32())),
        cut(ids_raw), cut(resets_raw)],
        ["sequence_id", "keys", "starts", "cu_seqlens", "ids", "position_ids"])


def pack_rows(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k",
    window: int = 1024, pad: int = 0,
) -> DataFrame:
    """Pack every document into rows of ``window`` ids; one output row per matrix row.

    Columns: sequence_id, keys and starts (of its pieces, in order: the document and its
    tokens before the piece), cu_seqlens (cumulative piece lengths from 0), ids and
    position_ids (``window`` little-endian numbers: 16-bit where the vocabulary fits, else
    32-bit; positions 16-bit, from 0 at each piece). Past the last piece the ids are
    ``pad``, the positions 0. A null or empty text is its end id alone; repeated rows are
    packed each; an empty table gives no rows. Nothing is shuffled, and a task keeps one
    block of about a million tokens, or one document if that is longer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for block in blocks(batches, tokenizer):
            width = "<u2" if int(block.ids.max()) < 1 << 16 and tokenizer.endswith("50k") else "<u4"
            out = _matrix(block, window, first, pad, width)
            first += out.num_rows
            yield out

    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("keys", T.ArrayType(plain.schema["key"].dataType)),
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType())])
    return plain.mapInArrow(run, schema).withColumnRenamed("keys", f"{key}s")


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet below ``path``; Spark commits whole files only."""
    packed.write.mode("errorifexists").parquet(path)
