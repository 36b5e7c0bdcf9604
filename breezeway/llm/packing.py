"""Order-preserving packing by dynamic programming.

Documents keep their order. A sequence is a stretch of the token stream of at most
``window`` tokens; it may start where a document or a sentence ends, or at a spare place
inside a very long sentence. With f(e) the least cost of the stream up to e,

    f(e) = min over starts s of f(s) + cut(s) + padding(e - s) + sequence_cost

where padding is window - (e - s), or 0 at a power of two. The first kind of padding makes
this the minimum of f(s) + cut(s) + s over a sliding stretch of starts, which a monotone
queue keeps; the powers of two add one look each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeway.llm.tokens import Block, blocks, sentence_enders
from breezeway.session import bound_batches

WINDOW = 1024
#: Spare cuts inside a sentence stand this far apart.
SPARE = 128


def candidates(ids: np.ndarray, starts: np.ndarray, enders: np.ndarray, sentence_cut: int, spare_cut: int):
    """Positions where a sequence may start or end, ascending, and the cost of a cut there."""
    after = np.flatnonzero(enders[np.minimum(ids, len(enders) - 1)]) + 1
    natural = np.union1d(starts, after)
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > SPARE)
    spare = [np.arange(natural[g] + SPARE, natural[g + 1], SPARE) for g in wide]
    at = np.union1d(natural, np.concatenate(spare)) if spare else natural
    cost = np.where(np.isin(at, natural), sentence_cut, spare_cut)
    cost[np.isin(at, starts)] = 0
    return at, cost


def best_cuts(at: list[int], cost: list[int], window: int, sequence_cost: int) -> list[int]:
    """Ends of the cheapest sequences over candidate positions ``at`` (from 0 to the end)."""
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    index = {p: i for i, p in enumerate(at)}
    least, back = [0] * len(at), [0] * len(at)
    queue, value, head = [0], [0], 0  # starts with rising value f(s) + cut(s) + s
    for i in range(1, len(at)):
        end = at[i]
        while at[queue[head]] < end - window:
            head += 1
        best, start = value[head] + window - end, queue[head]
        for power in powers:
            s = index.get(end - power)
            if s is not None:
                c = least[s] + cost[s]
                if c < best:
                    best, start = c, s
        best += sequence_cost
        least[i], back[i] = best, start
        v = best + cost[i] + end
        while len(queue) > head and value[-1] >= v:
            queue.pop()
            value.pop()
        queue.append(i)
        value.append(v)
    ends, i = [], len(at) - 1
    while i:
        ends.append(at[i])
        i = back[i]
    return ends[::-1]


def _pieces(block: Block, ends: np.ndarray, first: int, window: int, with_ids: bool) -> pa.RecordBatch:
    """Pieces of a block: stretches of one document in one sequence."""
    begins = np.concatenate([[0], ends[:-1]])
    at = np.union1d(block.starts[:-1], begins)
    length = np.diff(np.append(at, block.starts[-1]))
    doc = np.searchsorted(block.starts, at, side="right") - 1
    sequence = np.searchsorted(begins, at, side="right") - 1
    raw = memoryview(block.ids.astype("<u4").tobytes())
    bounds = [(4 * int(a), 4 * int(a + n)) for a, n in zip(at, length)]
    size = ends - begins
    columns = {
        "key": block.keys.take(pa.array(doc)),
        "start": at - block.starts[doc],
        "length": length,
        "ids_crc32": np.array([zlib.crc32(raw[a:b]) for a, b in bounds], dtype=np.int64),
        "doc_tokens": np.diff(block.starts)[doc],
        "sequence_id": first + sequence,
        "offset": at - begins[sequence],
        "padding": np.where((size & (size - 1)) == 0, 0, window - size)[sequence],
    }
    arrays = [v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for v in columns.values()]
    if with_ids:
        arrays.append(pa.array([bytes(raw[a:b]) for a, b in bounds], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, [*columns, *(["ids"] if with_ids else [])])


def pack(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k",
    window: int = WINDOW, sentence_cut: int = 16, spare_cut: int = 96, sequence_cost: int = 16,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens.

    One row per piece: the key, start (tokens of the document before it), length,
    ids_crc32 (of its ids as little-endian 32-bit numbers), doc_tokens, sequence_id,
    offset (in the sequence), padding (of the whole sequence), and with ``with_ids`` the
    ids as bytes. Every document is one piece at least: it ends with id 0, so a null or
    empty text is that id alone. Repeated rows are packed each. The order is that of the
    input partitions, and nothing is shuffled; a task keeps one block of about a million
    tokens, or one document if that is longer. An empty table gives no pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enders = sentence_enders(tokenizer)
        first = TaskContext.get().partitionId() << 36
        for block in blocks(batches, tokenizer):
            at, cost = candidates(block.ids, block.starts, enders, sentence_cut, spare_cut)
            ends = np.array(best_cuts(at.tolist(), cost.tolist(), window, sequence_cost))
            yield _pieces(block, ends, first, window, with_ids)
            first += len(ends)

    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("key", plain.schema["key"].dataType), *[T.StructField(n, T.LongType()) for n in numbers],
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)
