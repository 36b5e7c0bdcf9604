"""Words of many texts as numpy arrays, for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on whole.
CHUNK_BYTES = 1 << 20
#: Texts that are worked on at once, however short they are.
CHUNK_TEXTS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of terms: ASCII letters and digits, and all bytes of other code points.
TERM_BYTES = np.arange(256) >= 128
TERM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def power(kind: str, n: int) -> np.ndarray:
    """Powers 0 … n - 1 of the base or its inverse modulo 2**64."""
    if len(_powers[kind]) < n:
        factors = np.full(n + n // 4, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """UTF-8 bytes of consecutive texts, A-Z lower-cased unless ``raw``; text i is data[starts[i]:starts[i+1]]."""

    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


@dataclass
class Words:
    """Words of Texts in order: byte bounds and the text each is from."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the end of the last

    def __len__(self) -> int:
        return len(self.begin)


def chunks(column: pa.Array, size: int = CHUNK_BYTES, raw: bool = False) -> Iterator[tuple[int, Texts]]:
    """Consecutive stretches of a string column: number of the first row, texts. Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        end = min(end, begin + CHUNK_TEXTS)
        part = data[offsets[begin]:offsets[end]]
        yield begin, Texts(part if raw else _LOWER[part], offsets[begin:end + 1] - offsets[begin])
        begin = end


def split_words(texts: Texts, inside: np.ndarray = ~_BLANK) -> Words:
    """Runs of the bytes ``inside``: all but blanks, tabs, line ends, vertical tabs and form feeds."""
    solid = inside[texts.data]
    edge = np.zeros(len(solid) + 1, dtype=bool)
    edge[texts.starts] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    first = np.searchsorted(begin, texts.starts)
    return Words(begin, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def hash_words(texts: Texts, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch."""
    n = len(texts.data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((texts.data.astype(np.uint64) + np.uint64(1)) * power("up", n), out=total[1:])
    own = (total[words.end] - total[words.begin]) * power("down", n)[words.begin]
    return mix(own + (words.end - words.begin).astype(np.uint64))
