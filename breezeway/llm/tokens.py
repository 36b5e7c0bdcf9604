"""Token ids of whole texts inside Arrow tasks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Ends every document; a free text token, as the contract of the packing queries says.
END = 0
#: Tokens that a task packs at once; a block ends at the first document end after so many.
BLOCK_TOKENS = 1 << 20
#: White space in a row beyond so many characters is cut from its text: the splitting pattern
#: keeps one step back for each, and fails at a million.
LONGEST_BLANK = 100_000
#: What the splitting pattern takes for white space; ``re`` has four control characters more.
_WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANK = re.compile(f"{_WHITE}{{{LONGEST_BLANK},}}")


@lru_cache(maxsize=2)
def encoder(name: str):
    """The byte-level tokenizer ``name`` of the public files: its encoding and its token bytes by id.

    The ranks file holds the same vocabulary and merges as the tokenizer's JSON file, and
    encoding from ranks is about five times as fast; the tests compare both id by id.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, {i: t for t, i in ranks.items()}


def encode(encoding, text: str) -> list[int]:
    """Ids of a text, however long its runs of white space are.

    The pattern takes a run but for its last character as one piece, or the whole run at the
    end of the text. No other piece reaches into that piece, and none looks behind itself, so
    a long one is merged by itself and the stretches around it are encoded as texts.
    """
    if len(text) < LONGEST_BLANK:
        return encoding.encode_ordinary(text)
    ids, done = [], 0
    for run in _LONG_BLANK.finditer(text):
        begin, end = run.span()
        end -= end < len(text)
        ids += encoding.encode_ordinary(text[done:begin])
        ids += encoding._encode_single_piece(text[begin:end])
        done = end
    return ids + encoding.encode_ordinary(text[done:])


@lru_cache(maxsize=2)
def sentence_enders(name: str) -> np.ndarray:
    """For each id, whether a sentence or line may end after it."""
    by_id = encoder(name)[1]
    flags = np.zeros(max(by_id) + 1, dtype=bool)
    for i, token in by_id.items():
        flags[i] = token[-1:] in b".!?\n" and i != END
    return flags


@dataclass
class Block:
    """Consecutive documents of one task: keys, all ids in a row, and where documents start."""

    keys: pa.Array
    ids: np.ndarray
    starts: np.ndarray  # of each document, and the end of the last


def blocks(batches: Iterator[pa.RecordBatch], name: str, block_tokens: int = BLOCK_TOKENS) -> Iterator[Block]:
    """Documents of Arrow batches (key, text) in order; a null text counts as empty."""
    encoding, _ = encoder(name)
    keys, parts, total = [], [], 0

    def block() -> Block:
        lengths = [len(p) for p in parts]
        return Block(pa.concat_arrays(keys), np.concatenate(parts), np.cumsum([0, *lengths]))

    for batch in batches:
        done = 0
        for row, text in enumerate(batch.column(1)):
            ids = encode(encoding, text.as_py() or "")
            ids.append(END)
            parts.append(np.array(ids, dtype=np.uint32))
            total += len(ids)
            if total >= block_tokens:
                keys.append(batch.column(0).slice(done, row + 1 - done))
                yield block()
                keys, parts, total, done = [], [], 0, row + 1
        if done < batch.num_rows:
            keys.append(batch.column(0).slice(done))
    if parts:
        yield block()
