"""Token ids of texts with very long runs of white space, against the JSON tokenizer."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from edges import SCHEMA
from tokenizers import Tokenizer

from breezeway.llm import binary_output, packing, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def ids_here(text):
    return tokens.encode(tokens.encoder("byte_bpe_50k")[0], text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", "\u3000", "\xa0 ", " \n\n", "\x85"])
@pytest.mark.parametrize("before,after", [
    ("", ""), ("a", ""), ("", "b"), ("It's", "'s so"), ("end. ", " 12"), ("\x1c", "\x1c"), ("a\u200b", "\u200b!")])
def test_long_runs_of_white_space(blank, before, after):
    text = before + blank * (tokens.LONGEST_BLANK // len(blank) + 2) + after
    assert len(text) > tokens.LONGEST_BLANK and ids_here(text * 2) == ids_of(text * 2)


def test_white_space_is_that_of_the_pattern():
    white = re.compile(tokens._WHITE)
    for i in [*range(0xD800), *range(0xE000, 0x11000)]:
        assert bool(white.match(chr(i))) == chr(i).isspace() or 0x1C <= i <= 0x1F


def test_packed_documents_with_millions_of_blanks(spark):
    texts = ["short", "a" + " " * 2_000_000 + "b", "\n" * 1_500_000, "x\n" + "\r\n" * 1_000_000 + " it's"]
    docs = spark.createDataFrame([(i, t, *[None] * 11) for i, t in enumerate(texts)], SCHEMA)
    want = {i: np.array([*ids_of(t), 0], dtype="<u4") for i, t in enumerate(texts)}
    found = dict.fromkeys(want, 0)
    for r in packing.pack(docs).collect():
        piece = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        found[r.doc_id] += r.length
    assert found == {i: len(w) for i, w in want.items()}
    found = dict.fromkeys(want, 0)
    for r in binary_output.pack_rows(docs).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for key, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (ids[a:b] == want[key][start:start + b - a]).all()
            found[key] += int(b - a)
    assert found == {i: len(w) for i, w in want.items()}
