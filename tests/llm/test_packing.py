"""Packing: exact round trips, and dynamic programming against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
from edges import documents, empty
from tokenizers import Tokenizer

from breezeway.llm import binary_output, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def by_document(rows, key=lambda r: (r.doc_id, r.doc_tokens)):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def test_every_id_lies_in_one_piece(spark):
    docs = documents(spark).repartition(3)
    rows = packing.pack(docs, with_ids=True).collect()
    want = sorted(ids_of(r.text).tobytes() for r in docs.collect())
    got, at = [], {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        at.setdefault(r.sequence_id, []).append(r)
    # pieces of a document follow each other in the order of sequences
    current = b""
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.start * 4 == len(current)
        current += bytes(r.ids)
        if len(current) == 4 * r.doc_tokens:
            got.append(current)
            current = b""
    assert sorted(got) == want
    for pieces in at.values():
        pieces.sort(key=lambda r: r.offset)
        lengths = [r.length for r in pieces]
        assert [r.offset for r in pieces] == [0, *np.cumsum(lengths)[:-1].tolist()] and sum(lengths) <= 1024
    assert packing.pack(empty(spark)).collect() == []


def test_best_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(150):
        window = rng.choice([8, 16, 13])
        at = [0]
        while at[-1] < 60:
            at.append(at[-1] + rng.randrange(1, min(window, 6)))
        cost = [rng.choice([0, 2, 9]) for _ in at]
        cost[0] = cost[-1] = 0
        per = rng.choice([0, 3])

        def price(ends):
            total, begin = 0, 0
            for e in ends:
                n = e - begin
                total += (0 if n & (n - 1) == 0 else window - n) + per
                total += cost[at.index(begin)] if begin else 0
                begin = e
            return total

        least = [0] + [10**9] * (len(at) - 1)
        for i in range(1, len(at)):
            for j in range(i):
                n = at[i] - at[j]
                if n <= window:
                    c = least[j] + cost[j] + (0 if n & (n - 1) == 0 else window - n) + per
                    least[i] = min(least[i], c)
        ends = packing.best_cuts(at, cost, window, per)
        assert ends[-1] == at[-1] and price(ends) == least[-1]
        assert max(np.diff([0, *ends])) <= window


def test_binary_rows_give_back_every_document(spark):
    docs = documents(spark).repartition(2)
    rows = binary_output.pack_rows(docs, window=256).collect()
    pieces = []
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= 256
        for i, key in enumerate(r.doc_ids):
            a, b = r.cu_seqlens[i:i + 2]
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.append((key, r.starts[i], tuple(ids[a:b].tolist())))
        assert not ids[r.cu_seqlens[-1]:].any()
    want = []
    for d in docs.collect():
        ids = ids_of(d.text)
        want += [(d.doc_id, a, tuple(ids[a:a + 256].tolist())) for a in range(0, len(ids), 256)]
    assert sorted(pieces, key=str) == sorted(want, key=str)
    assert binary_output.pack_rows(empty(spark)).collect() == []


def test_best_fit_takes_the_tightest_row():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 33, 80)
        row, offset, n = binary_output.best_fit(lengths, 32)
        rooms = []  # by row
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(32 - lengths[i])
        assert n == len(rooms)
        used = sorted(zip(row, offset, lengths))
        for (r, o, k), (r2, o2, _) in zip(used, used[1:]):
            assert o + k <= 32 and (r != r2 or o + k == o2)


def test_special_strings_are_ordinary_text(spark):
    text = "a <|endoftext|> b<|endoftext|><|endoftext|> c"
    df = spark.createDataFrame([(1, text), (2, "<|endoftext|>")], "doc_id long, text string")
    for r in packing.pack(df, with_ids=True).collect():
        want = ids_of(text if r.doc_id == 1 else "<|endoftext|>")
        assert bytes(r.ids) == want.tobytes() and 50256 not in want
