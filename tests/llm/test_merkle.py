"""The manifest against a tree built node by node."""

import hashlib
import zlib

import pytest
from edges import documents, empty
from pyspark.sql import functions as F

from breezeway.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """Root, and each node's siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            paths[leaf].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[leaf] = i // 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """(key, leaf, subroot, root, siblings) of rows (group, key, leaf)."""
    first = lambda v: (v is not None, v)
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (first(r[1]), r[2]))
        trees.append((mine, *tree([r[2] for r in mine])))
    root, above = tree([t[1] for t in trees])
    return [(r[1], r[2], sub, root, path + up) for (mine, sub, paths), up in zip(trees, above)
            for r, path in zip(mine, paths)]


def compared(spark, rows, levels):
    df = spark.createDataFrame(rows, "g string, k long, h string")
    got = [(r.k, r.h, r.subroot, r.root, [tuple(s) for s in r.siblings])
           for r in merkle.manifest(df, group="g", order="k", node="h", levels=levels).collect()]
    low = lambda rs: sorted(rs, key=repr)
    assert low(got) == low(brute(rows))


@pytest.mark.parametrize("levels", [1, 3])
def test_trees_of_many_sizes(spark, levels):
    """Single leaves, full runs, last runs of one, and groups above one block of every round."""
    sizes = {"a": 1, "b": 8, "c": 9, "é": 65, "z": 2, None: 73, "deep": 580, "": 3}
    rows = [(g, 7 * i % n, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    compared(spark, rows, levels)


def test_many_groups_ties_and_nulls(spark):
    """More groups than a run of roots, rows of one key, equal rows and null keys."""
    rows = [(f"g{i}", 1, sha(str(i % 3))) for i in range(20)] + [("g1", 1, sha("x"))] * 30
    rows += [("g2", None, sha(str(i))) for i in range(10)]
    compared(spark, rows, 1)


def test_fields_fold_and_tampering(spark):
    """Leaves are of the bytes of all fields; a changed text no longer leads to the root."""
    docs = documents(spark)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select("doc_id", "lang", merkle.leaf(*[F.col(c) for c in fields]).alias("leaf"), *fields[1:2], "text", "n_chars")
    out = merkle.manifest(rows, carry=["text", "source", "n_chars"]).select(
        "*", merkle.folded(F.col("leaf"), F.col("siblings")).alias("folded"),
        merkle.folded(F.sha2(F.coalesce("text", F.lit("")), 256), F.col("siblings")).alias("other"),
        merkle.proof(F.col("siblings")).alias("proof")).collect()
    assert len(out) == docs.count()

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    for r in out:
        assert r.leaf == sha("".join(part(r[c]) for c in fields))
        assert r.folded == r.root and r.other != r.root
        assert r.proof == sha("".join(left + right for left, right in r.siblings))


def test_query_on_awkward_rows(spark, tmp_path):
    """The registered query: tampering by crc32 of the key, nulls untouched."""
    from breezeway.llm.queries import op13_merkle_manifest

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.leaf): r for r in op13_merkle_manifest(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for (key, _), r in rows.items():
        text = texts[key] or ""
        changed = key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text)
        assert r.verified == (not changed) == (r.folded_root == r.root)


def test_empty_table(spark):
    rows = empty(spark).select("doc_id", "lang", F.sha2("text", 256).alias("leaf"))
    out = merkle.manifest(rows)
    assert out.count() == 0 and {"subroot", "root", "siblings"} <= set(out.columns)
