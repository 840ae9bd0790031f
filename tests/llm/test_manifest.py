"""The Merkle manifest against plain Python: trees, proofs, tampering and layout."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def walk(levels, at, held):
    proof = []
    for level in levels[:-1]:
        other = at ^ 1
        if other < len(level):
            proof.append(level[other])
            held = H(level[other], held) if other < at else H(held, level[other])
        else:
            held = H(held)
        at //= 2
    return proof, held


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf_of(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: levels_of([d for _, d in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order]) if order else []
    out = []
    for n, g in enumerate(order):
        for at, (r, leaf) in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            held = leaf_of(*r[:3], None if r[3] is None else r[3] + 1, r[4]) if tampered else leaf
            proof, found = walk(trees[g], at, held)
            more, found = walk(top, n, found)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], H(*proof, *more), found, found == top[-1][0]))
    return out


def run(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op11_merkle(spark, str(tmp_path))


def same(found, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(rows), key=key)


ODD = [
    (7, "s", "en", 3, "abc"), (7, "s", "en", 3, "abc"), (7, "s", "en", 4, "abd"), (None, None, None, None, None), (None, "t", "en", 1, ""), (3, "s", None, 2, "é"),
    (-5, "s", "Zz", 9, "1:-"), (12, "", "", 0, ""), (13, "s", "zz", None, "long " * 50_000), (14, "s", "é", 1, "\x00"), (9223372036854775807, "s", "en", 9223372036854775807, "x"),
]


@pytest.mark.parametrize("height", [2, 10])
def test_against_plain_python(spark, tmp_path, monkeypatch, height):
    """Subtrees of any height give the same trees, so all numbers of rounds are met."""
    monkeypatch.setattr(merkle.grow, "__defaults__", (height,))
    monkeypatch.setattr(merkle.descend, "__defaults__", (height,))
    monkeypatch.setattr(merkle.build_manifest, "__defaults__", (*merkle.build_manifest.__defaults__[:-1], height))
    rows = ODD + [(k, "s", "en" if k % 3 else f"l{k % 5}", k, f"text {k}") for k in range(100, 171)]
    # n_chars + 1 has no long value there; such rows aren't tampered with in this test
    same(run(spark, tmp_path, rows), rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, tmp_path, n):
    rows = [(k, "s", "en", k, "t") for k in range(n)]
    same(run(spark, tmp_path, rows), rows)


def test_one_group_and_one_row_repeated(spark, tmp_path):
    rows = [(5, "s", "en", 1, "same")] * 1500 + [(k, "s", "en", 1, "t") for k in range(700)]
    same(run(spark, tmp_path, rows), rows)


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(k, "s", "en", k, "t") for k in range(5)]
    extra = "digest string, rank long, tree long, id long, size long, `group` string, _at long, block long"
    same(run(spark, tmp_path, [(*r, "x", 1, 2, 3, 4, "y", 5, 6) for r in rows], f"{DOCS}, {extra}"), rows)


@pytest.mark.parametrize("height", range(12))
def test_layout_places_each_node_once_and_splits_at_half(height):
    places = np.concatenate([merkle.address(height, d, np.arange(2**d)) for d in range(height + 1)])
    assert sorted(places) == list(range(2 ** (height + 1) - 1))
    upper = (height + 1) // 2
    if upper:  # the upper half comes first, then each lower part in one piece
        assert max(merkle.address(height, d, np.arange(2**d)).max() for d in range(upper)) == 2**upper - 2
        size = 2 ** (height + 1 - upper) - 1
        for k in range(2**upper):
            low = [merkle.address(height, upper + d, (k << d) + np.arange(2**d)) for d in range(height + 1 - upper)]
            assert sorted(np.concatenate(low)) == list(range(2**upper - 1 + k * size, 2**upper - 1 + (k + 1) * size))


def test_any_changed_digest_is_found(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    leaf = merkle.digest(F.col("doc_id"))
    wrong = F.when(F.col("doc_id") % 2 == 1, merkle.digest(F.col("doc_id") + 1))
    found = merkle.verify(merkle.build_manifest(df, leaf, wrong))
    assert {(r.doc_id % 2 == 0) == r.verified for r in found.collect()} == {True}
