"""Whitening against numpy's own eigenvectors, and its parts against brute force."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import queries, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute(vectors, scale=64, offset=1_000_000):
    """n, sums, eigenvalues and vectors (rows, falling) of the distinct integer vectors, in exact fractions up to the eigenproblem."""
    x = sorted({tuple(int(np.floor(scale * float(c))) + offset for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    v = np.array([[float(sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    return n, sums, values[::-1], vectors.T[::-1], v


def check(rows, found, most=16):
    usable = [(k, np.array(v, np.float32)) for k, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, values, vectors, v = brute([v for _, v in usable])
    k = min(most, int((values > 1e-9 * values.max()).sum())) if len(values) else 0
    assert len(found) == len(usable) * k
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, vector in usable:
        x = [int(np.floor(64 * float(c))) + 1_000_000 for c in vector]
        y = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums, strict=True)])
        for c in range(k):
            r = by_id[i][c + 1][0]
            want = float(y @ vectors[c] / np.sqrt(values[c]))
            signs.setdefault(c, np.sign(want * r.whitened)) if abs(want) > 1e-3 else None
            assert r.whitened == pytest.approx(want * signs.get(c, 1), rel=1e-8, abs=1e-8)
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert r.explained == pytest.approx(values[c] / np.trace(v), rel=1e-9) and 0 <= r.identity_error < 1e-9


def run(spark, tmp_path, rows, schema=EMBEDDINGS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op13_whitening(spark, str(tmp_path)).collect()


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(rows, queries.op13_whitening(spark, "/root/testdata/sf0.001").collect())


RNG = np.random.default_rng(2)
SMALL = [(k, [float(c) for c in RNG.normal(size=5) * [3, 1, 0.5, 0.2, 0.1]], 0) for k in range(60)]


def test_nulls_repeats_and_ids(spark, tmp_path):
    rows = SMALL + [(7, *SMALL[3][1:])] + [(100, None, 1), (101, [1.0, None, 1.0, 1.0, 1.0], 1), (102, [float("nan")] * 5, 1), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], None)] + [(200 + k, SMALL[0][1], 0) for k in range(300)]
    rows[60] = (160, *rows[60][1:])
    check(rows, run(spark, tmp_path, rows))


def test_rows_without_an_id_and_other_lengths(spark, tmp_path):
    rows = [*SMALL, (None, SMALL[1][1], 0), (900, [1.0, 2.0], 0), (901, [], 0)]
    found = run(spark, tmp_path, rows)
    check(SMALL, [r for r in found if r.vec_id is not None])
    assert sum(r.vec_id is None for r in found) == 5 and not {900, 901} & {r.vec_id for r in found}


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, [(1, [], 0)]])
def test_tables_without_components(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_directions_without_variance_are_no_components(spark, tmp_path):
    rows = [(k, [float(a), 2 * float(a), 5.0], 0) for k, a in enumerate(range(-20, 20))]
    found = run(spark, tmp_path, rows)
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1) and found[0].identity_error < 1e-9


def test_huge_entries_stay_exact_or_are_held(spark, tmp_path):
    rows = [(k, [float(k % 7) * 1e11, float(k)], 0) for k in range(20)] + [(99, [1e30, -1e30], 0)]
    found = run(spark, tmp_path, rows)
    assert len(found) == 42 and max(r.deviation for r in found) == 2**63 - 1 and found[0].identity_error < 1e-4


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(*r, 1, 2.0, 3) for r in SMALL]
    check(SMALL, run(spark, tmp_path, rows, f"{EMBEDDINGS}, x int, whitened double, id long"))


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


SPECTRA = {
    "spread": list(np.linspace(1, 50, 64)), "ties": [9.0] * 20 + [3.0] * 20 + [1.0] * 24, "near ties": [5 + 1e-9 * k for k in range(30)] + [1.0] * 10, "geometric": [2.0**-k for k in range(40)],
    "one": [4.0], "two": [4.0, 4.0], "rank 3": [7, 5, 2] + [0.0] * 37, "zero": [0.0] * 6, "few large": [1e6, 1e3] + [1.0 + 0.01 * k for k in range(50)],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_of_any_spectrum(spark, name):
    v = matrix(SPECTRA[name])
    v = (v + v.T) / 2
    want = np.linalg.eigvalsh(v)[::-1]
    want = want[want > 4 * len(v) * np.finfo(float).eps * np.abs(v).sum(1).max()][:16] if name != "zero" else want[:0]
    values, components = whitening.principal_components(spark, v, 16)
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12, atol=1e-13 * max(want, default=1))
    assert np.abs(components @ components.T - np.eye(len(values))).max(initial=0) < 1e-13
    assert np.abs(components @ v - values[:, None] * components).max(initial=0) < 1e-13 * len(v) * max(want, default=1)


def test_inertia_counts_every_eigenvalue():
    for seed in range(20):
        n = 1 + seed
        v = np.random.default_rng(seed).normal(size=(n, n))
        v = v + v.T if seed % 3 else np.diag(np.round(v.diagonal()))
        values = np.linalg.eigvalsh(v)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.Inertia(v).above(shift) == (values > shift).sum()


def test_a_missed_eigenvalue_is_told():
    with pytest.raises(whitening.NotConverged):
        whitening.feast(np.diag([1.0, 2.0, 3.0, 10.0]), 1.5, 3.5, 3)


CROWDED = {
    "a crowd above a slice": [*(10 - 1e-6 * np.arange(9)), *np.arange(9.0, 0.0, -1), *np.linspace(0.1, 0.9, 40)], "groups of ties": [5.0] * 3 + [4.0] * 10 + [3.0] * 7 + [2.0] * 6 + [1.0] * 5,
    "groups of near ties": [s + 1e-13 * k for s in (5, 4, 3, 2, 1) for k in range(9)],
}
LARGE = [(102_564, 4, 367), (615_384, 24, 38), (6_000_000, 240, 125)]


def large_table(n, families, seed):
    """A covariance as unit vectors of 64 entries have it: a bulk that n vectors narrow, and a direction for each family of like vectors."""
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal((64, 64))
    v = 64 * (np.eye(64) + (noise + noise.T) / np.sqrt(2 * n))
    for _ in range(families):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        v += 82 / families * np.outer(u, u)
    return (v + v.T) / 2


@pytest.mark.parametrize("v", [*(matrix(values) for values in CROWDED.values()), *(large_table(*x) for x in LARGE)], ids=[*CROWDED, *map(str, LARGE)])
def test_eigenvalues_that_crowd_about_a_slice(spark, v):
    v = (v + v.T) / 2
    want, norm = np.linalg.eigvalsh(v)[::-1][:16], np.abs(v).sum(1).max()
    values, components = whitening.principal_components(spark, v, 16)
    assert len(values) == 16 and np.abs(values - want).max() < 1e-14 * len(v) * norm
    assert np.abs(components @ components.T - np.eye(16)).max() < 1e-13
    assert np.abs(components @ v - values[:, None] * components).max() < 1e-13 * len(v) * norm


def test_a_table_with_a_crowd_of_eigenvalues(spark, tmp_path):
    sizes = [*range(1_000_000, 1_000_009), *range(900_000, 0, -100_000)]
    rows = [(2 * k + (sign > 0), [sign * a / 64 if i == k else 0.0 for i in range(len(sizes))], 0) for k, a in enumerate(sizes) for sign in (-1, 1)]
    check(rows, run(spark, tmp_path, rows))
