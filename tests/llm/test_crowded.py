"""Crowded shards and long runs of copies: the same results, however they are split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import language_id, quality, simhash
from obsframe.llm.components import components


def crowd(n, seed=5):
    """64-bit values that agree in four of six blocks of bits, in groups within a few bits of one another."""
    rng = random.Random(seed)
    values = set()
    while len(values) < n:
        v = rng.getrandbits(22)
        for _ in range(rng.randrange(1, 4)):
            values.add(v | 0x5A5A5A5A << 30)
            for _ in range(rng.randrange(1, 7)):
                v ^= 1 << rng.randrange(64)
    return sorted(values)


@pytest.mark.parametrize("shard", [3, 40, 10_000])
def test_crowded_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    values = crowd(600)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    linked = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 4)
    roots = {r.node: r.root for r in components(linked).collect()}
    group = list(range(len(values)))
    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    got = {}
    for v, g in zip(signed, group, strict=True):
        got.setdefault(g, set()).add(roots.get(v, v))
    assert all(len(r) == 1 for r in got.values()) and len({min(r) for r in got.values()}) == len(got)
    assert {(a, b) for a, b in map(tuple, linked.collect()) if ((a ^ b) & (2**64 - 1)).bit_count() > 4} == set()


@pytest.mark.parametrize("agreeing", [2, 3, 6])
def test_close_values_share_a_shard(spark, agreeing):
    rng = random.Random(agreeing)
    pairs = []
    for _ in range(300):
        v = rng.getrandbits(64)
        other = v
        for bit in rng.sample(range(64), 4):
            other ^= 1 << bit
        pairs.append([int(x) for x in np.array([v, other], np.uint64).view(np.int64)])
    keys = F.array(*simhash.shard_keys(4, agreeing))
    found = [spark.createDataFrame([(p[k],) for p in pairs], "fingerprint long").select(keys).collect() for k in (0, 1)]
    assert all(set(a[0]) & set(b[0]) for a, b in zip(*found, strict=True))


def test_one_labelled_id_with_many_rows_brings_few(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(2, "other words, quite unlike"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, None)], "doc_id long, quality int")
    seen = {}

    class Spy(quality.PairwiseModel):
        def __init__(self, good, bad):
            seen["rows"] = len(good), len(bad)
            super().__init__(good, bad)

    monkeypatch.setattr(quality, "PairwiseModel", Spy)
    quality.fit(docs, labels, F.lit(True))
    assert seen["rows"] == (quality.TEXTS_OF_ID, 2)


def test_newton_steps_reach_the_least_loss():
    """The fit against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.4, 1, (40, 3)), rng.normal(0, 1, (50, 3))
    model = quality.PairwiseModel(good, bad)
    draw = np.random.default_rng(7)
    d = model._standard(good)[draw.integers(0, 40, quality.PAIRS)] - model._standard(bad)[draw.integers(0, 50, quality.PAIRS)]
    w = np.zeros(3)
    for _ in range(4000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    assert np.allclose(model.weights, w, atol=1e-6)


def test_many_languages_send_no_more_than_the_share(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 3000)
    docs = spark.range(900).select("id", F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("lang"), F.repeat(F.lit("abc déf "), 40).alias("text"))
    docs = docs.withColumnRenamed("id", "doc_id")
    texts = {}

    class Spy(language_id.CrossParser):
        def __init__(self, samples):
            texts.update(samples)
            super().__init__(samples)

    monkeypatch.setattr(language_id, "CrossParser", Spy)
    language_id.fit(docs, F.lit(True))
    assert len(texts) == 300 and {len(t) for t in texts.values()} == {10}


def test_the_share_is_taken_in_the_order_of_the_sample(spark, monkeypatch):
    rows = [(k, "en" if k % 2 else "fr", f"text number {k} " * (k % 5 + 1)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    for chars in (200, 1000, 10**6):
        monkeypatch.setattr(language_id, "SAMPLE_CHARS", chars)
        got = {}
        monkeypatch.setattr(language_id, "CrossParser", lambda samples, got=got: got.update(samples))
        language_id.fit(docs, F.lit(True))
        for lang in ("en", "fr"):
            own = sorted((order[k], t) for k, other, t in rows if other == lang)[: language_id.SAMPLE_ROWS]
            assert got[lang] == "\n".join(t for _, t in own)[: chars // 2]
