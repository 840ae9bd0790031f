"""Benchmark items copied with evenly spread changes."""

import numpy as np

from obsframe.llm.decontamination import _best_stretch, find_overlaps


def test_spread_changes(spark):
    short, longer = [f"short{k}" for k in range(14)], [f"longer{k}" for k in range(18)]
    altered = lambda item, places: " ".join("other" if k in places else w for k, w in enumerate(item))
    texts = [(1, "before it " + altered(short, {4, 9}) + " behind"), (5, altered(short, {3, 8})), (2, altered(longer, {4, 9, 14})), (3, altered(short, {2, 4, 9})), (4, altered(longer, {4, 8, 9, 14}))]
    bench = spark.createDataFrame([(70, " ".join(short)), (71, " ".join(longer))], "item_id long, text string")
    got = {r.doc_id: [tuple(o) for o in r.overlaps] for r in find_overlaps(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    # in 5 the best stretch is short, but 12 of 14 words agree; in 2 it ends before the last change; 11 of 14 and 14 of 18 are less than 0.8
    assert got == {1: [(70, 2, 0, 14, 12)], 5: [(70, 0, 0, 14, 12)], 2: [(71, 0, 0, 14, 12)], 3: [], 4: []}


def test_equal_sums_take_most_matches():
    same = np.array([1] * 4 + [0] + [1] * 4 + [0] + [1] * 4, bool)
    s, e = _best_stretch(same)
    assert (s, e, same[s:e].sum()) == (0, 14, 12)
