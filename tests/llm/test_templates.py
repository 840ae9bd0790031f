"""The log-template tree: wildcards learned by place, and texts of very many lines."""

import time
from pathlib import Path

import pytest
from compare import assert_same, database
from test_joins import frame

from obsframe.llm import line_dedup, queries
from obsframe.llm.line_dedup import drop_recurring_lines


def test_words_that_vary_are_wildcards(spark):
    names = [f"{a}{b}" for a in ("ann", "bo", "cy") for b in ("x", "y", "z", "w")]
    texts = [(k, f"own words of {n}\nuser {n} logged in from host {n[::-1]}") for k, n in enumerate(names)]
    texts += [(50 + k, f"quite another line that only {n} {n} {n} {n} {n} {n} wrote here") for k, n in enumerate(names)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in drop_recurring_lines(frame(spark, texts)).collect()}
    assert got[0] == (texts[0][1], 0)
    assert all(got[k] == (f"own words of {n}", 1) for k, n in enumerate(names) if k)
    # of these too few words agree
    assert all(got[50 + k] == (texts[12 + k][1], 0) for k in range(12))


def test_the_query_at_another_size(spark):
    folder = "/root/testdata/sf0.01"
    assert_same(queries.op9_line_dedup(spark, folder), database(folder), queries.SQL["op9_line_dedup"])


def test_very_many_lines(spark):
    n = 100_000
    text = "\n".join("all rights are reserved by us" if k % 2 else f"line {'ab'[k // 2 % 2]} {'x' * (k % 7)}" for k in range(n))
    texts = [(k, text if k in (3, 4) else "all rights are reserved by us") for k in range(12)]
    began = time.perf_counter()
    got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, texts)).collect()}
    assert time.perf_counter() - began < 60
    assert (got[3].n_lines, got[3].n_dropped, got[0].n_dropped) == (n, n // 2, 0) and got[3].text.count("\n") == n // 2 - 1


@pytest.mark.parametrize("bounds", [{"BROADCAST_LEAVES": 0}, {"LEAF_LINES": 3}, {"BROADCAST_LEAVES": 0, "LEAF_LINES": 0}])
def test_more_leaves_or_larger_ones_than_one_task_takes(spark, monkeypatch, bounds):
    for name, bound in bounds.items():
        assert hasattr(line_dedup, name)
        monkeypatch.setattr(line_dedup, name, bound)
    folder = "/root/testdata/sf0.01"
    assert_same(queries.op9_line_dedup(spark, folder), database(folder), queries.SQL["op9_line_dedup"])


def test_lines_go_before_texts_are_joined(spark):
    """Neither the table of lines nor a finished step's shuffle files lie beside the shuffle of the texts."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before, held = shuffled(), set(shared.iterdir())
    texts = [(k, "\n".join(f"user u{'abcdefghijklmn'[k]} logged in from {w} at noon" for w in "pqrs")) for k in range(14)]
    df = drop_recurring_lines(frame(spark, texts))
    assert [p.name.partition("-")[0] for p in set(shared.iterdir()) - held] == ["gone"]
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert [r.n_dropped for r in df.orderBy("doc_id").collect()] == [0] + [4] * 13
