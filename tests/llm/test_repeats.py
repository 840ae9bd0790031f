"""Substring dedup where ids repeat and where many documents share one passage."""

import random

import pytest
from test_joins import OTHER, PASSAGE, frame, repeats, some

from obsframe.llm import substring_dedup
from obsframe.llm.substring_dedup import remove_repeats


def rows(got):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str)


def test_rows_of_one_id_that_differ_in_white_space(spark):
    spaced = PASSAGE.replace(" ", "  ", 3)
    texts = [(1, PASSAGE), (2, PASSAGE), (2, spaced), (2, spaced.replace(" ", "\n", 1)), (2, spaced)]
    assert rows(remove_repeats(frame(spark, texts))) == repeats(texts)


@pytest.mark.parametrize("hot", [2, 200])
def test_a_passage_between_own_words(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_STRETCHES", hot)
    rng, whole, parts = random.Random(11), PASSAGE.split(), OTHER.split()
    texts = [(k, " ".join([some(30), *whole[rng.randrange(6) : 70 - rng.randrange(6)], *parts[: rng.choice([0, 20, 60])], some(30)])) for k in range(40)]
    texts += [(100 + k, " ".join(whole[:60]) + " " + some(20)) for k in range(5)] + [(100, texts[3][1]), (None, texts[2][1])]
    assert rows(remove_repeats(frame(spark, texts))) == repeats(texts)
