"""Language ID: parses against a naive longest match, large alphabets, long labelled rows, ties."""

import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from obsframe.llm import language_id
from obsframe.llm.language_id import CrossParser, fit, identify_language


def naive(text: str, sample: str) -> int:
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1 + (text[at] not in sample), at + size
    return n


def test_phrases_are_those_of_a_naive_parse():
    rng = random.Random(4)
    samples = {"a": "".join(rng.choices("abcd ", k=3000)).replace("  ", " "), "b": "".join(rng.choices("cdefgh", k=900)) * 2}
    model = pickle.loads(pickle.dumps(CrossParser(samples)))
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (0, 1, 5, 255, 256, 257, 513, 4000)] + [samples["a"], samples["b"][100:1500] + "a", "zz" + samples["a"][7:900] * 3, "zzz", "a" * 700, "zazbz" * 300, "cdcd efef" * 900]
    texts += ["".join(rng.choices("abz", k=600)) for _ in range(150)]
    codes, sizes, _ = model.letters(texts)
    got = model.phrases(codes, sizes)
    spell = np.array(["?", " ", "?", *"abcdefgh"])  # codes in order; a letter of no sample is in no phrase
    ends = np.cumsum(sizes)
    plain = ["".join(spell[codes[e - n : e]]) for e, n in zip(ends, sizes, strict=True)]
    own = {k: "".join(spell[model.letters([s])[0]]) for k, s in samples.items()}
    assert got.tolist() == [[naive(t, own[k]) for k in "ab"] for t in plain]


def test_three_large_alphabets(spark):
    rng = random.Random(6)
    letters = {lang: [chr(0x4E00 + 1500 * k + n) for n in range(1400)] for k, lang in enumerate(("x", "y", "z"))}
    texts = [(k, lang, "".join(rng.choices(letters[lang], k=60))) for k, lang in enumerate(lang for lang in letters for _ in range(80))]
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    got = identify_language(df, fit(df, F.col("doc_id") % 2 == 0)).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_languages_of_long_rows_only_and_ties(spark, monkeypatch):
    texts = [(1, "a", "the cat sat on the mat " * 900), (2, "b", "der hund und die katze " * 900), (3, None, "x"), (4, "c", None), (5, "d", "")]
    df = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    model = fit(df, F.lit(True))
    assert model.languages == ["a", "b"]
    assert [p[0] for p in model.predict(["the cat", "und die katze", "ж"])] == ["a", "b", "a"]  # nothing known of the last: the first name
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 60)
    assert all(e[0].max() < 2 * 30 for e in fit(df, F.lit(True)).edges)
