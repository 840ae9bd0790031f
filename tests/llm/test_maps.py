"""Token counts, packing, language ID and quality: the operators that look at one text at a time."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import database
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsframe.llm import language_id, quality, queries
from obsframe.llm.common import fold
from obsframe.llm.packing import Bins, Encoder, pack, tail_lengths
from obsframe.llm.token_counts import token_counts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_tokens string"
random.seed(3)
ODD = [
    None, "", " ", "   a", "a  b ", "\n\n a\n", "aaaaaaaaa", " " * 40 + "x" + " " * 9, "▁▁ab▁", "日本語 漢字 🙂🙂 ñ", "<s></s><unk> <0x0A>", "\x00a\tb\x1c c",
    "a <|endoftext|> b", "don't stop'S", "12 345,6 ...!!  \n\n x", "a  b\x85 c", "".join(random.choice("abcAB01 +/=\n▁") for _ in range(4000)), "word " * 9000, "xY" * 3000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "clash") for k, t in enumerate(ODD)] + [(0, None, None, None), (None, "a b", None, None), (1, "", "en", "x")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents():
    return dict(database(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall())


def test_counts_equal_the_library(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, FOLDER).collect()}
    texts = documents()
    assert {k: (got[k].n_bytes, got[k].n_tokens) for k in got} == {k: (len(t.encode()), len(sp.encode(t))) for k, t in texts.items()}
    rows = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(odd, PIECES).collect()]
    want = [(r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert token_counts(none, PIECES).collect() == []


def unpack(rows):
    """Ids of each document from its pieces, after the laws of packing are checked."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and r.padded_length == (at if at & (at - 1) == 0 else 1024)
    return docs, sequences


def test_packing_round_trip(spark, none):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string").repartition(3)
    got = pack(rows, BYTES).collect()
    docs, _ = unpack(got)
    assert set(docs) == set(range(len(ODD)))
    for k, t in enumerate(ODD):
        pieces = sorted(docs[k], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] and pieces[0].doc_tokens == len(ids)
    assert pack(none, BYTES).collect() == []


def test_packing_query_has_little_padding(spark):
    rows = queries.op2_packing(spark, FOLDER).collect()
    docs, sequences = unpack(rows)
    encode = Encoder(BYTES)
    for k, t in documents().items():
        ids = encode([t])[0] + b"\0\0\0\0"
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in docs[k])
        assert sum(r.length for r in docs[k]) == len(ids) // 4 == docs[k][0].doc_tokens
    padded = sum(s[0].padded_length for s in sequences.values())
    assert padded <= 1.01 * sum(r.length for r in rows)


def test_tails_and_bins():
    for n in range(1, 1024):
        assert sum(tail_lengths(n, 1024)) == n
    bins = Bins(1024)
    closed = [b for k in range(5) for b in bins.add(k, bytes(4 * 512))] + list(bins.close())
    assert [sum(len(p[2]) // 4 for p in b) for b in closed] == [1024, 1024, 512]


def test_language_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    langs = dict(database(folder).execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op3_language_id(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.98 * len(held) > 100


def test_language_of_odd_texts(spark, odd, none):
    model = language_id.CrossParser({"en": "the cat and the dog sat on the mat " * 5, "de": "der hund und die katze auf der matte " * 5})
    got = language_id.identify_language(odd, model, prefix="_").collect()
    assert len(got) == odd.count() and got[0].n_tokens == "clash"
    for r in got:
        assert (r._lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert [p[0] for p in model.predict(["the dog", "die Katze", "THE DOG " * 20_000])] == ["en", "de", "en"]
    assert language_id.identify_language(none, model).collect() == []
    untaught = language_id.fit(none, fold("doc_id", 3) != 1)
    assert {r.lang_pred for r in language_id.identify_language(odd, untaught).collect()} == {"und"}


def test_quality_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    label = dict(database(folder).execute("SELECT doc_id, quality FROM labels").fetchall())
    got = queries.op7_quality(spark, folder).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label]
    assert sum(held) >= 0.95 * len(held) > 50


def test_quality_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(ODD))] + [(None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels, fold("doc_id", 5) != 0)
    got = quality.score_quality(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(none, model).collect() == []
    untaught = quality.fit(none, labels, fold("doc_id", 5) != 0)
    assert {round(r.score, 9) for r in quality.score_quality(odd, untaught).collect()} == {0.3}


@pytest.mark.parametrize("rare", [3, 300])
def test_quality_learns_from_every_labelled_row(spark, monkeypatch, rare):
    """Weights and cut against a fit of all rows in one place; rows beyond any sample's bound count."""
    rng = random.Random(rare)
    texts = [" ".join("".join(rng.choices("abcde" if k >= rare else "cdefg1", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for k in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k >= rare)) for k in range(900)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "BLOCK_ROWS", 100)
    monkeypatch.setattr(quality, "BLOCK_LEAST", 10_000)  # all bad rows are in all blocks, so all pairs are compared
    model = quality.fit(docs, labels, F.lit(True))
    x = quality.features(texts).astype(np.float32).astype(float)
    assert np.allclose(model.mean, x.mean(0), atol=1e-9) and np.allclose(model.scale, x.std(0) + 1e-6, atol=1e-9)
    z = model._standard(x)
    d = (z[rare:, None] - z[None, :rare]).reshape(-1, z.shape[1])
    slope = d.T @ (1 / (1 + np.exp(d @ model.weights))) / len(d) - 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-9
    raw = z @ model.weights
    right = lambda cut: (raw[rare:] >= cut).mean() + (raw[:rare] < cut).mean()
    assert right(model.cut) == pytest.approx(max(map(right, raw)))
