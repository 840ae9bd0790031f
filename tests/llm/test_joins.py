"""Substring, near-duplicate and line dedup, decontamination, language model, vector search, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from compare import assert_same, database
from pyspark.sql import functions as F
from test_similar import brute_least

import corpus_pipeline
from obsframe.llm import language_model, queries
from obsframe.llm.common import Memo, cut, store
from obsframe.llm.components import components
from obsframe.llm.decontamination import find_overlaps
from obsframe.llm.line_dedup import drop_recurring_lines
from obsframe.llm.simhash import BKTree, near_duplicates, spanning_links
from obsframe.llm.substring_dedup import SuffixAutomaton, remove_repeats
from obsframe.llm.vector_search import exact_top_k

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
WORDS = [f"w{k}" for k in range(400)]
some = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
PASSAGE, OTHER = some(70), some(60)
TEXTS = [
    (1, some(30) + " " + PASSAGE + " " + some(20)), (2, PASSAGE), (3, PASSAGE + " " + some(10) + " " + PASSAGE), (4, OTHER + " " + PASSAGE[:200]),
    (5, OTHER), (5, OTHER), (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "One  TWO"), (11, some(49)), (12, some(6000)), (None, PASSAGE), (None, None),
    (13, " ".join(OTHER.split()[:55]) + "\n" + " ".join(PASSAGE.split()[3:60])), (5, PASSAGE),
]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts], DOCS)


@pytest.mark.parametrize("name", [n for n in queries.SQL])
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.SQL[name])


def repeats(texts, window=50):
    first, out = {}, []
    for k, t in texts:
        w = (t or "").split()
        for p in range(len(w) - window + 1):
            if k is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, k), k)
    for k, t in texts:
        w = (t or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if k is not None and first[tuple(w[p : p + window])] < k:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings(spark):
    got = remove_repeats(frame(spark, TEXTS).withColumn("n_words", F.lit("clash")))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == repeats(TEXTS)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got.collect())
    assert remove_repeats(frame(spark, [])).collect() == []


def test_automaton():
    a = SuffixAutomaton()
    texts = [[random.choice("abc") for _ in range(40)] for _ in range(4)]
    for t in texts:
        a.add(t)
    query = [random.choice("abcd") for _ in range(60)]
    held = {tuple(t[i:j]) for t in texts for i in range(40) for j in range(i, 41)}
    want = [max(n for n in range(e + 2) if tuple(query[e + 1 - n : e + 1]) in held) for e in range(60)]
    assert list(a.matching_statistics(query)) == want


def brute_groups(texts, words, radius):
    def print_of(t):
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints, group = [print_of(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((k for (k, _), x in zip(texts, group, strict=True) if x == g and k is not None), default=None) for g in group}
    return sorted(((k, f"{p:016x}", least[g]) for (k, _), p, g in zip(texts, prints, group, strict=True)), key=str)


def test_near_duplicates(spark):
    near = [(20 + k, PASSAGE + " " + OTHER + " " + " ".join(WORDS[k : k + 3])) for k in range(12)]
    texts = TEXTS + near
    got = near_duplicates(frame(spark, texts))
    assert sorted(((r.doc_id, f"{r.fingerprint & (2**64 - 1):016x}", r.component_id) for r in got.collect()), key=str) == brute_groups(texts, 4, 4)
    assert near_duplicates(frame(spark, [])).collect() == []


def test_simhash_query(spark):
    texts = database(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted((tuple(r) for r in queries.op6_simhash(spark, FOLDER).collect()), key=str) == brute_groups(texts, 4, 4)


def test_bk_tree_and_links():
    values = list({random.getrandbits(10) for _ in range(200)})
    tree = BKTree(2)
    for n, v in enumerate(values):
        assert sorted(tree.near_then_add(v)) == sorted(u for u in values[:n] if (u ^ v).bit_count() <= 2)
    assert len(list(spanning_links(values, 2))) < len(values)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 200), (300, 301), (301, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90, 200: 200, 299: 299, 300: 299, 301: 299}


def test_lines(spark):
    shared = "Page 12 of the report\nAll rights   reserved.\n\nown "
    texts = [(k, shared.replace("12", str(k)) + f"line {'x' * k}") for k in range(1, 5)] + [(5, None), (6, ""), (None, "All rights reserved."), (1, "All rights reserved.")]
    got = drop_recurring_lines(frame(spark, texts).withColumns({c: F.lit("clash") for c in ("n_dropped", "_id", "_text", "_gone", "_t")}), least_documents=3).collect()
    kept = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str)
    want = [(1, texts[0][1], 4, 0), (1, "All rights reserved.", 1, 0), (5, None, 0, 0), (6, "", 1, 0), (None, "", 1, 1)]
    want += [(k, f"\nown line {'x' * k}", 4, 2) for k in (2, 3, 4)]
    assert kept == sorted(want, key=str)
    assert drop_recurring_lines(frame(spark, [])).collect() == []


def test_overlaps(spark):
    item = [f"item{k}" for k in range(30)]
    swapped = [w if k % 7 else "other" for k, w in enumerate(item)]
    texts = [(1, some(40) + " " + " ".join(item) + "."), (2, some(9) + " " + " ".join(swapped[1:]).upper()), (3, some(200)), (4, None), (5, ""), (6, " ".join(item[:8])), (7, "a b c d e f g h"), (8, some(3000))]
    bench = spark.createDataFrame([(70, " ".join(item)), (71, None), (72, "a b c"), (73, "A b c d, e f g h"), (70, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.overlaps for r in find_overlaps(frame(spark, texts).withColumn("overlaps", F.lit(1)), bench).collect()}
    assert {k: sorted({o.item_id for o in v}) for k, v in got.items() if v} == {1: [70], 2: [70], 7: [73]}
    assert (got[1][0].doc_start, got[1][0].length, got[1][0].matches) == (40, 30, 30) and got[2][0].matches == 24
    assert all(not r.overlaps for r in find_overlaps(frame(spark, texts), bench.limit(0)).collect())
    assert find_overlaps(frame(spark, []), bench).collect() == []


def test_benchmark_passages_in_the_table(spark):
    whole = database(FOLDER).execute("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, FOLDER).collect()}
    assert set(whole) <= got and len(got) <= len(whole) + 2


def base_scores(texts, held):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for (k, t), h in zip(texts, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {k: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in texts}


@pytest.mark.parametrize("head", [language_model.HEAD_WORDS, 300])
def test_language_model(spark, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_WORDS", head)
    texts = database(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()
    want = base_scores(texts, [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in texts])
    got = queries.op8_language_model(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark):
    texts = [(1, "a b a"), (2, None), (3, ""), (4, "A c"), (None, "a"), (4, "A c")]
    got = language_model.score_texts(frame(spark, texts).withColumn("score", F.lit(0)), F.col("doc_id") == 1).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got) == sorted([("1", 4, 4), ("2", 1, 1), ("3", 1, 1), ("4", 3, 2), ("4", 3, 2), ("None", 2, 2)])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    untaught = language_model.score_texts(frame(spark, texts), F.lit(False)).collect()
    assert {(r.n_known, r.base_score) for r in untaught} == {(0, 0.0)}
    assert language_model.score_texts(frame(spark, []), F.lit(True)).collect() == []


def encoded(texts, words):
    _, sizes, entries = language_model.encode(texts, Memo(100, words.entries))
    return language_model.Encoded(entries & 0xFFFFFF, sizes)


def test_language_model_is_a_distribution():
    words = language_model.Vocabulary([(b"the", 19), (b"\n", 15), *((b"cat%d" % k, 12 - k % 9) for k in range(300))])
    for w, n in words.count.items():
        words.total[words.word_class(w)] += n
        words.types[words.word_class(w)] += 1
    weights = np.random.default_rng(0).normal(size=(language_model.ROWS, language_model.CLASSES)).astype(np.float32)
    texts = encoded(["the cat7 cat1 the", "", "dog"], words)
    assert [len(f) for f in texts.features] == [len(texts.classes)] * len(language_model.TABLES) == [8] * len(language_model.TABLES)
    size, single = 10 ** words.log_class_size(), len(words.single)
    by_class = [language_model.class_log_probabilities(weights, texts.features, np.full(8, k)) for k in range(language_model.CLASSES)]
    for p in np.exp(np.stack(by_class, 1)):
        seen = sum(p[k] if (k := words.word_class(w)) < single else p[k] * (n + 1) / size[k] for w, n in words.count.items())
        assert math.isclose(seen + (p[single:] / size[single:]).sum(), 1, abs_tol=1e-5)


def test_language_model_history_stays_in_its_text():
    words = language_model.Vocabulary([])
    both = encoded(["a b c d e", "f g h"], words)
    alone = encoded(["f g h"], words)
    assert all((x[-4:] == y).all() for x, y in zip(both.features, alone.features, strict=True))


@pytest.mark.parametrize("n", [1, 31, 32, 33, 500])
def test_sums_by_row(n):
    random = np.random.default_rng(n)
    rows, values = random.integers(0, 40, n).astype(np.int16), random.normal(size=(n, 8)).astype(np.float32)
    row, total = language_model.sums_by_row(rows, values)
    want = np.zeros((40, 8))
    np.add.at(want, rows, values)
    assert row.tolist() == sorted(set(rows.tolist())) and np.allclose(total, want[row], atol=1e-4)


def test_vector_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []), (100, [-1.0, 0.5]), (100, [-1.0, 0.5]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (9, [1e12, 1e12])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 100 == 0, k=3).collect())
    top = (1024 + 2048) * int(1024e12)
    # 9 scores highest with both; ties go to the smaller id
    assert got[:3] == [(0, 1, 9, top), (0, 2, 1, 1024**2 * 5), (0, 3, 2, 1024**2 * 5)]
    assert [g[:3] for g in got[3:]] == [(100, 1, 0), (100, 2, 1), (100, 3, 2)] and len(got) == 6
    assert exact_top_k(df.limit(0), F.lit(True)).collect() == []
    assert exact_top_k(df, F.lit(False)).collect() == []


def test_vector_search_reads_few_exact_vectors():
    from obsframe.llm import vector_search as v

    rng = np.random.default_rng(1)
    rows, asked = rng.integers(-900, 900, (5000, 16)), rng.integers(-900, 900, (7, 16))
    tiles = [(np.arange(at, at + 1000), np.arange(at, at + 1000), v.Cells.of(rows[at : at + 1000])) for at in range(0, 5000, 1000)]
    q, row, low, high = v.candidates(tiles, np.arange(-7, 0), asked.astype(float), 10)
    truth = rows @ asked.T
    assert ((low <= truth[row, q]) & (truth[row, q] <= high)).all()
    for k in range(7):
        assert set(np.argsort(-truth[:, k], kind="stable")[:10]) <= set(row[q == k].tolist())
    assert len(row) < 0.1 * 7 * 5000
    # with what one tile tells of the k-th best, the others send less, and still every one of the best
    q1, _, low1, _ = v.candidates(tiles[:1], np.arange(-7, 0), asked.astype(float), 10)
    floor = np.array([np.sort(low1[q1 == k])[-10] for k in range(7)])
    for tile in tiles[1:]:
        alone, least = (v.candidates([tile], np.arange(-7, 0), asked.astype(float), 10, f) for f in (None, floor))
        assert len(least[1]) < len(alone[1])
        for k in range(7):
            best = set(np.argsort(-truth[:, k], kind="stable")[:10]) & set(tile[0].tolist())
            assert best <= set(least[1][least[0] == k].tolist())


@pytest.mark.parametrize(("tile", "part", "block"), [(4096, 16, 4096), (7, 2, 3)])
def test_vector_search_in_parts_and_blocks(spark, monkeypatch, tile, part, block):
    from obsframe.llm import vector_search as v

    monkeypatch.setattr(v, "TILE", tile)
    monkeypatch.setattr(v, "PART", part)
    monkeypatch.setattr(v, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-9, 9, (150, 5))
    vectors[70:] *= 10**7  # beyond single precision
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=4, scale=1).collect()]
    truth = vectors @ vectors.T
    want = []
    for q in range(0, 150, 10):
        best = sorted((-s, k) for k, s in enumerate(truth[q].tolist()) if k != q)[:4]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert sorted(got) == want


def test_pipeline(spark, tmp_path):
    db, docs = database(FOLDER), spark.read.parquet(f"{FOLDER}/documents.parquet")
    start, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.schema == start.schema
            kept[name] = docs
        else:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    ids = {n: {r.doc_id for r in d.collect()} for n, d in kept.items()}
    assert ids["language_id"] == ids["line_dedup"] == {r.doc_id for r in start.collect()}
    lines = [(r.doc_id, r.text) for r in kept["line_dedup"].collect()]
    assert ids["near_dedup"] == {g for _, g in brute_least(lines)}
    leaks = {k for (k,) in db.execute("SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()}
    assert ids["decontamination"] == ids["near_dedup"] - leaks
    assert len(ids["near_dedup"]) > 0.8 * len(ids["line_dedup"])


def test_pipeline_edges(spark, tmp_path):
    bench = tmp_path / "in"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(bench / "benchmark.parquet"))
    for texts in ([], TEXTS):
        docs = frame(spark, texts).withColumns({c: F.lit("clash") for c in ("_id", "_overlaps", "_lang_pred", "component_id", "n_lines", "sequence_id")})
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(bench))
        docs.collect()
    run = frame(spark, TEXTS)
    run.write.parquet(str(bench / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(bench)).count() > 0


def test_pipeline_leaves_its_stages_results_only(spark, tmp_path):
    frame(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    files = []

    def stage(spark, docs, folder):
        kept = store(cut(docs), "kept")
        files.extend(kept.inputFiles())
        return kept

    got = corpus_pipeline.run(spark, str(tmp_path), [("one", stage), ("two", stage)])
    assert got.count() == len(TEXTS) and files and not any(Path(f.removeprefix("file://")).exists() for f in files)
    assert "pipeline-" not in spark.sparkContext.getCheckpointDir()
