"""Near copies by verified similarity, against all pairs."""

import random
import time
from pathlib import Path

import pytest
from compare import database
from pyspark.sql import functions as F

import corpus_pipeline
from obsframe.llm.simhash import near_duplicates, shingles, similar_texts

FOLDER = "/root/testdata/sf0.001"


def brute_least(texts, words=5):
    sets, group = [set(shingles(t or "", words)) for _, t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((k for (k, _), x in zip(texts, group, strict=True) if x == g and k is not None), default=None) for g in group}
    return sorted(((k, least[g]) for (k, _), g in zip(texts, group, strict=True)), key=str)


def indexed_least(texts, words=5):
    """As brute_least, over the pairs that share one of the shingles of which similar sets must share one."""
    sets, held, parent = [set(shingles(t or "", words)) for _, t in texts], {}, list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i, x in enumerate(sets):
        for s in sorted(x)[: len(x) - -(-4 * len(x) // 5) + 1] or [None]:
            for j in held.setdefault(s, []):
                if root(i) != root(j) and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                    parent[root(i)] = root(j)
            held[s].append(i)
    least = {}
    for k, (n, _) in enumerate(texts):
        if n is not None:
            least[root(k)] = min(n, least.get(root(k), n))
    return sorted(((n, least.get(root(k))) for k, (n, _) in enumerate(texts)), key=str)


def families():
    """Chains of edits, edits of edits and texts that are nearly but not similar enough, some hundreds of one family."""
    rng = random.Random(23)
    words, out = [f"w{k}" for k in range(2000)], []
    for n in (30, 60, 120):
        family = [rng.choices(words, k=n)]
        for _ in range(150):
            other = list(rng.choice(family))
            for at in rng.sample(range(n), rng.choice([1, 1, 2, n // 25 + 1, n // 15 + 1])):
                other[at] = rng.choice(words)
            family.append(other)
        out += [" ".join(w) for w in family]
    return list(enumerate(out))


@pytest.mark.parametrize("whole", [False, True])
def test_families_of_edits(spark, whole):
    """Texts between two others, near to both by bits and similar to one or none, must not hide a link."""
    texts = families()
    bounds = {"keys": None, "sieve": None} if whole else {}
    got = sorted(((r.doc_id, r.component_id) for r in similar_texts(spark.createDataFrame(texts, "doc_id long, text string"), **bounds).collect()), key=str)
    assert got == indexed_least(texts) and len({g for _, g in got}) > 20


def test_given_documents(spark):
    texts = database("/root/testdata/sf0.01").execute("SELECT doc_id, text FROM documents").fetchall()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in similar_texts(df).collect()), key=str) == indexed_least(texts)


def copies():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    out = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (None, "one two")]
    for n in (6, 14, 40, 90):
        text = rng.choices(words, k=n)
        for k in range(12):
            other = list(text)
            for _ in range(k // 3):
                other[rng.randrange(n)] = rng.choice(words)
            out.append((n * 100 + k, " ".join(other)))
    return out


@pytest.mark.parametrize("given", [True, False])
def test_similar_texts(spark, given):
    texts = database(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall() if given else copies()
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("name", "_hash", "component_id")})
    got = sorted(((r.doc_id, r.component_id) for r in similar_texts(df).collect()), key=str)
    assert got == brute_least(texts)
    # 4 of 64 bits link other texts than a similarity of 0.8 does
    assert got != sorted(((r.doc_id, r.component_id) for r in near_duplicates(df, words=5, radius=4).collect()), key=str)


def test_similar_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, FOLDER)
    assert kept.schema == docs.schema
    least = brute_least([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, g in least})
    assert similar_texts(docs.limit(0)).collect() == []


def test_recall_at_the_least_similarity(spark):
    rng = random.Random(17)
    words, texts = [f"w{k}" for k in range(3000)], []
    for k in range(400):
        text = rng.choices(words, k=rng.choice([40, 90, 200]))
        other = list(text)
        for at in rng.sample(range(0, len(text), 5), max(1, len(text) // 45)):
            other[at] = "x"
        texts += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    sets = [set(shingles(t, 5)) for _, t in texts]
    alike = {k for k in range(400) if 5 * len(sets[2 * k] & sets[2 * k + 1]) >= 4 * len(sets[2 * k] | sets[2 * k + 1])}
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = {k for k in range(400) if got[2 * k] == got[2 * k + 1]}
    assert len(alike) > 100 and found <= alike and len(found) >= 0.99 * len(alike)


def test_finished_steps_leave_neither_tables_nor_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f: f.stat().st_size for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(300)]
    df = spark.createDataFrame([(2 * k + n, t + " end" * n) for k, t in enumerate(texts) for n in (0, 1)], "doc_id long, text string").repartition(4, "doc_id").checkpoint()
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before, held = shuffled(), set(shared.iterdir())
    found = similar_texts(df)
    assert {p.name.partition("-")[0] for p in set(shared.iterdir()) - held} <= {"sketches", "rooted", "rdd"}
    new = lambda: sum(n for f, n in shuffled().items() if f not in before)
    until = time.time() + 20
    while new() > 500_000 and time.time() < until:
        time.sleep(0.2)
    # the texts are 4.7 MB and their sets 4.8; the links' components may leave a little
    assert new() <= 500_000
    assert all(r.component_id == r.doc_id // 2 * 2 for r in found.collect())
