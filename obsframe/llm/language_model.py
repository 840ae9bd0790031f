"""A hashed maximum-entropy language model with a class-factored softmax.

log p(word | history) = log p(class | history) + log p(word | class). The class
part is a softmax over a few classes, linear in features of the history: the
hashed word before, the hashed two words before, the hashed word that a skip of
one reaches, the pair of classes before and the pair that a skip over those
reaches. It is trained by gradient steps in every task, whose weights are
averaged after each round. The word part's only features are the words
themselves, for which maximum entropy gives their relative counts, here plus
one, over the whole training corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import Memo, cut, field, slices, store

#: The most frequent words, whose counts are broadcast; this bounds the broadcast, other counts are joined.
HEAD_WORDS = 100_000
#: Classes: one for each of the most frequent words (the end of a text among them), the rest by how a word ends.
SINGLE = 16
CLASSES = 64
#: Rows of weights for each kind of hashed words, and for each pair of classes.
BUCKETS = 1 << 13
PAIRS = (CLASSES + 1) ** 2
ROUNDS = 2
#: Tokens that a task of a round learns from, at least, where there are that many: tasks of few tokens learn little, and each returns a weight table.
TASK_TOKENS = 2_000_000
#: Tokens in one gradient step, how many of them a running sum goes over, and the step's size.
STEP = 4096
RUN = 32
RATE = 0.15
#: The end of a text, as a token; no word holds white space.
END = b"\n"
MEMO_ENTRIES = 250_000
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 500_000


def tokenise(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of `texts` (null counts as empty), the place in them of each token, end to end, and how
    many tokens each text has. The words are split and told apart by Arrow, so what follows is done once a word."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    words, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    # white space at an end of a text leaves an empty word there
    held = pa.compute.greater(pa.compute.binary_length(words), 0)
    before = np.r_[0, np.cumsum(held.to_numpy(zero_copy_only=False), dtype=np.int64)]
    sizes = np.diff(before[offsets]) + 1
    found = words.filter(held).dictionary_encode()
    place = np.full(int(sizes.sum()), len(found.dictionary), np.int64)
    inside = np.ones(len(place), bool)
    inside[np.cumsum(sizes) - 1] = False
    place[inside] = found.indices.to_numpy()
    return [*found.dictionary.cast(pa.binary()).to_pylist(), END], place, sizes


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; each task sums up what it holds before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "_text"):
            words, place, _ = tokenise(batch.column("_text"))
            counts.update(dict(zip(words, np.bincount(place, minlength=len(words)).tolist(), strict=True)))
            if len(counts) > COUNTED:
                yield flush(counts)
                counts = Counter()
        if counts:
            yield flush(counts)

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    partial = df.select(F.col(text_col).alias("_text")).mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the head words (sorted, the most frequent first), and the class of any word.

    The SINGLE most frequent tokens have a class each; others fall into classes
    by a hash of their last two bytes, so that a class is known without a table."""

    def __init__(self, head: list[tuple[bytes, int]]):
        self.count = dict(head)
        self.single = {w: k for k, (w, _) in enumerate(head[:SINGLE])}
        self.total = np.zeros(CLASSES)
        self.types = np.zeros(CLASSES)

    def word_class(self, w: bytes) -> int:
        k = self.single.get(w)
        return SINGLE + crc32(w[-2:]) % (CLASSES - SINGLE) if k is None else k

    def entries(self, words: list[bytes]) -> list[int]:
        """For each word one number: class (8 bits), hash (16), and 1 more than its count, or 0 outside the head."""
        single, count = self.single, self.count
        return [single.get(w, SINGLE + crc32(w[-2:]) % (CLASSES - SINGLE)) | (crc32(w) & 0xFFFF) << 8 | (count.get(w, -1) + 1) << 24 for w in words]

    def log_class_size(self) -> np.ndarray:
        """log10 of what word counts plus one are divided by; a class of one word is that word."""
        size = self.total + self.types + 1
        size[: len(self.single)] = 1
        return np.log10(size)


def head_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, sorted: SINGLE in any case, HEAD_WORDS at most besides. The least count among those
    is read off a histogram of logarithms, so no task or driver gathers more than that many; words of the count at
    the edge stay out together."""
    step = F.floor(F.log2("n") * 32)
    left, least = HEAD_WORDS, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        left -= r.words
        if left < 0:
            break
        least = r.step
    rows = counts.where(step >= least).collect() if least is not None else []
    rows += counts.orderBy(F.desc("n"), "word").limit(SINGLE).collect()
    return sorted({(bytes(r.word), r.n) for r in rows}, key=lambda x: (-x[1], x[0]))


def class_totals(counts: DataFrame, vocabulary: Vocabulary) -> None:
    """Fill in tokens and types of each class, over all words: CLASSES rows a task at most."""
    sent = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            classes = np.fromiter(map(sent.value.word_class, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(total, classes, batch.column(1).to_numpy())
            np.add.at(types, classes, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total), pa.array(types)], names=["k", "total", "types"])

    for r in counts.mapInArrow(run, "k int, total long, types long").groupBy("k").agg(F.sum("total").alias("total"), F.sum("types").alias("types")).collect():
        vocabulary.total[r.k], vocabulary.types[r.k] = r.total, r.types


def encode(texts: pa.Array | list, memo: Memo) -> tuple[tuple[list[bytes], np.ndarray], np.ndarray, np.ndarray]:
    """The distinct tokens with each token's place in them, how many tokens each text has, and the vocabulary's entries of all, end to end."""
    words, place, sizes = tokenise(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    known = memo.over(set(words))
    return (words, place), sizes, np.fromiter(map(known.__getitem__, words), np.int64, len(words))[place]


class Encoded:
    """Texts end to end, by the low 24 bits of their entries: the class, document and features of each token."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.classes = (codes & 0xFF).astype(np.int16)
        self.document = np.repeat(np.arange(len(sizes)), sizes)
        self.features = self._features((codes >> 8 & 0xFFFF).astype(np.uint32), self.classes, np.cumsum(sizes) - sizes)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Encoded:
        """From the columns `_codes` and `n_tokens`."""
        codes = np.frombuffer(b"".join(batch.column("_codes").to_pylist()), np.int32)
        return cls(codes, batch.column("n_tokens").to_numpy())

    @staticmethod
    def _features(hashed: np.ndarray, classes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each weight table the rows of all tokens: the word before, the two words before, the word
        before that one, the two classes before, and (skipping those) the two classes before them."""

        def back(values: np.ndarray, d: int, none: int) -> np.ndarray:
            out = np.full_like(values, none)
            out[d:] = values[:-d]
            # what lies before the first token of a text is of another text
            for k in range(d):
                at = first + k
                out[at[at < len(out)]] = none
            return out

        def few_bits(h: np.ndarray) -> np.ndarray:
            return h >> np.uint32(33 - BUCKETS.bit_length())

        one, two = back(hashed, 1, 0), back(hashed, 2, 0)
        words = [one % np.uint32(BUCKETS), few_bits(one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77)), few_bits(two * np.uint32(0xC2B2AE3D))]
        c = [back(classes, d, CLASSES) for d in range(1, 5)]
        pairs = [c[0] * np.int16(CLASSES + 1) + c[1], c[2] * np.int16(CLASSES + 1) + c[3]]
        return [*(w.astype(np.int16) for w in words), *pairs]


#: First row of each table, and of the bias behind them.
TABLES = (0, BUCKETS, 2 * BUCKETS, 3 * BUCKETS, 3 * BUCKETS + PAIRS)
ROWS = 3 * BUCKETS + 2 * PAIRS + 1
_ONES = np.ones(CLASSES, np.float32)
#: Class weights are held to this range before exp, which no float leaves then.
_LIMIT = np.float32(60)


def class_weights(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """exp of what each class gets from the features; a row's probabilities are in proportion to it."""
    z = weights[TABLES[0] :].take(features[0], axis=0)
    for start, rows in zip(TABLES[1:], features[1:], strict=True):
        z += weights[start:].take(rows, axis=0)
    z += weights[ROWS - 1]
    np.clip(z, -_LIMIT, _LIMIT, out=z)
    return np.exp(z, out=z)


def class_log_probabilities(weights: np.ndarray, features: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """The log-probability of each token's class."""
    e = class_weights(weights, features)
    return np.log(e[np.arange(len(classes)), classes]) - np.log(e @ _ONES)


def sums_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `rows` and the sums of their `values`: differences of running sums over the sorted rows. Those
    are cut into runs of RUN, which lie side by side, so that one addition takes all runs a step further."""
    n, width = len(rows), values.shape[1]
    runs = -(-n // RUN)
    order = np.argsort(rows, kind="stable")
    row = rows.take(order)
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True])
    # what fills up the last run lies behind all that is read
    dealt = np.r_[order, np.zeros(runs * RUN - n, order.dtype)].reshape(runs, RUN).T.ravel()
    running = values.take(dealt, axis=0).reshape(RUN, runs * width)
    for k in range(1, RUN):
        np.add(running[k], running[k - 1], out=running[k])
    before = np.zeros((runs, width), np.float32)
    np.cumsum(running[-1].reshape(runs, width)[:-1], axis=0, out=before[1:])
    run, at = np.divmod(last, RUN)
    sums = running.reshape(RUN * runs, width).take(at * runs + run, axis=0)
    sums += before.take(run, axis=0)
    sums[1:] -= sums[:-1].copy()
    return row.take(last), sums


def gradient_steps(weights: np.ndarray, spread: np.ndarray, features: list[np.ndarray], classes: np.ndarray) -> None:
    """Steps over all tokens given, STEP at a time; `spread` holds each row's sum of squared slopes."""
    for at in range(0, len(classes), STEP):
        part, c = [f[at : at + STEP] for f in features], classes[at : at + STEP]
        slope = class_weights(weights, part)
        slope /= (slope @ _ONES)[:, None]
        slope[np.arange(len(c)), c] -= 1
        for first, rows in zip(TABLES, part, strict=True):
            row, total = sums_by_row(rows, slope)
            row = row.astype(np.int64) + first
            spread[row] += np.einsum("ij,ij->i", total, total) / CLASSES
            total *= (np.float32(RATE) / np.sqrt(spread[row] + 1))[:, None]
            weights[row] -= total


def encode_texts(df: DataFrame, vocabulary: Vocabulary, full: bool, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """Each row's id, whether and in which round it is learned from, its tokens' classes and hashes as numbers of
    4 bytes, its figures so far (the score without the class part), and the words that aren't head words with how
    often they occur; none if every word of the corpus is one (`full`)."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType(
        [T.StructField("_row", T.LongType()), field(df, id_col, "_id"), T.StructField("_learn", T.BooleanType()), T.StructField("_round", T.LongType())]
        + [T.StructField("_codes", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("_base", "_score")]
        + [T.StructField("_rare", T.ArrayType(T.BinaryType())), T.StructField("_times", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        memo = Memo(MEMO_ENTRIES, words.entries)
        size = words.log_class_size()
        for batch in slices(batches, "_text"):
            (distinct, place), sizes, table = encode(batch.column("_text"), memo)
            n = len(sizes)
            document, classes, count = np.repeat(np.arange(n), sizes), table & 0xFF, (table >> 24) - 1
            log_count = np.log10(np.maximum(count, 0) + 1.0)
            by_text = lambda x, d=document, n=n: np.bincount(d, x, n)
            score = by_text(np.where(classes < len(words.single), 0, log_count) - size[classes])
            codes, start = (table & 0xFFFFFF).astype(np.int32), np.r_[0, np.cumsum(sizes)]
            outside = np.empty(0, np.int64) if full else np.flatnonzero(count < 0)
            pairs, times = np.unique(document[outside] * len(distinct) + place[outside], return_counts=True)
            in_text, word = np.divmod(pairs, len(distinct))
            bounds = pa.array(np.r_[0, np.cumsum(np.bincount(in_text, minlength=n))], pa.int32())
            rare = pa.ListArray.from_arrays(bounds, pa.array(distinct, pa.binary()).take(pa.array(word)))
            times = pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))
            pieces = [codes[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
            columns = [sizes, by_text(count > 0).astype(np.int64), by_text(log_count), score]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(pieces, pa.binary()), *map(pa.array, columns), rare, times], names=schema.names
            )

    turn = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(ROUNDS))
    read = df.select(F.monotonically_increasing_id(), F.col(id_col), F.coalesce(learn, F.lit(False)), turn.alias("_turn"), F.col(text_col).alias("_text"))
    return store(read.mapInArrow(run, schema), "encoded")


def train(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after ROUNDS rounds over texts as `encode_texts` gives them; each round takes its share of the documents (by a hash of the id), so
    every document is learned from once. What tasks return is one weight table each, summed up in a tree."""
    weights = np.zeros((ROWS, CLASSES), np.float32)
    # the bias starts at the classes' own frequencies
    weights[ROWS - 1] = np.log((vocabulary.total + 1) / (vocabulary.total.sum() + CLASSES))
    tasks = max(1, int(vocabulary.total.sum() / ROUNDS / TASK_TOKENS))
    for n in range(ROUNDS):
        share = encoded.where(F.col("_learn") & (F.col("_round") == n))
        sent = encoded.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, spread, seen = sent.value.copy(), np.zeros(ROWS, np.float32), 0
            for batch in slices(batches, "_codes"):
                texts = Encoded.of(batch)
                gradient_steps(own, spread, texts.features, texts.classes)
                seen += len(texts.classes)
            if seen:
                change = ((own - sent.value) * np.float32(seen)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([change], pa.binary()), pa.array([seen], pa.int64())], names=["change", "seen"])

        moved = share.select("_codes", "n_tokens").coalesce(tasks).mapInArrow(run, "change binary, seen long")
        add = lambda a, b: (a[0] + b[0], a[1] + b[1])
        change, seen = moved.rdd.map(lambda r: (np.frombuffer(r.change, np.float32), r.seen)).treeAggregate((np.float32(0), 0), add, add, 3)
        if seen:
            weights += np.asarray(change).reshape(weights.shape) / np.float32(seen)
        sent.unpersist()
    return weights


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, `n_tokens`, `n_known`, `train_tokens` (long), `base_score` and `score` (double) of each row.

    Learns from the rows where `learn` holds. Tokens are the text's words,
    A-Z lower-cased, and one end; null and empty texts are the end alone.
    `base_score` is the text's log10 probability by add-one counts of single
    tokens, `score` that by the model; words never seen in training share one
    place in each class. Without training rows both count every token as that
    place. Repeated rows are scored each and all learned from; a null id is
    carried along; other columns are left out; an empty table gives an empty one.

    Head words' counts go out by broadcast (HEAD_WORDS bounds it); for the rest,
    each text's rarer words are joined to the table of counts. Texts are read
    twice, to count and to encode; training and scoring read the encoded ones.
    """
    spark = df.sparkSession
    learned = df.where(learn)
    counts = cut(word_counts(learned, text_col))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = head_words(counts)
    vocabulary = Vocabulary(head)
    class_totals(counts, vocabulary)
    encoded = encode_texts(df, vocabulary, len(head) == types, learn, id_col, text_col)
    model = spark.sparkContext.broadcast(train(encoded, vocabulary))
    passed = ("_row", "_id", "n_tokens", "_known", "_base", "_score", "_rare", "_times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_codes"):
            texts = Encoded.of(batch)
            log_p = np.empty(len(texts.classes))
            for at in range(0, len(log_p), STEP):
                log_p[at : at + STEP] = class_log_probabilities(model.value, [f[at : at + STEP] for f in texts.features], texts.classes[at : at + STEP])
            score = batch.column("_score").to_numpy() + np.bincount(texts.document, log_p / np.log(10), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(score) if c == "_score" else batch.column(c) for c in passed], names=passed)

    rows = encoded.select(*passed, "_codes").mapInArrow(run, encoded.select(*passed).schema)
    # one row for each rare word; the text's own figures travel on the first only
    words = rows.select("*", F.posexplode_outer(F.arrays_zip(F.col("_rare").alias("word"), F.col("_times").alias("times"))).alias("_at", "_w"))
    first = F.coalesce("_at", F.lit(0)) == 0
    figures = ("_id", "n_tokens", "_known", "_base", "_score")
    # a text without rare words gets a key of its own, so that such rows don't meet in one task
    key = F.coalesce("_w.word", F.concat(F.lit(" "), F.col("_row").cast("string")).cast("binary"))
    single = words.select("_row", key.alias("word"), F.coalesce("_w.times", F.lit(0)).alias("times"), *(F.when(first, F.col(c)).alias(c) for c in figures))
    joined = single.join(counts, "word", "left")
    gain = F.log10(F.coalesce("n", F.lit(0)) + 1.0) * F.col("times")
    seen = F.when(F.col("n").isNotNull(), F.col("times"))
    kept = [F.max(c).alias(c) for c in figures]
    summed = joined.groupBy("_row").agg(*kept, F.sum(gain).alias("_gain"), F.coalesce(F.sum(seen), F.lit(0)).alias("_seen"))
    return summed.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("_known") + F.col("_seen")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.col("_gain") - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("_score") + F.col("_gain")).alias("score"),
    )
