"""A quality score learned from preference pairs (Bradley-Terry).

The chance that document a is preferred to document b is the logistic function
of the difference of their scores, and scores are linear in features of the
text. Pairs take a row of label 1 and one of label 0; the loss is the logistic
loss of feature differences. The cut between good and bad is a quantile of the
training scores.

Every labelled row is learned from. Rows are dealt to blocks by a hash, and each
good row of a block is compared with each bad one, so pairs grow with the rows.
Spark sums slopes and second derivatives over the blocks, once a Newton step,
and counts at every training score how many labels a cut there gets wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import field, slices, store, texts_of

#: Up to so many rows of each label are fitted in one place, on PAIRS preference pairs of them (each row is in dozens).
SMALL_ROWS = 256
PAIRS = 24_000
#: Rows of the commoner label in a block, about, and of the rarer one at least: its rows go to several blocks if need be.
BLOCK_ROWS, BLOCK_LEAST = 512, 64
STEPS, CLOSE = 25, 1e-9
#: Different texts under one labelled id that are learned from, at most.
TEXTS_OF_ID = 4
#: The score that stands at the chosen quantile.
CUT_SCORE = 0.3
_EXTRA = 10


def features(texts: list[str]) -> np.ndarray:
    """One row a text: shares of each ASCII character and of other bytes, and shape of words and lines."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.minimum(np.frombuffer(b"".join(raw), np.uint8), 128).astype(np.int64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64) * 129, sizes)
    count = np.bincount(owner + data, minlength=129 * len(raw)).reshape(-1, 129).astype(float)
    share = np.sqrt(count / np.maximum(sizes, 1)[:, None])
    extra = np.zeros((len(raw), _EXTRA))
    upper, lower, digit = count[:, 65:91].sum(1), count[:, 97:123].sum(1), count[:, 48:58].sum(1)
    n = np.maximum(sizes, 1)
    for i, r in enumerate(raw):
        words = r.split()
        lines = r.split(b"\n")
        if words:
            extra[i, :4] = len(set(words)) / len(words), np.log1p(len(words)), np.log1p(len(r) / len(words)), len(set(lines)) / len(lines)
            extra[i, 4] = np.log1p(len(words) / len(lines))
    extra[:, 5], extra[:, 6], extra[:, 7] = upper / np.maximum(upper + lower, 1), digit / n, (upper + lower + count[:, 128]) / n
    extra[:, 8] = 1 - (upper + lower + digit + count[:, 128] + count[:, 32] + count[:, 10]) / n
    extra[:, 9] = sizes == 0
    return np.hstack([share, extra])


class PairwiseModel:
    """Scores are weights times standardised features, moved so that the cut has CUT_SCORE."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, seed: int = 7, ridge: float = 1e-3):
        both = np.vstack([good, bad])
        self.mean, self.scale = (both.mean(0), both.std(0) + 1e-6) if len(both) else (0.0, 1.0)
        width = good.shape[1]
        self.weights, self.cut = np.zeros(width), 0.0
        if not len(good) or not len(bad):
            return
        draw = np.random.default_rng(seed)
        d = self._standard(good)[draw.integers(0, len(good), PAIRS)] - self._standard(bad)[draw.integers(0, len(bad), PAIRS)]
        for _ in range(12):  # Newton steps; the loss is convex
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))
            slope = d.T @ p / PAIRS - ridge * self.weights
            bend = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + ridge * np.eye(width)
            self.weights += np.linalg.solve(bend, slope)
        self.cut = self._quantile(good, bad)

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> PairwiseModel:
        """A model with these weights and no cut yet."""
        model = cls.__new__(cls)
        model.mean, model.scale, model.weights, model.cut = mean, scale, weights, 0.0
        return model

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _quantile(self, good: np.ndarray, bad: np.ndarray) -> float:
        """The quantile of the pooled scores, each label with half the weight, that errs least."""
        g, b = np.sort(self.raw(good)), np.sort(self.raw(bad))
        marks = np.quantile(np.r_[g, b], np.linspace(0, 1, 513))
        right = (1 - np.searchsorted(g, marks) / len(g)) + np.searchsorted(b, marks) / len(b)
        best = marks[right == right.max()]
        return float(best[len(best) // 2])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._standard(x) @ self.weights

    def __call__(self, texts: list[str]) -> np.ndarray:
        z = self.raw(features(texts)) - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _summed(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over blocks of `work` (of features, labels and whether a row is at home), an array of `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x, label, home in _unpacked(batches):
            total += work(x, label, home)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "v"])

    got = blocks.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        rows = batch.column(0)
        for k in range(batch.num_rows):
            label, home, x = rows[k].values.flatten()
            yield np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), -1).astype(float), label.to_numpy(), home.to_numpy(zero_copy_only=False)


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """One row a block: its rows (label, whether this is its row's first block, features)."""
    number = -(-max(counts.values()) // BLOCK_ROWS)
    copies = F.create_map(*(F.lit(v) for label, n in counts.items() for v in (label, min(number, -(-BLOCK_LEAST * number // n)))))[F.col("_label")]
    first = F.pmod(F.xxhash64(F.col("_id").cast("string"), "_hash", "_label"), F.lit(number))
    places = F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.struct((k == 0).alias("_home"), F.pmod(first + F.floor(k * number / copies), F.lit(number)).alias("_block")))
    dealt = rows.select("_label", "_x", F.inline(places))
    return store(dealt.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_label", "_home", "_x"))).alias("_rows")).select("_rows"), "blocks")


def _least_errors(scores: DataFrame, counts: dict[int, int]) -> float:
    """The cut that errs least on all training scores (`score`, `_label`), each label with half the weight: the middle
    between two scores that follow one another. Ranges of scores are counted side by side."""
    seen = store(scores.groupBy("score").agg(F.sum("_label").cast("long").alias("g"), F.sum(1 - F.col("_label")).cast("long").alias("b")), "scores")
    # these bounds decide who counts what, not what comes out
    bounds = sorted(set(seen.approxQuantile("score", [k / 64 for k in range(1, 64)], 0.002)))
    placed = seen.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda e: e <= F.col("score"))))
    starts, g, b, last = [], 0, 0, None
    for r in sorted(placed.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("score").alias("last")).collect(), key=lambda r: r.part):
        starts.append((r.part, g, b, last))
        g, b, last = g + r.g, b + r.b, r.last
    begun = scores.sparkSession.createDataFrame(starts, "part int, g0 long, b0 long, s0 double")
    w = Window.partitionBy("part").orderBy("score")
    below = lambda c: F.col(f"{c}0") + F.sum(c).over(w) - F.col(c)
    marks = placed.join(F.broadcast(begun), "part").select(
        "score", F.coalesce(F.lag("score").over(w), "s0", "score").alias("before"), (below("b") * counts[1] - below("g") * counts[0]).alias("right")
    )
    best = marks.orderBy(F.desc("right"), "score").first()
    return (best.before + best.score) / 2


def _fit_blocks(rows: DataFrame, counts: dict[int, int], ridge: float = 1e-3) -> PairwiseModel:
    blocks, width = _blocks(rows, counts), 129 + _EXTRA
    sums = _summed(blocks, lambda x, label, home: np.r_[x[home].sum(0), (x[home] ** 2).sum(0)], 2 * width).reshape(2, width) / sum(counts.values())
    model = PairwiseModel.of(sums[0], np.sqrt(np.maximum(sums[1] - sums[0] ** 2, 0)) + 1e-6, np.zeros(width))
    for _ in range(STEPS):  # Newton; the loss is convex

        def work(x: np.ndarray, label: np.ndarray, home: np.ndarray, model: PairwiseModel = model) -> np.ndarray:
            z = model._standard(x)
            good, bad = z[label == 1], z[label == 0]
            p = 1 / (1 + np.exp(np.clip((good @ model.weights)[:, None] - (bad @ model.weights)[None], -30, 30)))
            w = p * (1 - p)
            mixed = good.T @ (w @ bad)
            bend = (good * w.sum(1)[:, None]).T @ good + (bad * w.sum(0)[:, None]).T @ bad - mixed - mixed.T
            return np.r_[p.sum(1) @ good - p.sum(0) @ bad, bend.ravel(), p.size]

        found = _summed(blocks, work, width + width * width + 1)
        pairs = found[-1]
        step = np.linalg.solve(found[width:-1].reshape(width, width) / pairs + ridge * np.eye(width), found[:width] / pairs - ridge * model.weights)
        model = PairwiseModel.of(model.mean, model.scale, model.weights + step)
        if np.abs(step).max() < CLOSE:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, label, home in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x[home])), pa.array(label[home], pa.int32())], names=["score", "_label"])

    model.cut = _least_errors(blocks.mapInArrow(score, "score double, _label int"), counts)
    return model


def fit(df: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> PairwiseModel:
    """Fit on all labels of 1 and of 0 for which `learn` (of the id) holds. Null labels, and labels whose document is missing,
    teach nothing. Rows that repeat an id and a text teach once, and of one id's different texts TEXTS_OF_ID do, in the
    order of their hash."""
    usable = labels.where(learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label IN (0, 1)").distinct()
    texts = df.where(F.col(id_col).isNotNull() & learn).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = features(texts_of(batch, "_text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "_hash", "_x"])

    # features are shuffled, texts are not
    shape = T.StructType([field(df, id_col, "_id"), T.StructField("_hash", T.LongType()), T.StructField("_x", T.BinaryType())])
    rows = texts.mapInArrow(run, shape).join(usable, "_id")
    rows = rows.groupBy("_id", "_label", "_hash").agg(F.min("_x").alias("_x"))
    rows = store(rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_label").orderBy("_hash"))).where(F.col("_n") <= TEXTS_OF_ID).drop("_n"), "labelled")
    counts = {0: 0, 1: 0} | {r._label: r.n for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if min(counts.values()) and max(counts.values()) > SMALL_ROWS:
        return _fit_blocks(rows, counts)
    # SMALL_ROWS bounds what comes to the driver; one label alone teaches nothing
    got = rows.where(F.lit(min(counts.values()) > 0)).select("_label", "_x").toArrow()
    x = np.frombuffer(b"".join(got.column("_x").to_pylist()), np.float32).reshape(got.num_rows, 129 + _EXTRA).astype(float)
    label = got.column("_label").to_numpy()
    order = np.lexsort([*x[:, :40].T, label])  # the same pairs however the rows arrive
    x, label = x[order], label[order]
    return PairwiseModel(x[label == 1], x[label == 0])


def score_quality(df: DataFrame, model: PairwiseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `score` (double, 0 to 1) of each row; higher is better and CUT_SCORE is the cut.

    Null texts score as empty ones, and every text gets a score. Repeated rows
    score alike; null ids are carried along; other columns are left out; an
    empty table gives an empty table. Without labels of both kinds every
    text scores CUT_SCORE.
    """
    schema = T.StructType([field(df, id_col), T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value(texts_of(batch, "_text")), pa.float64())], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
