"""Language identification by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text per
language. A text is parsed greedily into the longest phrases that occur in a
language's sample; the phrases' code length, phrases times log2 of the sample's
length, estimates the text's entropy under that language, and the least wins.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import field, slices, store, texts_of

#: Bound of the sample per language: rows, and characters taken of any one row.
SAMPLE_ROWS = 48
SAMPLE_ROW_CHARS = 8192
#: Characters of all samples together; each language has an equal share, so the model that is sent out has a bound.
SAMPLE_CHARS = 2_000_000
#: Languages whose bounds of the sample are broadcast at most; those of more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
UNDETERMINED = "und"
#: Texts are walked in stretches of this many characters side by side; phrases go on over their edges.
STRETCH = 256
#: Stretches fewer than this are walked one by one.
FEW = 128
SPACE, OTHER = 1, 2


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


class Letters:
    """Codes of characters: lower-cased letters of the samples, one code for letters in no sample, a space for the rest."""

    def __init__(self, seen: list[str]):
        self.size = OTHER + 1 + len(seen)
        self.code = np.where(_is_letter(), OTHER, SPACE)
        for k, c in enumerate(seen):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.code[ord(form)] = OTHER + 1 + k

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts laid end to end with runs of spaces as one, their lengths, and letters of each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        again = np.r_[False, (codes[1:] == SPACE) & (codes[:-1] == SPACE) & (owner[1:] == owner[:-1])][: len(codes)]
        codes, owner = codes[~again], owner[~again]
        return codes, np.bincount(owner, minlength=len(texts)), np.bincount(owner[codes != SPACE], minlength=len(texts))


def suffix_automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, code, next state) of the automaton of all substrings of `codes`; 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    size = [len(e) for e in go]
    flat = lambda of: np.fromiter((x for e in go for x in of(e)), np.int32, sum(size))
    return np.repeat(np.arange(len(go), dtype=np.int32), size), flat(dict.keys), flat(dict.values)


class Transitions:
    """A sparse table of (state, code) to next state: open addressing, looked up in numpy for many at once.
    A place holds the key and, in its low bits, the next state; -1 is an empty place."""

    def __init__(self, state: np.ndarray, code: np.ndarray, to: np.ndarray, codes: int):
        self.codes, self.bits = codes, max(4, int(3 * len(to)).bit_length())
        self.low = int(to.max(initial=1)).bit_length()
        self.entry = np.full(1 << self.bits, -1, np.int64)
        key = state.astype(np.int64) * codes + code
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = np.flatnonzero(self.entry[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.entry[at[put]] = key[left[put]] << self.low | to[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.entry) - 1)
        self.one = memoryview(self.entry)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, 0 where there is none."""
        key = state * self.codes + code
        at = self._slot(key)
        held = self.entry[at]
        miss = np.flatnonzero(held >> self.low != key)
        to = held & ((1 << self.low) - 1)
        to[miss] = 0
        miss = miss[held[miss] >= 0]
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self.entry) - 1)
            held = self.entry[at[miss]]
            hit = held >> self.low == key[miss]
            to[miss[hit]] = held[hit] & ((1 << self.low) - 1)
            miss = miss[~hit & (held >= 0)]
        return to

    def step(self, state: int, code: int) -> int:
        """The same for one: cheaper where few are left."""
        key = state * self.codes + code
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (held := self.one[at]) >= 0:
            if held >> self.low == key:
                return held & ((1 << self.low) - 1)
            at = (at + 1) & (len(self.one) - 1)
        return 0


class CrossParser:
    """The fitted model: per language its automaton and the bits of one phrase. What is sent to the
    executors are letters and lists of transitions, from which each worker makes its tables once."""

    def __init__(self, samples: dict[str, str]):
        seen = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        letters, edges, bits = Letters(seen), [], []
        for language in sorted(samples):
            codes, _, _ = letters([samples[language]])
            edges.append(suffix_automaton(codes.tolist()))
            bits.append(float(np.log2(len(codes) + 2)))
        self.__setstate__((sorted(samples), seen, edges, bits))

    def __getstate__(self) -> tuple:
        return self.languages, self.seen, self.edges, self.bits

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.seen, self.edges, self.bits = state
        self.letters = Letters(self.seen)
        self.tables = [Transitions(*e, self.letters.size) for e in self.edges]

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns), by greedy parsing from its first character.
        A character that the sample doesn't hold counts twice: it must be spelled out besides."""
        out = np.zeros((len(sizes), len(self.languages)), np.int64)
        ends = np.cumsum(sizes)
        for j, table in enumerate(self.tables):
            every = np.arange(self.letters.size)
            strange = np.r_[0, np.cumsum((table(np.zeros_like(every), every) == 0)[codes])]
            out[:, j] = Parse(codes, sizes, table).count() + strange[ends] - strange[ends - sizes]
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, score and bits a character of each text."""
        codes, sizes, letters = self.letters(texts)
        if not self.languages:
            return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        bits = self.phrases(codes, sizes) * np.array(self.bits)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        rate = least / np.maximum(sizes, 1)
        return [(self.languages[b], float(s), float(r)) if n else (UNDETERMINED, 0.0, 0.0) for b, s, r, n in zip(best, score, rate, letters, strict=True)]


class Parse:
    """Greedy parsing of texts laid end to end, in stretches side by side.

    Each stretch is first parsed as if a phrase began at its first character. Then
    the phrase that reaches over its edge goes on into it until a phrase begins where
    one began in that first parse; from there on both parses are the same."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, table: Transitions):
        self.codes, self.sizes, self.table = codes, sizes, table
        count = -(-sizes // STRETCH)
        self.owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        self.start = np.repeat(np.cumsum(sizes) - sizes, count) + nth * STRETCH
        self.size = np.minimum(np.repeat(sizes, count) - nth * STRETCH, STRETCH)
        self.later = nth > 0
        self.begins = np.zeros(len(codes), bool)

    def count(self) -> np.ndarray:
        every = np.arange(len(self.owner))
        own, end, _ = self._walk(every, np.zeros(len(every), np.int64), None)
        running = np.r_[0, np.cumsum(self.begins)]
        rest = running[self.start + self.size]
        phrases = rest - running[self.start]
        known, todo = end.copy(), every[self.later]
        while len(todo):
            more, left, place = self._walk(todo, known[todo - 1], self.begins)
            joined = place >= 0
            phrases[todo] = more + np.where(joined, rest[todo] - running[np.maximum(place, 0)], 0)
            now = np.where(joined, end[todo], left)
            changed = todo[now != known[todo]]
            known[todo] = now
            # only a stretch behind one that ends in another state than was taken for it is parsed again
            after = changed + 1
            after = after[after < len(every)]
            todo = after[self.later[after]]
        return np.bincount(self.owner, phrases, len(self.sizes)).astype(np.int64)

    def _walk(self, which: np.ndarray, state: np.ndarray, until: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch: phrases that begin in it, its last state, and the place where a phrase began
        that begins in `until` too (-1 for none), before which the walk ends. Without `until`, marks where phrases begin."""
        if until is not None and len(which) < FEW:
            return tuple(np.array(c) for c in zip(*(self._walk_one(int(k), int(s), until) for k, s in zip(which, state, strict=True)), strict=True))
        order = np.argsort(-self.size[which], kind="stable")
        lane, at, size, state = order, self.start[which[order]], self.size[which[order]], state[order]
        begun, last, place = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.full(len(which), -1)
        for k in range(int(size.max(initial=0))):
            live = np.searchsorted(-size, -k, "left")  # longer than k
            if live < len(lane):
                last[lane[live:]] = state[live:]
                lane, at, size, state = lane[:live], at[:live], size[:live], state[:live]
            c = self.codes[at]
            to = self.table(state, c)
            stop = np.flatnonzero((to == 0) | (state == 0))  # state 0: at the start, or behind a strange character
            if until is None:
                self.begins[at[stop]] = True
            else:
                same = until[at[stop]]
                place[lane[stop[same]]] = at[stop[same]]
                begun[lane[stop[~same]]] += 1
            again = stop[to[stop] == 0]
            to[again] = self.table(np.zeros(len(again), np.int64), c[again])
            if until is not None and same.any():
                stay = np.ones(len(lane), bool)
                stay[stop[same]] = False
                lane, at, size, to = lane[stay], at[stay], size[stay], to[stay]
            state = to
            if not len(lane):
                break
            at = at + 1
        last[lane] = state
        return begun, last, place

    def _walk_one(self, k: int, state: int, until: np.ndarray) -> tuple[int, int, int]:
        begun, step, start = 0, self.table.step, int(self.start[k])
        codes, marks = (x[start : start + self.size[k]].tolist() for x in (self.codes, until))
        for n, (c, mark) in enumerate(zip(codes, marks, strict=True)):
            to = step(state, c)
            if not to or not state:
                if mark:
                    return begun, 0, start + n
                begun += 1
                to = to or step(0, c)
            state = to
        return begun, state, -1


def fit(df: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> CrossParser:
    """Fit on at most SAMPLE_ROWS rows a language where `learn` holds, the language isn't null and the text isn't
    empty, taken in the order of a hash of the id; of a longer row the first SAMPLE_ROW_CHARS characters, and of each
    language an equal share of SAMPLE_CHARS. Repeated rows count each."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    keys = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(lang_col).alias("_lang"))
    order = Window.partitionBy("_lang").orderBy("_h")
    chosen = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_ROWS).groupBy("_lang").agg(F.max("_h").alias("_most"))
    chosen = store(chosen, "languages")
    share = SAMPLE_CHARS // max(1, languages := chosen.count())
    # one bound a language: small enough to broadcast whatever the number of rows, if languages are few
    chosen = F.broadcast(chosen) if languages <= BROADCAST_LANGUAGES else chosen
    texts = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(lang_col).alias("_lang"), F.substring(text_col, 1, SAMPLE_ROW_CHARS).alias("_text"))
    sample = texts.join(chosen, "_lang").where("_h <= _most")
    order = Window.partitionBy("_lang").orderBy("_h", "_text")
    sample = sample.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_ROWS)
    # cut to the share before anything is sent: SAMPLE_CHARS bounds what comes to the driver, however many languages there are
    before = F.coalesce(F.sum(F.length("_text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = sample.withColumn("_left", (F.lit(share) - before).cast("int")).where("_left > 0").select("_lang", "_h", F.col("_text").substr(F.lit(1), F.col("_left")).alias("_text"))
    gathered: dict[str, list] = {}
    for r in sample.collect():
        gathered.setdefault(r._lang, []).append((r._h, r._text))
    return CrossParser({lang: "\n".join(t for _, t in sorted(rows))[:share] for lang, rows in gathered.items()})


def identify_language(df: DataFrame, model: CrossParser, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`df` with `lang_pred` (string), `score` (0 to 1) and `bits_per_char` (double), their names led by `prefix`.

    A text that is null or has no letter is `und` with score 0, as is every text
    where nothing was learned. Ties go to the language that sorts first. Rows
    and all their columns stay as they are; a column of such a name is replaced.
    Only the text goes into the prediction. An empty table gives an empty table.
    """
    names = [prefix + n for n in ("lang_pred", "score", "bits_per_char")]
    rest = df.drop(*names)
    schema = T.StructType([*(field(rest, c) for c in rest.columns), *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = list(zip(*sent.value.predict(texts_of(batch, text_col)), strict=True))
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=schema.names)

    return rest.mapInArrow(run, schema)
