"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; only the words under a 1 are
hashed, so a substitution under a 0 does not hide a copy. Seeds of the
benchmark items are held as a sorted table of bounded size, every seed of a
document is looked up in it, and around each hit the words of document and item
are compared place by place: an overlap is a stretch that scores highest with
+1 for a word that agrees and -MISS for one that does not, or the whole item
where SHARE of its words agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from obsframe.llm.common import Memo, field, free_name, slices, store, texts_of

MASKS = ("111011011", "11010011101", "1100110101011")
#: Agreeing words that make an overlap; an item with fewer words must be there whole.
LEAST = 12
#: Items with fewer words than this take no part, unless a caller asks for them.
LEAST_ITEM = 8
#: A disagreeing word costs as much as four agreeing ones give, so four in five words agree in any overlap.
MISS = 4
#: Where this share of an item's words agrees, it is an overlap however the others are spread.
SHARE = 0.8
#: Words of benchmark items in one broadcast block.
BLOCK_WORDS = 1_000_000
MEMO_ENTRIES = 600_000
_STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Pairs of equal seeds that are looked at together.
PAIRS = 1_000_000
#: Thai to Khmer, CJK, kana, Hangul and the ideographs beyond: scripts that put no spaces between words.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\ua000-\ua4cf\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff])")


def _overlaps(item_id: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_id)] + [T.StructField(c, T.IntegerType()) for c in ("doc_start", "item_start", "length", "matches")]))


def words_of(text: str) -> list[bytes]:
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> list[int]:
    """Of the words lower-cased and without punctuation around them; 0 for nothing but punctuation."""
    from xxhash import xxh64_intdigest

    return [(xxh64_intdigest(core) | 1) if (core := w.lower().strip(_STRIP)) else 0 for w in words]


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at each start; h are the words' hashes."""
    n = len(h) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class ItemBlock:
    """Some benchmark items: their words' hashes end to end and a sorted table of their seeds."""

    def __init__(self, items: list[tuple], least_item: int):
        self.ids, rows = [], []
        for item, text in items:
            h = np.array([x for x in _hashes(words_of(text or "")) if x], np.uint64)
            if len(h) >= max(1, least_item):
                self.ids.append(item)
                rows.append(h)
        self.size = np.array([len(h) for h in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate(rows) if rows else np.empty(0, np.uint64)
        short = sorted({len(h) for h in rows if len(h) < max(map(len, MASKS))})
        self.masks = [*MASKS, *("1" * n for n in short)]
        self.tables = []
        for mask in self.masks:
            # an all-ones mask serves the items of just that length
            own = [k for k, h in enumerate(rows) if len(h) >= len(mask) and (mask in MASKS or len(h) == len(mask))]
            seeds = [_seeds(rows[k], mask) for k in own]
            value = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
            at = np.concatenate([np.arange(len(s)) + self.start[k] for k, s in zip(own, seeds, strict=True)]) if seeds else np.empty(0, np.int64)
            order = np.argsort(value, kind="stable")
            sieve = np.zeros(1 << 16, bool)
            sieve[(value & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.tables.append((value[order], at[order], sieve))

    def overlaps(self, h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """The number of the text and its best overlap with each item, in order; `h` are the words of all texts, which
        end at `ends`. Equal overlaps: the first in the text."""
        starts = np.r_[0, ends[:-1]]
        one, best = (-1, -1), None
        for text, item, shift in self._diagonals(h, starts, ends).tolist():
            if (text, item) != one:
                if best:
                    yield one[0], (self.ids[one[1]], *best)
                one, best = (text, item), None
            size, first, last = int(self.size[item]), int(starts[text]), int(ends[text])
            if best and best[3] == size:
                continue  # no more words can agree
            a, b = max(0, -shift), min(size, last - first - shift)
            same = h[first + shift + a : first + shift + b] == self.words[self.start[item] + a : self.start[item] + b]
            s, e = _best_stretch(same)
            matches, least = int(same[s:e].sum()), min(LEAST, size)
            if matches < least and same.sum() >= SHARE * size:
                agree = np.flatnonzero(same)
                s, e, matches, least = int(agree[0]), int(agree[-1]) + 1, len(agree), 0
            if matches >= least and (best is None or matches > best[3]):
                best = (shift + a + s, a + s, e - s, matches)
        if best:
            yield one[0], (self.ids[one[1]], *best)

    def _diagonals(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(text, item, place in the text less place in the item) of all equal seeds, each once and sorted."""
        # as one number each: 2**63 is beyond texts x items x words of any batch and block
        wide, most = len(h) + int(self.size.max(initial=0)) + 1, int(self.size.max(initial=0))
        found = np.empty(0, np.int64)
        for mask, (value, at, sieve) in zip(self.masks, self.tables, strict=True):
            seeds = _seeds(h, mask)
            place = np.flatnonzero(sieve[(seeds & np.uint64(0xFFFF)).astype(np.int64)])
            low, high = np.searchsorted(value, seeds[place], "left"), np.searchsorted(value, seeds[place], "right")
            place, low, times = place[high > low], low[high > low], (high - low)[high > low]
            # repeats make many pairs, but few diagonals: a part at a time
            part = np.cumsum(times) // PAIRS
            for k in np.unique(part):
                p, lo, t = place[part == k], low[part == k], times[part == k]
                pick = np.repeat(lo - (np.cumsum(t) - t), t) + np.arange(t.sum())
                where, word = np.repeat(p, t), at[pick]
                item, text = np.searchsorted(self.start, word, "right") - 1, np.searchsorted(ends, where, "right")
                shift = where - starts[text] - (word - self.start[item])
                found = np.union1d(found, (text * len(self.size) + item) * wide + shift + most)
        return np.stack([found // wide // len(self.size), found // wide % len(self.size), found % wide - most], 1) if len(found) else np.empty((0, 3), np.int64)


def _best_stretch(same: np.ndarray) -> tuple[int, int]:
    """Bounds of the stretch with the highest sum of +1 for True and -MISS for False; of equal ones that with most True."""
    total = np.r_[0, np.cumsum(np.where(same, 1, -MISS))]
    least = np.minimum.accumulate(total)
    # the first place with the least sum so far
    start = np.maximum.accumulate(np.where(np.r_[True, least[1:] < least[:-1]], np.arange(len(total)), 0))
    ends = np.flatnonzero(total - least == (total - least).max())
    count = np.r_[0, np.cumsum(same)]
    end = int(ends[(count[ends] - count[start[ends]]).argmax()])
    return int(start[end]), end


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, least_item: int) -> Iterator[ItemBlock]:
    """The items in blocks of about BLOCK_WORDS words (an item is never split)."""
    block, words = [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((r.i, r.t))
        words += len(words_of(r.t or ""))
        if words >= BLOCK_WORDS:
            yield ItemBlock(block, least_item)
            block, words = [], 0
    if block:
        yield ItemBlock(block, least_item)


def find_overlaps(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", result: str = "overlaps", least_item: int = LEAST_ITEM) -> DataFrame:
    """`df` with an array column `result`: per benchmark item that the text overlaps, item_id, doc_start
    and item_start (words, from 0, those of punctuation alone left out), length and matches.

    Words are lower-cased by ASCII and stripped of punctuation. Of several
    overlaps with one item the one with most matches is reported, the first of equal ones. Null and
    empty texts overlap nothing; items that are null or shorter than `least_item`
    words take no part, other items with fewer words than LEAST must be there whole (or
    SHARE of them); repeated items are reported each; all rows and other
    columns stay (one named `result` is replaced). Every document word is
    looked up. The benchmark goes through the driver in blocks of BLOCK_WORDS words, each a
    broadcast; if it is more than one, each block's finds are written to the shared
    folder before the next is read, and joined to the texts by their hash.
    """
    spark = df.sparkSession
    df = df.drop(result)
    kind = _overlaps(benchmark.schema[item_id_col].dataType)
    blocks = item_blocks(benchmark, item_id_col, item_text_col, least_item)
    block, another = next(blocks, None), next(blocks, None)
    if block is None:
        return df.withColumn(result, F.array().cast(kind))
    if another is None:
        schema = T.StructType([*(field(df, c) for c in df.columns), T.StructField(result, kind)])
        return df.mapInArrow(_scanner(spark.sparkContext.broadcast(block), text_col, schema), schema)
    name = free_name(df, "_md5")
    texts = df.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias(name), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField(name, T.StringType()), T.StructField("_text", T.StringType()), T.StructField("_found", kind)])
    found = None
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        rows = texts.mapInArrow(_scanner(sent, "_text", schema), schema).where(F.size("_found") > 0)
        rows = store(rows.select(name, "_found").dropDuplicates([name]), "overlaps")
        sent.unpersist()
        found, block, another = rows if found is None else found.union(rows), another, next(blocks, None)
    found = found.groupBy(name).agg(F.flatten(F.collect_list("_found")).alias("_found"))
    joined = df.join(found, F.md5(df[text_col]) == found[name], "left")
    return joined.select(*(df[c] for c in df.columns), F.coalesce(found["_found"], F.array().cast(kind)).alias(result))


def _scanner(sent, text_col: str, schema: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, memo = sent.value, Memo(MEMO_ENTRIES, _hashes)
        kind = to_arrow_type(schema.fields[-1].dataType)
        for batch in slices(batches, text_col):
            split = [words_of(t) for t in texts_of(batch, text_col)]
            get = memo.over(set().union(*split)).__getitem__
            sizes = [len(w) for w in split]
            h = np.fromiter((x for w in split for x in map(get, w)), np.uint64, sum(sizes))
            owner = np.repeat(np.arange(len(split)), sizes)[h != 0]
            held: list[list] = [[] for _ in split]
            for i, found in block.overlaps(h[h != 0], np.searchsorted(owner, np.arange(len(split)), "right")):
                held[i].append(dict(zip(("item_id", "doc_start", "item_start", "length", "matches"), found, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, kind)], names=schema.names)

    return run
