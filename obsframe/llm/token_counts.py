"""Token counts of a piece model by rank-synchronous array merging.

Texts are cut into pre-tokens at spaces (no piece holds a space mark behind
another character, so no merge crosses such a cut). The distinct pre-tokens of
a batch are held as one ragged numpy array; in each round every sequence merges
all places of its lowest-ranked pair at once. A bounded memo keeps the counts
of pre-tokens already seen by this worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import Memo, field, slices, texts_of

MEMO_ENTRIES = 600_000
MARK = "▁"
_NONE = np.int32(2**31 - 1)


class PieceTable:
    """Symbols, merge ranks and costs read from a sentencepiece BPE model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in piece):
            raise ValueError("a piece holds a space behind another character; texts can't be cut at spaces")
        # symbols 0..3 stand for characters outside every piece, by their UTF-8 length
        names = [*piece, *sorted({c for p in piece for c in p if c not in piece})]
        symbol = {p: k + 4 for k, p in enumerate(names)}
        self.cost = np.array([1, 2, 3, 4] + [1 if p in piece else len(p.encode()) for p in names], np.int64)
        if not any(sp.is_byte(i) for i in range(size)):
            self.cost[:] = 1  # without byte pieces an unknown character is one token
        self.of_char = np.repeat(np.array([0, 1, 2, 3], np.int32), [0x80, 0x780, 0xF800, 0x100000])
        for p in names:
            if len(p) == 1:
                self.of_char[ord(p)] = symbol[p]
        scores = np.unique(np.array([-s for s in piece.values()]))
        keys, ranks, merged = [], [], []
        for p, score in piece.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    ranks.append(int(np.searchsorted(scores, -score)))
                    merged.append(symbol[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[order], _NONE)
        self.merged = np.append(np.array(merged, np.int32)[order], np.int32(0))
        # ranks that several pieces share: there the leftmost pair goes first, one at a time
        values, times = np.unique([-s for s in piece.values()], return_counts=True)
        self.shared = times > 1

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], 0)

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word, every word a sequence of its own (none is empty)."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_char[code]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        total = np.zeros(len(words), np.int64)
        rank, into = self._pairs(sym, owner)
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(sym)])
            low = np.minimum.reduceat(rank, start)
            done = low == _NONE
            if done.any():
                gone = np.repeat(done, length)
                total += np.bincount(owner[gone], self.cost[sym[gone]], len(words)).astype(np.int64)
                stay = ~gone
                sym, owner, rank, into = sym[stay], owner[stay], rank[stay], into[stay]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(low, length))
            if self.shared[low].any():
                first = np.r_[True, owner[pick[1:]] != owner[pick[:-1]]]
                pick = pick[first | ~self.shared[rank[pick]]]
            # of pairs that overlap ("aaa"), every second one from the left
            fresh = np.r_[True, pick[1:] != pick[:-1] + 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(pick)), 0))
            pick = pick[(np.arange(len(pick)) - run) % 2 == 0]
            sym[pick] = into[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            new = np.cumsum(keep)[pick] - 1
            sym, owner, rank, into = sym[keep], owner[keep], rank[keep], into[keep]
            stale = np.unique(np.r_[new, new[new > 0] - 1])
            rank[stale], into[stale] = self._pairs(sym, owner, stale)
        return total

    def _pairs(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, len(sym) - 1)
        rank, into = self.look_up(sym[at], sym[after])
        alone = (owner[after] != owner[at]) | (after == at)
        rank[alone] = _NONE
        return rank, into


def pre_tokens(text: str) -> list[str]:
    """Pieces of `text` between which nothing merges, without their leading space mark
    where exactly one space leads."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        # runs of spaces stay with the word behind them
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
    return text.split(" ")


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, `n_bytes` (UTF-8) and `n_tokens`, both long.

    `model_path`: a sentencepiece BPE model with identity normalisation. Null
    and empty texts have 0 bytes and 0 tokens; a null id is carried along;
    repeated rows are each counted; texts of any length are counted whole;
    other columns are left out. An empty table gives an empty table.
    """
    schema = T.StructType([field(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(model_path)
        memo = Memo(MEMO_ENTRIES, lambda words: table.count([MARK + w for w in words]).tolist())
        for batch in slices(batches, "_text"):
            split = [pre_tokens(t) for t in texts_of(batch, "_text")]
            get = memo.over(set().union(*split)).__getitem__
            counts = [sum(map(get, words)) for words in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    return rows.mapInArrow(count, schema)
