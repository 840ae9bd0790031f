"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than
capacity/(k+1) and at most capacity/k, and a bin of class k takes exactly k of
them. Documents may be cut, so a tail that would fill its place badly is cut at
the next lower reciprocal. Every task packs its own rows; no row moves.
"""

from __future__ import annotations

import functools
import os
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import Memo, field, slices

MEMO_ENTRIES = 600_000
#: Pieces this short go whole into their class: the loss is below one token in sixteen of a short piece.
SHORT = 64
#: Words encoded in one call.
CALL = 200


class Encoder:
    """Ids of texts as little-endian uint32 bytes, from a byte-level BPE file of `tokenizers`.

    Its pre-tokeniser joins a space only with what follows and leaves a single
    line end by itself, so texts are cut there. Arrow numbers the distinct words
    of a batch, the library encodes those a bounded memo doesn't hold, and the
    ids of all words are then gathered from one flat array.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives this task one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.normalizer or type(self.tokenizer.pre_tokenizer) is not pre_tokenizers.ByteLevel:
            raise ValueError("texts can be cut at spaces for byte-level files without normaliser only")
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.leads[[i for s, i in self.tokenizer.get_vocab().items() if s[0] == space]] = True
        self.line_end = self._ids(["\n"])[0]
        self.heads = Memo(MEMO_ENTRIES // 4, self._line_heads)
        self.rests = Memo(MEMO_ENTRIES, self._spaced)
        self.ends = Memo(MEMO_ENTRIES // 4, self._ids)

    def __call__(self, texts: pa.Array | list) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        texts = pa.compute.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        lines = pa.compute.split_pattern(texts, "\n")
        words = pa.compute.split_pattern(lines.flatten(), " ")
        line_of, word_of = lines.offsets.to_numpy(), words.offsets.to_numpy()
        head = np.zeros(word_of[-1], bool)
        head[word_of[:-1]] = True
        # a line's first word has the line end before it; that of the text's first line is taken off again
        flat, size, run, known = [], [], np.empty(len(head), np.int64), 0
        for mine, memo in ((head, self.heads), (~head, self.rests)):
            found = words.flatten().filter(pa.array(mine)).dictionary_encode()
            ids, sizes = self._runs(found.dictionary, memo)
            run[mine] = found.indices.to_numpy() + known
            flat.append(ids)
            size.append(sizes)
            known += len(sizes)
        flat, size = np.concatenate(flat), np.concatenate(size)
        whole = size[run] < 0  # words beside more white space
        size = np.maximum(size, 0)
        start_of = word_of[line_of]
        alone = np.add.reduceat(np.r_[whole, False], start_of[:-1]) > 0 if len(texts) else np.empty(0, bool)
        for s in self.special:
            alone |= pa.compute.match_substring(texts, s).to_numpy(zero_copy_only=False)
        first, n = (np.cumsum(size) - size)[run], size[run]
        skip = np.zeros(len(n), np.int64)
        skip[start_of[:-1]] = np.minimum(len(self.line_end) // 4, n[start_of[:-1]])
        first, n = first + skip, n - skip
        ends = np.r_[0, np.cumsum(n)]
        ids = _gather(flat, first, n).tobytes()
        bounds = (4 * ends[start_of]).tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        at = np.flatnonzero(alone)
        for i, got in zip(at.tolist(), self._ids(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = got
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end and their number for each, -1 for a word that can't be taken by itself. The
        pre-tokeniser parts letters from punctuation behind them, so the two are looked up on their own."""
        core = pa.compute.utf8_rtrim(words, string.punctuation)
        core = pa.compute.if_else(pa.compute.utf8_is_alpha(core), core, words)
        flat, size, first = [], [], []
        for part, m in ((core, memo), (_behind(words, core), self.ends)):
            found = part.dictionary_encode()
            distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            runs = list(map(m.over(set(distinct)).__getitem__, distinct))
            sizes = np.array([-1 if r is None else len(r) // 4 for r in runs], np.int64)
            at = found.indices.to_numpy()
            size.append(sizes[at])
            sizes = np.maximum(sizes, 0)
            first.append((np.cumsum(sizes) - sizes)[at] + sum(map(len, flat)))
            flat.append(np.frombuffer(b"".join(r for r in runs if r), "<u4"))
        size, first = np.stack(size, 1), np.stack(first, 1)
        return _gather(np.concatenate(flat), first.ravel(), np.maximum(size, 0).ravel()), np.where(size[:, 0] < 0, -1, size.sum(1))

    def _spaced(self, words: list[str]) -> list[bytes | None]:
        """Each word with the space before it; a token that opens with a space opens a word."""
        return self._together(words, " ", lambda ids: self.leads[ids])

    def _line_heads(self, words: list[str]) -> list[bytes | None]:
        """Each word with the line end before it."""
        end = int(np.frombuffer(self.line_end, "<u4")[0])
        return self._together(words, "\n", lambda ids: ids == end)

    def _together(self, words: list[str], before: str, opens: Callable) -> list[bytes | None]:
        """Ids of each word, many in one call; None for a word that is empty or has white space at an end."""
        good = [w for w in words if w and not (w[0].isspace() or w[-1].isspace())]
        found: dict[str, bytes] = {}
        for k in range(0, len(good), CALL):
            part = good[k : k + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * np.flatnonzero(opens(ids))).tolist()
            ids = ids.tobytes()
            for w, a, b in zip(part, at, [*at[1:], len(ids)], strict=True):
                found[w] = ids[a:b]
        return [found.get(w) for w in words]


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of `n` values of `flat` that begin at `first`, end to end."""
    ends = np.cumsum(n)
    return flat[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _behind(words: pa.Array, core: pa.Array) -> pa.Array:
    """What follows in each word behind its `core`."""
    size, taken = (pa.compute.binary_length(x).to_numpy() for x in (words, core))
    offsets = np.r_[0, np.cumsum(size - taken)].astype(np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(_gather(data, start + taken, size - taken)))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker: Spark reuses workers, so the words known from one task serve the next."""
    return Encoder(path)


def tail_lengths(rest: int, capacity: int) -> list[int]:
    """Cut a tail of fewer than `capacity` tokens at reciprocals until what is left fits its class well."""
    out = []
    while rest:
        k = capacity // rest
        place = capacity // k
        if rest <= SHORT or place - rest <= place >> 6:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def _powers(total: int) -> list[int]:
    return [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]


class Bins:
    """Open bins of one task; a closed bin is a list of pieces (id, start, ids, tokens of the document)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, key, ids: bytes) -> Iterator[list[tuple]]:
        n = len(ids) // 4
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(key, start, ids[4 * start : 4 * (start + self.capacity)], n)]
        start = whole
        for length in tail_lengths(n - whole, self.capacity):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((key, start, ids[4 * start : 4 * (start + length)], n))
            start += length
            if len(bin_) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list[tuple]]:
        """What is left in part-filled bins, laid end to end: full sequences, then powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.capacity] * (total // self.capacity) + _powers(total % self.capacity)
        pieces.reverse()
        for size in sizes:
            out = []
            while size:
                key, start, ids, n = pieces.pop()
                if len(ids) // 4 > size:
                    pieces.append((key, start + size, ids[4 * size :], n))
                    ids = ids[: 4 * size]
                out.append((key, start, ids, n))
                size -= len(ids) // 4
            yield out


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, `start` (ids of its document before it), `length`, `ids`
    (binary, little-endian uint32), `doc_tokens` (with the end id), `sequence_id`, `offset`
    in its sequence and `padded_length` of the sequence.

    A document is the ids of its whole text, then `end_id`; null and empty texts
    are `end_id` alone. Each id lies in exactly one piece. Sequences hold at most
    `capacity` ids and are padded to it unless their length is a power of two.
    Null ids are carried along, repeated rows are packed each, other columns
    are left out, and an empty table gives an empty table. `sequence_id` is
    the task's number times 2**33 plus a count, so tasks need not agree on anything.
    """
    long = T.LongType()
    schema = T.StructType([field(df, id_col)] + [T.StructField(c, T.BinaryType() if c == "ids" else long) for c in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length")])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer_path), Bins(capacity)
        sequence = TaskContext.get().partitionId() << 33
        key_type = None

        def rows(closed: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for bin_ in closed:
                offset, total = 0, sum(len(p[2]) // 4 for p in bin_)
                padded = total if total & (total - 1) == 0 else capacity
                for key, start, ids, n in bin_:
                    out.append((key, start, len(ids) // 4, ids, n, sequence, offset, padded))
                    offset += len(ids) // 4
                sequence += 1
            columns = list(zip(*out, strict=True))
            kinds = [key_type] + [pa.binary() if c == "ids" else pa.int64() for c in schema.names[1:]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in slices(batches, "_text"):
            key_type = batch.column(0).type
            closed = [b for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True) for b in bins.add(key, ids + end)]
            if closed:
                yield rows(closed)
        if closed := list(bins.close()):
            yield rows(closed)

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
