"""Repeated passages, found with suffix automata of reference shards.

A window is WINDOW consecutive words. First every document names the least hash
of short word runs in each of its windows; equal windows name equal hashes, so
only windows whose hash is named by two documents can repeat. The stretches
around such windows, each distinct one once with the smallest id that holds it,
are dealt out by that hash. The task that owns a shard goes through them in the
order of their ids: a stretch is streamed through the suffix automata of the
stretches before it, and its matching statistics (the longest match that ends
at each word) tell which of its windows have begun in an earlier document.
A stretch that is equal to one of a smaller id is not streamed again: it shares
the row of the distinct stretch, and all of its windows repeat.

Where very many distinct stretches carry one name (a passage that documents hold
between words of their own), they are cut first to the windows whose hash occurs
under two ids. What is left of them is what they share, so it is few distinct
stretches again, and no task gathers one for each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import Memo, field, slices, store, texts_of

WINDOW = 50
#: Words in the runs whose hashes stand for windows.
RUN = 18
#: Words of reference text in one automaton.
SHARD_WORDS = 200_000
#: Distinct stretches of one name beyond which they are cut to windows that repeat. It changes what is compared, not what is found.
HOT_STRETCHES = 1000
MEMO_ENTRIES = 600_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(w) for w in words]


def window_names(h: np.ndarray, sizes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts end to end (h: hashes of words): the places where windows start, and each window's least run hash."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    r = np.zeros(len(h) - run + 1, np.uint64)
    for k in range(run):
        r = r * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(r)]
    r ^= r >> np.uint64(31)
    r *= np.uint64(0xD6E8FEB86659FD93)
    r ^= r >> np.uint64(32)
    width, span, least = window - run + 1, 1, r
    while 2 * span <= width:
        least, span = np.minimum(least[: len(least) - span], least[span:]), 2 * span
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    ends = np.repeat(np.cumsum(sizes), sizes)
    inside = np.flatnonzero(np.arange(n) + window <= ends[:n])
    return inside, least[inside].view(np.int64)


class SuffixAutomaton:
    """Of word sequences that are added one after the other; states keep dicts, as words are many."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.words = [-1], [0], 0

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        self.words += len(words)
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q  # this prefix is there already
                continue
            if q is not None:
                last = self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def matching_statistics(self, words: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest run ending there that occurs in what was added."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            yield matched


class Reference:
    """The stretches seen so far of one hash, in automata of bounded size."""

    def __init__(self, window: int):
        self.window, self.shards = window, [SuffixAutomaton()]

    def known(self, words: list[bytes]) -> list[int]:
        """Starts of windows of `words` that occur in an earlier stretch."""
        starts: set[int] = set()
        for shard in self.shards:
            if shard.words:
                starts.update(end + 1 - self.window for end, n in enumerate(shard.matching_statistics(words)) if n >= self.window)
        return sorted(starts)

    def add(self, words: list[bytes]) -> None:
        if self.shards[-1].words > SHARD_WORDS:
            self.shards.append(SuffixAutomaton())
        self.shards[-1].add(words)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], np.ndarray, np.ndarray]]:
    memo = Memo(MEMO_ENTRIES, word_hashes)
    for batch in slices(batches, "_text"):
        split = [words_of(t) for t in texts_of(batch, "_text")]
        get = memo.over(set().union(*split)).__getitem__
        sizes = np.array([len(w) for w in split], np.int64)
        yield batch, split, np.fromiter(map(get, chain.from_iterable(split)), np.uint64, int(sizes.sum())), sizes


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """Values as one list a row; `owner` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.array(values))


def _digest(words: list[bytes]) -> tuple[str, str]:
    text = b" ".join(words)
    return text.decode("utf-8", "surrogatepass"), hashlib.sha256(text).hexdigest()


def remove_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, `n_words`, `n_removed` (long), `kept_sha256`, `spans` (array of start and length in words of what
    went, maximal) and `kept_text` (null where nothing went) of each row.

    A word goes if a window of `window` words that covers it also starts in a
    row with a smaller id; windows are judged on the input. Words are runs of
    anything but ASCII white space, unchanged. Null and empty texts have no
    words. A null id is neither smaller nor larger than any, so such rows stay whole and
    remove nothing. Rows that repeat an id don't remove from one another. Other
    columns are left out; an empty table gives an empty table.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    binary, long = T.BinaryType(), T.LongType()
    key = field(df, id_col, "_id")
    # an id and its text's hash name a row; rows that agree in both have the same result
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_row"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, split, h, sizes in _hash_batches(batches):
            place, name = window_names(h, sizes, window, RUN)
            owner = np.repeat(np.arange(len(split)), sizes)[place]
            order = np.lexsort([name, owner])
            first = np.r_[True, (np.diff(owner[order]) != 0) | (np.diff(name[order]) != 0)][: len(order)]
            order = order[first]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(digests), _lists(owner[order], name[order], len(split))], names=["_id", "_row", "n_words", "_sha", "_names"])

    base = store(rows.mapInArrow(read, T.StructType([key, T.StructField("_row", long), T.StructField("n_words", long), T.StructField("_sha", T.StringType()), T.StructField("_names", T.ArrayType(long))])), "names")
    named = base.where("_id is not null").select("_id", "_row", F.explode("_names").alias("_name"))
    shared = named.groupBy("_name").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a < _b").select("_name")
    suspects = named.join(shared, "_name").groupBy("_id", "_row").agg(F.collect_set("_name").alias("_names"))
    # from here on only documents with a hash that another one names too, each distinct row once
    suspect = store(rows.join(suspects, ["_id", "_row"]).dropDuplicates(["_id", "_row"]).select("_id", "_text", "_row", "_names"), "suspects")
    columns = ["_id", "_row", "_start", "_name", "_key", "_n", "_words"]

    def stretches(ids: pa.Array, rows: pa.Array, out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """(place in the batch, start, name, words) of each stretch as a batch; equal words have equal keys and compressed bytes."""
        row, start, names, texts = zip(*out, strict=True)
        count = [t.count(b" ") + 1 for t in texts]
        made = [pa.array(start, pa.int64()), pa.array(names, pa.int64()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array(count, pa.int64()), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), rows.take(pa.array(row)), *made], names=columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that follow one another under one suspect name are a stretch."""
        for batch, split, h, sizes in _hash_batches(batches):
            place, name = window_names(h, sizes, window, RUN)
            edge = np.searchsorted(np.repeat(np.arange(len(split)), sizes)[place], np.arange(len(split) + 1))
            start, wanted = np.cumsum(sizes) - sizes, batch.column(3).to_pylist()
            out: list[tuple] = []
            for i, words in enumerate(split):
                own, at = name[edge[i] : edge[i + 1]], place[edge[i] : edge[i + 1]] - start[i]
                hit = np.flatnonzero(np.isin(own, np.array(wanted[i], np.int64)))
                if len(hit):
                    run = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)])
                    for a, b in zip(hit[run], [*(hit[run[1:] - 1]), hit[-1]], strict=True):
                        s, e = int(at[a]), int(at[b]) + window
                        out.append((i, s, int(own[a]), b" ".join(words[s:e])))
            if out:
                yield stretches(batch.column(0), batch.column(2), out)

    kinds = [key, *(T.StructField(c, binary if c in ("_key", "_words") else long) for c in columns[1:])]
    members = store(suspect.mapInArrow(find, T.StructType(kinds)), "stretches")
    hot = store(members.groupBy("_name").agg(F.count_distinct("_key").alias("_n")).where(F.col("_n") > HOT_STRETCHES).select("_name"), "hot")
    crowd = members.join(hot, "_name", "left_semi")
    crowded = store(crowd.groupBy("_name", "_key", "_words").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")), "crowded")

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window's place in its stretch and hash."""
        for batch in batches:
            split = [zlib.decompress(w).split(b" ") for w in batch.column(4).to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            h = np.array(word_hashes(list(chain.from_iterable(split))), np.uint64)
            place, w = window_names(h, sizes, window, window)
            owner = np.repeat(np.arange(len(split)), sizes)[place]
            at = place - (np.cumsum(sizes) - sizes)[owner]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner)) for c in batch.columns[:4]), pa.array(at), pa.array(w)], names=["_name", "_key", "_least", "_most", "_at", "_w"])

    marks = [T.StructField("_name", long), T.StructField("_key", binary)]
    ids = [field(df, id_col, c) for c in ("_least", "_most")]
    each = crowded.select("_name", "_key", "_least", "_most", "_words").mapInArrow(windows_of, T.StructType([*marks, *ids, T.StructField("_at", long), T.StructField("_w", long)]))
    twice = each.groupBy("_name", "_w").agg(F.min("_least").alias("_a"), F.max("_most").alias("_b")).where("_a < _b").select("_name", "_w")
    left = each.join(twice, ["_name", "_w"]).groupBy("_name", "_key").agg(F.collect_set("_at").alias("_at"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stretch the runs of windows that repeat."""
        for batch in batches:
            row, start, parts = [], [], []
            for i, (text, at) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                words, at = zlib.decompress(text).split(b" "), np.sort(np.array(at, np.int64))
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    row.append(i)
                    start.append(int(run[0]))
                    parts.append(words[run[0] : run[-1] + window])
            texts = [b" ".join(w) for w in parts]
            made = [pa.array(start, pa.int64()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([len(w) for w in parts], pa.int64()), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns[:3]), *made], names=[*names, "_from", "_part", "_length", "_words"])

    names = ["_name", "_key", "_least"]
    more = [T.StructField("_from", long), T.StructField("_part", binary), T.StructField("_length", long), T.StructField("_words", binary)]
    short = store(crowded.join(left, ["_name", "_key"]).select(*names, "_words", "_at").mapInArrow(shorten, T.StructType([*marks, ids[0], *more])), "shortened")
    calm = members.join(hot, "_name", "left_anti")
    crowd = crowd.drop("_words").join(short.drop("_words", "_least"), ["_name", "_key"])
    crowd = crowd.select("_id", "_row", (F.col("_start") + F.col("_from")).alias("_start"), "_name", F.col("_part").alias("_key"), F.col("_length").alias("_n"))
    pieces = calm.select("_name", "_key", "_words", F.col("_id").alias("_least")).union(short.select("_name", F.col("_part").alias("_key"), "_words", "_least"))
    pieces = pieces.groupBy("_name", "_key", "_words").agg(F.min("_least").alias("_least"))
    shards = pieces.repartition("_name").sortWithinPartitions("_name", "_least")
    members = calm.select(*columns[:6]).union(crowd)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reference, waiting, least = None, Reference(window), [], None
        for batch in batches:
            names, texts, leasts, starts = *(batch.column(k).to_pylist() for k in (0, 2, 3)), []
            for name, text, one in zip(names, texts, leasts, strict=True):
                words = zlib.decompress(text).split(b" ")
                if name != current:
                    current, reference, waiting, least = name, Reference(window), [], one
                if one != least:  # stretches of one id don't count against one another
                    for w in waiting:
                        reference.add(w)
                    waiting, least = [], one
                starts.append(reference.known(words))
                waiting.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(starts, pa.list_(pa.int64()))], names=["_name", "_key", "_least", "_known"])

    judged = shards.select("_name", "_key", "_words", "_least").mapInArrow(
        search, T.StructType([T.StructField("_name", long), T.StructField("_key", binary), field(df, id_col, "_least"), T.StructField("_known", T.ArrayType(long))])
    )
    # a stretch that a smaller id holds repeats whole; for the smallest id itself, only the windows found
    joined = members.join(judged, ["_name", "_key"])
    whole = F.col("_id") > F.col("_least")
    windows = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("_n") - window).cast("long").alias("b")))).otherwise(F.transform("_known", lambda k: F.struct(k.alias("a"), k.alias("b"))))
    covered = joined.select("_id", "_row", "_start", F.explode(windows).alias("_w")).select("_id", "_row", (F.col("_start") + F.col("_w.a")).alias("a"), (F.col("_start") + F.col("_w.b") + window).alias("b"))
    covered = covered.groupBy("_id", "_row").agg(F.collect_set(F.struct("a", "b")).alias("_covered"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for text, ranges in zip(texts_of(batch, "_text"), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                step = np.zeros(len(words) + 1, np.int64)
                for r in ranges:
                    step[r["a"]] += 1
                    step[r["b"]] -= 1
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                kept, sha = _digest([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((int(gone.sum()), sha, [{"start": int(a), "length": int(b - a)} for a, b in edge.reshape(-1, 2)], kept))
            made = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["_id", "_row", "_removed", "_kept_sha", "spans", "kept_text"])

    texts = suspect.join(covered, ["_id", "_row"]).select("_id", "_text", "_covered", "_row")
    names = [key, T.StructField("_row", long), T.StructField("_removed", long), T.StructField("_kept_sha", T.StringType()), T.StructField("spans", span), T.StructField("kept_text", T.StringType())]
    changed = texts.mapInArrow(remove, T.StructType(names))
    out = base.select("_id", "_row", "n_words", "_sha").join(changed, ["_id", "_row"], "left")
    removed, sha = F.coalesce("_removed", F.lit(0)).cast("long"), F.coalesce("_kept_sha", "_sha")
    return out.select(F.col("_id").alias(id_col), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), F.coalesce("spans", F.array().cast(span)).alias("spans"), "kept_text")


#: DuckDB: what the substring-dedup query returns.
SQL = """
    WITH split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
    ), windows AS (
        SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split WHERE len(w) >= 50)
    ), least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h
    ), hit AS (
        SELECT DISTINCT doc_id, p + k AS place
        FROM (SELECT n.doc_id, n.p FROM windows n JOIN least l ON n.h = l.h AND l.first < n.doc_id), range(0, 50) r(k)
    ), gone AS (SELECT doc_id, list(place) AS places, count(*)::BIGINT AS n FROM hit GROUP BY doc_id)
    SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN g.n IS NULL THEN s.w ELSE
               list_filter(s.w, lambda x, i: NOT list_contains(g.places, i)) END, ' ')) AS kept_sha256
    FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id
"""
