"""SimHash fingerprints and their links, searched in BK-trees.

Fingerprints within the radius agree exactly on two of radius + 2 blocks of
bits. Each choice of two blocks with their bits names a shard; every distinct
fingerprint goes to its shards, and the task that owns a shard puts its
fingerprints into a BK-tree (children keyed by their Hamming distance to the
parent) and follows only edges within the radius. Trees of the whole corpus
grow with it, so they are dealt out by key instead of broadcast. Crowded shards
are dealt anew: fingerprints within the radius also agree on three of radius + 3
blocks, on four of radius + 4 and so on, which name ever smaller shards.

`similar_texts` links by exact Jaccard similarity of the shingle sets instead:
shards are named by each set's least shingle hashes, and fingerprints of twice
the bits are searched in BK-trees there at a radius that similar sets are far
within. Sets that have a neighbour travel to their shards whole, and only a
pair that was compared whole and found similar joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import cut, field, remove, shared_path, slices, store, texts_of
from obsframe.llm.components import components

BITS = 64
#: Fingerprints of a shard that are searched in one tree, and agreeing blocks that name one, at most.
SHARD = 2000
MOST_AGREEING = 6
#: Of 128 bits, how many may differ in a pair that is compared whole. At a similarity of 0.8 about 19 (deviation 4) do, in unlike texts 64 (6).
SIEVE = 38
#: Least shingle hashes of a set that name its shards: one set in 0.2**5 of a similarity of 0.8 shares none of them.
KEYS = 5
#: Sets of fewer shingles are compared whatever their bits.
SIEVE_LEAST = 16


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of `words` words joined by a space, A-Z lower-cased, repeats included; all words where there are fewer."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]


def fingerprint(parts: list[bytes], seed: int = 42) -> int:
    """Signed 64 bits; a bit is 1 if it is set in over half of the parts' XXH64, and 0 for no parts."""
    from xxhash import xxh64_intdigest

    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), 1 << 16):
        h = np.array([xxh64_intdigest(p, seed) for p in parts[at : at + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `fingerprint` (long) of each row; null and empty texts have 0."""
    schema = T.StructType([field(df, id_col), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            prints = [fingerprint(shingles(t, words)) for t in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


class BKTree:
    """Integers by Hamming distance: a node is [value, {distance: child}]."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def near(self, value: int) -> list[int]:
        """Values held that are within the radius of `value`."""
        near, r = [], self.radius
        stack = [] if self.root is None else [self.root]
        while stack:
            other, children = stack.pop()
            d = (value ^ other).bit_count()
            if d <= r:
                near.append(other)
            if children:
                stack += [child for e, child in children.items() if d - r <= e <= d + r]
        return near

    def near_then_add(self, value: int) -> list[int]:
        """Values held so far within the radius of `value`, which is then put in."""
        near = self.near(value)
        if self.root is None:
            self.root = [value, {}]
            return near
        node = self.root
        while (d := (value ^ node[0]).bit_count()) in node[1]:
            node = node[1][d]
        node[1][d] = [value, {}]
        return near


def spanning_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what the full set of links among `values` (distinct) joins, one less than values at most."""
    tree, parent = BKTree(radius), {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        for other in tree.near_then_add(v):
            if (a := root(v)) != (b := root(other)):
                parent[a] = b
                yield v, other


def shard_keys(radius: int, agreeing: int = 2) -> list[Column]:
    """Of column `fingerprint`, for each choice of `agreeing` of radius + `agreeing` blocks: the choice, and its bits, in one long."""
    count = radius + agreeing
    edges = [round(k * BITS / count) for k in range(count + 1)]
    masks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(count)]
    # longs are signed in Spark
    chosen = (sum(masks[k] for k in choice) for choice in combinations(range(count), agreeing))
    return [F.xxhash64(F.lit(n), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m))) for n, m in enumerate(chosen)]


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct values of `fingerprint` that have the same components as all
    pairs within `radius` (1 to 14) bits. A value is held once however many rows share it.

    Members of shards that hold more than SHARD values meet again in shards named by one block more, up to MOST_AGREEING
    blocks; a shard that is crowded even then is searched as it is."""
    found, rest = None, prints.select("fingerprint")
    for agreeing in range(2, MOST_AGREEING + 1):
        rows = store(_searched(rest, radius, agreeing, SHARD if agreeing < MOST_AGREEING else None), "links")
        linked = rows.where("NOT crowded").select("a", "b")
        found = linked if found is None else found.union(linked)
        rest = rows.where("crowded").select(F.col("a").alias("fingerprint")).distinct()
        if rest.isEmpty():
            break
    return found


def _searched(prints: DataFrame, radius: int, agreeing: int, limit: int | None) -> DataFrame:
    """(a, b, crowded): the links that a BK-tree finds in each shard of up to `limit` values, and (value, value, true) for each
    value of the others. A task holds `limit` values of one shard at most."""
    kinds = [pa.int64(), pa.int64(), pa.bool_()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, crowded = None, [], False

        def rows(linked: list[tuple[int, int]], full: list[int]) -> pa.RecordBatch:
            a, b = (np.array([p[k] for p in linked] + full, np.uint64).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, np.arange(len(a)) >= len(linked)), kinds, strict=True)], names=["a", "b", "crowded"])

        for batch in batches:
            key, value = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            linked, full = [], []
            # values alone in a shard link nothing; the first and the last shard may go on in other batches
            several = np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == 0) | (np.arange(len(edges) - 1) == len(edges) - 2)) if len(key) else []
            for g in several:
                if key[edges[g]] != current:
                    linked += spanning_links(held, radius)
                    current, held, crowded = key[edges[g]], [], False
                held += value[edges[g] : edges[g + 1]].tolist()
                if limit and (crowded or len(held) > limit):
                    full += held
                    held, crowded = [], True
            yield rows(linked, full)
        yield rows(list(spanning_links(held, radius)), [])

    shards = prints.select("fingerprint", F.explode(F.array(*shard_keys(radius, agreeing))).alias("key"))
    return shards.repartition("key").sortWithinPartitions("key", "fingerprint").select("key", "fingerprint").mapInArrow(search, "a long, b long, crowded boolean")


def near_duplicates(df: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, `fingerprint` (long) and `component_id`, the smallest id in
    the component of links (fingerprints that differ in at most `radius` bits).

    Texts without words have fingerprint 0 and link like any other. Rows with
    the same fingerprint are one component, repeated rows too; each keeps its
    row. Null ids never name a component that has another id. Other columns
    are left out; an empty table gives an empty table.
    """
    prints = cut(fingerprints(df, words, id_col, text_col))
    nodes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("_least"))
    roots = components(cut(links(nodes.select("fingerprint"), radius)))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = cut(rooted.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "_least"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def _hashes(text: str, words: int) -> np.ndarray:
    """The sorted XXH64 of the set of shingles."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(p, 42) for p in set(shingles(text, words))], np.uint64))


def _sketch(h: np.ndarray, similarity: float, keys: int | None) -> tuple[int, int, int, int, list[int]]:
    """Of a set of shingle hashes: its name (0 if empty), size, 128 bits as two longs, and its least hashes, `keys` at
    most; any set that is as similar shares one of the first 1 - `similarity`, and likely one of so few."""
    from xxhash import xxh64_intdigest

    if not len(h):
        return 0, 0, 0, 0, []
    halves = []
    for k in (h, (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)):
        ones = sum(np.unpackbits(k[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for at in range(0, len(k), 1 << 16))
        halves.append(int(np.packbits(2 * ones > len(k)).view(np.int64)[0]))
    name = np.array([xxh64_intdigest(h.tobytes()) | 1], np.uint64).view(np.int64)
    needed = len(h) - ceil(similarity * len(h) - 1e-9) + 1
    return int(name[0]), len(h), *halves, h.view(np.int64)[: needed if keys is None else min(keys, needed)].tolist()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches by equal first column, a group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in pairwise(edges):
            if b > a:
                if held and held[0].column(0)[0].as_py() != key[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Neighbours:
    """The sets of a shard, of which each asks those before it that may be similar: any of a fitting size if small, or else
    those that a BK-tree finds within `sieve` bits (None: any). Sets come by rising size."""

    def __init__(self, sizes: list[int], one: np.ndarray, two: np.ndarray, similarity: float, sieve: int | None):
        self.sizes, self.similarity, self.sieve = sizes, similarity, sieve
        self.prints = [x << 64 | y for x, y in zip(one.view(np.uint64).tolist(), two.view(np.uint64).tolist(), strict=True)]
        self.tree, self.holders = BKTree(sieve or 0), {}

    def of(self, at: int) -> list[int]:
        """The places of those that `at` asks, the likeliest first; it is then among the others."""
        size, v = self.sizes[at], self.prints[at]
        least = self.similarity * size - 1e-9
        if self.sieve is None or self.similarity * size < SIEVE_LEAST:
            first = at
            while first and self.sizes[first - 1] >= least:
                first -= 1
            found = list(range(first, at))
        else:
            near = self.tree.near(v)
            found = [m for u in near for m in self.holders[u] if self.sizes[m] >= least]
        if self.sieve is not None:
            if v not in self.holders:
                self.tree.near_then_add(v)
            self.holders.setdefault(v, []).append(at)
        return sorted(found, key=lambda m: (self.prints[m] ^ v).bit_count())


def _with_neighbours(shard: pa.Table, similarity: float, sieve: int | None) -> np.ndarray:
    """Which sets (key, size, name, one, two) of a shard have another there that may be similar."""
    asked = np.zeros(shard.num_rows, bool)
    if len(asked) > 1:
        near = Neighbours(shard.column(1).to_pylist(), shard.column(3).to_numpy(), shard.column(4).to_numpy(), similarity, sieve)
        for at in range(len(asked)):
            found = near.of(at)
            asked[found] = True
            asked[at] |= bool(found)
    return asked


def similar_links(shard: pa.Table, similarity: float, sieve: int | None) -> Iterator[tuple[int, int]]:
    """Links of names that join what all similar pairs of a shard's sets (key, size, name, one, two, set) join, as far as they
    are neighbours; fewer than the shard has sets. Sets are compared whole before they are joined."""
    names = shard.column(2).to_pylist()
    near = Neighbours(shard.column(1).to_pylist(), shard.column(3).to_numpy(), shard.column(4).to_numpy(), similarity, sieve)
    whole = [np.frombuffer(x, np.uint64) for x in shard.column(5).to_pylist()]
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for at in range(len(names)):
        for m in near.of(at):
            if (x := root(at)) != (y := root(m)):
                a, b = whole[m], whole[at]
                places = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[places] == a).sum())
                if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                    parent[x] = y
                    yield names[m], names[at]


def similar_texts(df: DataFrame, words: int = 5, similarity: float = 0.8, keys: int | None = KEYS, sieve: int | None = SIEVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and `component_id`, the smallest id in the component of links
    between texts whose sets of shingles have a Jaccard similarity of at least `similarity`.

    Each of a set's `keys` least hashes names a shard. Sets that have a neighbour there, by a BK-tree
    over their fingerprints, go to it as sorted hashes, and a pair is linked once its sets were compared whole; pairs
    that linked sets have joined before are passed over, so a large group of copies gives few links. No link is wrong,
    and one is missed only if its sets share none of their least hashes (1 in 3,000 at a similarity of 0.8) or
    differ in more than `sieve` of 128 bits (1 in 10^5); with `keys` and `sieve` None none is, at the price of a
    fifth of all shingles as keys.
    Texts without words are one component. Null ids never name a component that has
    another id. Other columns are left out; an empty table gives an empty table.
    """
    schema = T.StructType([field(df, id_col), *(T.StructField(c, T.LongType()) for c in ("_hash", "name", "size", "one", "two")), T.StructField("least", T.ArrayType(T.LongType()))])
    texts = df.select(F.col(id_col), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = zip(*(_sketch(_hashes(t, words), similarity, keys) for t in texts_of(batch, "_text")), strict=True)
            columns = [pa.array(c, f.type) for c, f in zip(rows, pa.schema([(c, pa.int64()) for c in "abcd"] + [("e", pa.list_(pa.int64()))]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _groups(batches):
            for batch in shard.filter(pa.array(_with_neighbours(shard, similarity, sieve))).combine_chunks().to_batches():
                yield batch

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hashes(t, words).tobytes() for t in texts_of(batch, "_text")], pa.binary())], names=["name", "set"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _groups(batches):
            pairs = np.array(list(similar_links(shard, similarity, sieve)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = lambda rows, *more: rows.repartition("key").sortWithinPartitions("key", "size", "one", "name").select("key", "size", "name", "one", "two", *more)
    spark = df.sparkSession
    sketches, folder = store(texts.mapInArrow(sketch, schema), "sketches"), shared_path(spark, "similar")
    try:
        nodes = store(sketches.groupBy("name").agg(F.min(id_col).alias("_least"), *(F.first(c).alias(c) for c in ("size", "one", "two", "least", "_hash"))), "nodes", folder)
        shards = dealt(nodes.select(F.explode("least").alias("key"), "size", "name", "one", "two"))
        asked = store(shards.mapInArrow(ask, "key long, size long, name long, one long, two long"), "asked", folder)
        # one text for each set that has a neighbour: texts that share a hash of 64 bits but not the set don't agree on the name
        wanted = nodes.join(asked.select("name").distinct(), "name").select("name", "_hash")
        one = texts.join(wanted, "_hash").groupBy("name").agg(F.min("_text").alias("_text"))
        # written on their own, so that the shuffle of the texts goes before that of the sets begins
        sets = store(one.mapInArrow(spell, "name long, set binary"), "sets", folder)
        links = store(dealt(asked.join(sets, "name"), "set").mapInArrow(link, "a long, b long").distinct(), "links", folder)
        roots = components(links).withColumnRenamed("node", "name")
        rooted = store(nodes.select("name", "_least").join(roots, "name", "left").select("name", F.coalesce("root", "name").alias("root"), "_least"), "rooted")
    finally:
        remove(spark, folder)
    named = rooted.join(rooted.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("name", "component_id")
    return sketches.select(id_col, "name").join(named, "name").select(id_col, "component_id")
