"""A Merkle manifest of a dataset, its trees kept in van Emde Boas layout.

Rows are leaves of one tree a group; the groups' roots are the leaves of one tree
above them. A tree is cut into aligned subtrees of HEIGHT levels above their leaves.
Each is one row of a stored table: an array of digests laid out by splitting the
subtree at half its height, top first, again and again, so that a walk from leaf to
root touches few blocks of any size. Where a node lies is arithmetic on its depth
and index, both when the array is filled and when siblings are read from it. The
subtrees' roots are the leaves of the next round of subtrees, until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import field, store

#: Levels of a stored subtree above its leaves.
HEIGHT = 10
#: Runs of sorted rows, and groups, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
DIGEST = 32


def encoded(column: Column) -> Column:
    """The value as UTF-8 byte count, colon and text; `-` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """SHA-256 (32 bytes) of the encoded values one behind the other."""
    return F.unhex(F.sha2(F.concat(*(encoded(c) for c in columns)).cast("binary"), 256))


@cache
def _splits(levels: int) -> dict[int, tuple[int, int, int]]:
    """For each depth below the root at which a cut falls: the depth of the root of the part above the cut, the size
    of that part, and the size of each part below."""
    found = {}

    def cut(root: int, levels: int) -> None:
        if levels > 1:
            upper = levels // 2
            found[root + upper] = root, 2**upper - 1, 2 ** (levels - upper) - 1
            cut(root, upper)
            cut(root + upper, levels - upper)

    cut(0, levels)
    return found


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes `index` of a depth lie in the array of a subtree of `height` levels above its leaves."""
    if depth == 0:
        return np.zeros_like(index)
    root, above, below = _splits(height + 1)[depth]
    return address(height, root, index >> (depth - root)) + above + (index & above) * below


def _hash(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def _hex(raw: np.ndarray) -> list[bytes]:
    """Rows of 32 bytes as hex text."""
    text = raw.tobytes().hex().encode()
    return [text[k : k + 2 * DIGEST] for k in range(0, len(text), 2 * DIGEST)]


def _raw(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(b"".join(texts).decode()), np.uint8).reshape(-1, DIGEST)


def fill(leaves: list[bytes], height: int) -> np.ndarray:
    """The array of a subtree over `leaves` (hex); places of nodes that it lacks stay zero."""
    out = np.zeros((2 ** (height + 1) - 1, DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        out[address(height, depth, np.arange(len(level)))] = _raw(level)
        level = [_hash(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return out


def siblings(nodes: np.ndarray, height: int, leaves: int, index: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from the leaves up: the side of each row's sibling (0: none, 1: right, 2: left) and its digest."""
    found = []
    for up in range(height):
        own = index >> up
        other = own ^ 1
        side = np.where(other < -(-leaves // 2**up), np.where(other > own, 1, 2), 0)
        found.append((side, nodes[address(height, height - up, np.where(side > 0, other, own))]))
    return found


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a digest (hex) gives along its path of sides and siblings (hex)."""
    for side, other in path:
        digest = _hash(digest) if side == 0 else _hash(digest, other) if side == 1 else _hash(other, digest)
    return digest


def numbered(df: DataFrame, within: str, by: list[str], rank: str, size: str) -> DataFrame:
    """`df` in ascending order of `by` (nulls first), with each row's rank within its group, from 0, and the group's size.

    Rows are sorted by range, equal ones spread by their place in `df` (which must be stored), so neither a group nor
    a repeated row meets in one task. Ranks follow from the sizes of the sorted runs."""
    spread = df.withColumn("_row", F.monotonically_increasing_id())
    order = [within, *by, "_row"]
    ordered = store(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_at", 33)
    runs = ordered.groupBy(F.col(within).alias("_within"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("_within")
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_within", "_part", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_from"), F.sum("_n").over(of_group).alias(size))
    runs = bounded(store(runs, "runs"))
    here = ordered.withColumn("_part", part)
    placed = here.join(runs, here[within].eqNullSafe(runs["_within"]) & (here["_part"] == runs["_part"]))
    return placed.select(*(ordered[c] for c in df.columns), (ordered["_at"] - runs["_from"]).alias(rank), runs[size])


def bounded(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_SUBTREE = "tree long, block long, height int, leaves long, size long, root binary, nodes binary"


def _built(nodes: DataFrame, height: int) -> DataFrame:
    """One round of subtrees over nodes (tree, rank, size, digest); `size` is the number of all nodes of the tree's round."""

    def build(rows: pa.Table) -> pa.Table:
        rank, size = rows.column("rank").to_numpy(), rows.column("size")[0].as_py()
        block = int(rank[0]) >> height
        digests = rows.column("digest").to_pylist()
        leaves = [digests[k].hex().encode() for k in np.argsort(rank)]
        # the only subtree of its round ends at its own root; others go up to their full height, lone nodes too
        own = (len(leaves) - 1).bit_length() if size <= 2**height else height
        array = fill(leaves, own)
        row = [rows.column("tree")[0].as_py(), block, own, len(leaves), size, array[0].tobytes(), array.tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in _SUBTREE.split(", ")]
    dealt = nodes.select("tree", "rank", "size", "digest", F.shiftright("rank", height).alias("block"))
    return store(dealt.groupBy("tree", "block").applyInArrow(build, _SUBTREE), "subtrees")


def grow(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """All rounds of subtrees over nodes (tree, rank, size, digest), the lowest first. There are as many as the largest tree needs."""
    rounds = [_built(nodes, height)]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 2**height:
        more = rounds[-1].where(F.col("size") > 2**height)
        up = more.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / 2**height).cast("long").alias("size"), F.col("root").alias("digest"))
        rounds.append(_built(up, height))
    return rounds


def _onward(blocks: DataFrame, height: int) -> DataFrame:
    """(tree, rank, sides, others, roots): the path from each leaf of the subtrees to the top, from what `blocks` have
    of their own roots' paths."""
    schema = "tree long, rank long, sides binary, others binary, roots binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                index = np.arange(b["leaves"])
                nodes = np.frombuffer(b["nodes"], np.uint8).reshape(-1, DIGEST)
                levels = siblings(nodes, b["height"], b["leaves"], index)
                sides = [bytes(int(s[k]) for s, _ in levels) + b["sides"] for k in index]
                others = [b"".join(d[k].tobytes() for s, d in levels if s[k]) + b["others"] for k in index]
                n = len(index)
                yield pa.RecordBatch.from_arrays([pa.array([b["tree"]] * n, pa.int64()), pa.array((b["block"] << height) + index), pa.array(sides, pa.binary()), pa.array(others, pa.binary()), pa.array([b["roots"]] * n, pa.binary())], names=["tree", "rank", "sides", "others", "roots"])

    return blocks.mapInArrow(run, schema)


def descend(rounds: list[DataFrame], tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest subtrees, each with the path of its root: `sides` (a byte a level), `others` (the siblings that there
    are) and `roots` (its tree's root and those above). `tops` (tree, sides, others, roots) has the paths of whole trees."""
    known, blocks = None, None
    for k in range(len(rounds) - 1, -1, -1):
        above = tops.select("tree", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("top"), "sides", "others", "roots")
        if known is not None:
            above = above.union(known.select("tree", "rank", F.lit(False), "sides", "others", "roots"))
        level = rounds[k].withColumn("top", F.col("size") <= 2**height).withColumnRenamed("block", "rank")
        joined = level.join(above, ["tree", "rank", "top"])
        roots = F.when(F.col("top"), F.concat("root", "roots")).otherwise(F.col("roots"))
        blocks = joined.select("tree", F.col("rank").alias("block"), "height", "leaves", "nodes", "sides", "others", roots.alias("roots"))
        if k:
            known = store(_onward(blocks, height), "paths")
    return blocks


@dataclass
class Manifest:
    """leaves: id, digest (32 bytes), changed (32 bytes or null), tree, rank, block. subtrees: the lowest ones, with
    their roots' paths. rounds and top_rounds: the stored subtrees of the groups' trees and of the tree above."""

    leaves: DataFrame
    subtrees: DataFrame
    rounds: list[DataFrame]
    top_rounds: list[DataFrame]


def build_manifest(df: DataFrame, leaf: Column, changed: Column | None = None, group_col: str = "lang", id_col: str = "doc_id", height: int = HEIGHT) -> Manifest:
    """The Merkle manifest of all rows: `leaf` is a row's digest, `changed` the one it shall be verified with (null: its own).

    In a group (null is one, and the first) leaves ascend by id, null ids first; rows that
    share an id follow in the order of their digests, each a leaf. Groups are ordered bytewise.
    Levels join every two consecutive nodes; a lone last one is hashed by itself. An empty
    table gives a manifest without rows. Extra columns and their names don't matter.
    Texts are read once; digests are what is sorted and stored.
    """
    changed = F.lit(None).cast("binary") if changed is None else changed
    hashed = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf.alias("digest"), changed.alias("changed"))
    ranked = numbered(store(hashed, "leaves"), "group", ["id", "digest"], "rank", "size")
    groups = store(ranked.groupBy("group").agg(F.lit(0).cast("long").alias("tree")), "groups")
    placed = numbered(groups, "tree", ["group"], "number", "groups")
    placed = bounded(store(placed.select(F.col("group").alias("of"), F.col("number").alias("tree"), "groups"), "trees"))
    joined = ranked.join(placed, ranked["group"].eqNullSafe(placed["of"]))
    leaves = store(joined.select("id", "digest", "changed", "tree", "rank", "size", "groups", F.shiftright("rank", height).alias("block")), "ranked")
    rounds = grow(leaves, height)
    # a tree's root is that of the subtree which is alone in its round; the number of groups comes along with its leaves
    roots = None
    for r in rounds:
        own = r.where(F.col("size") <= 2**height).select(F.col("tree").alias("rank"), F.col("root").alias("digest"))
        roots = own if roots is None else roots.union(own)
    top = roots.join(placed.select(F.col("tree").alias("rank"), F.col("groups").alias("size")), "rank").withColumn("tree", F.lit(0).cast("long"))
    top_rounds = grow(top, height)
    nothing = F.lit(b"")
    end = top_rounds[-1].where(F.col("size") <= 2**height).select("tree", nothing.alias("sides"), nothing.alias("others"), nothing.alias("roots"))
    tops = store(_onward(descend(top_rounds, end, height), height), "tops")
    subtrees = descend(rounds, tops.select(F.col("rank").alias("tree"), "sides", "others", "roots"), height)
    return Manifest(leaves.select("id", "digest", "changed", "tree", "rank", "block"), store(subtrees, "manifest"), rounds, top_rounds)


def verify(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """One row a leaf: its id, `leaf`, its group's `subroot`, `root`, `proof_sha256` (of all its siblings from leaf to
    root, left to right), `folded_root` (what its changed digest, or else its own, gives along that path) and `verified`."""
    schema = T.StructType([field(manifest.leaves, "id", id_col), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])

    def run(rows: pa.Table, subtree: pa.Table) -> pa.Table:
        b = subtree.to_pylist()[0]
        rank = rows.column("rank").to_numpy()
        nodes = np.frombuffer(b["nodes"], np.uint8).reshape(-1, DIGEST)
        index = rank - rank.min()
        levels = [(s, _hex(d)) for s, d in siblings(nodes, b["height"], b["leaves"], index)]
        sides, others = b["sides"], _hex(np.frombuffer(b["others"], np.uint8))
        rest = iter(others)
        upper = [(side, next(rest) if side else b"") for side in sides]
        subroot, root = (b["roots"][k : k + DIGEST].hex() for k in (0, DIGEST))
        above: dict[bytes, bytes] = {}
        out: list[list] = [[], [], [], []]
        for k, (own, other) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("changed").to_pylist(), strict=True)):
            path = [(int(s[k]), d[k]) for s, d in levels]
            at = fold((other or own).hex().encode(), path)
            if at not in above:  # most rows of a subtree come to the same root of it
                above[at] = fold(at, upper)
            found = above[at].decode()
            for column, value in zip(out, (own.hex(), _hash(*(d for s, d in path if s), *others).decode(), found, found == root), strict=True):
                column.append(value)
        n = rows.num_rows
        return pa.table([rows.column("id"), pa.array(out[0]), pa.array([subroot] * n), pa.array([root] * n), *map(pa.array, out[1:])], names=schema.names)

    return manifest.leaves.groupBy("tree", "block").cogroup(manifest.subtrees.groupBy("tree", "block")).applyInArrow(run, schema)


#: DuckDB: what the manifest's query returns.
SQL = """
    WITH RECURSIVE texts AS (
        SELECT doc_id, lang, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS d, (n_chars + 1)::VARCHAR AS d1, text AS e FROM documents
    ), parts AS (
        SELECT doc_id, lang, a, list_transform([a, b, c, d, d1, e], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS p FROM texts
    ), crcs AS (
        SELECT *, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(a, ''), lambda x: ascii(x)::BIGINT)),
            lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) AS crc FROM parts
    ), rows AS (
        SELECT doc_id, lang, sha256(p[1] || p[2] || p[3] || p[4] || p[6]) AS leaf,
               CASE WHEN crc % 7 = 0 THEN sha256(p[1] || p[2] || p[3] || p[5] || p[6]) ELSE sha256(p[1] || p[2] || p[3] || p[4] || p[6]) END AS held
        FROM crcs
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM rows
    ), trees AS (
        SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
        UNION ALL
        SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(h || other) FROM (
            SELECT *, coalesce(lead(h) OVER (PARTITION BY lang ORDER BY i), '') AS other FROM trees
        ) WHERE i % 2 = 0 AND n > 1
    ), subroots AS (
        SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM trees WHERE n = 1
    ), top AS (
        SELECT 0 AS level, i, n, h FROM subroots
        UNION ALL
        SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || other) FROM (
            SELECT *, coalesce(lead(h) OVER (ORDER BY i), '') AS other FROM top
        ) WHERE i % 2 = 0 AND n > 1
    ), nodes AS (
        SELECT coalesce(lang, '-') AS tree, lang IS NULL AS none, level, i, h, n FROM trees
        UNION ALL SELECT 'top', NULL, level, i, h, n FROM top
    ), walks AS (
        SELECT l.doc_id, l.lang, l.i AS at, 0 AS level, l.i, l.n, l.held AS h, '' AS proof FROM leaves l
        UNION ALL
        SELECT w.doc_id, w.lang, w.at, w.level + 1, w.i // 2, (w.n + 1) // 2,
               CASE WHEN w.i % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || coalesce(s.h, '')) END, w.proof || coalesce(s.h, '')
        FROM walks w LEFT JOIN nodes s ON s.none = (w.lang IS NULL) AND s.tree = coalesce(w.lang, '-') AND s.level = w.level AND s.i = xor(w.i, 1)
        WHERE w.n > 1
    ), upward AS (
        SELECT w.doc_id, w.lang, w.at, 0 AS level, r.i, r.n, w.h, w.proof FROM walks w JOIN subroots r ON w.lang IS NOT DISTINCT FROM r.lang WHERE w.n = 1
        UNION ALL
        SELECT w.doc_id, w.lang, w.at, w.level + 1, w.i // 2, (w.n + 1) // 2,
               CASE WHEN w.i % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || coalesce(s.h, '')) END, w.proof || coalesce(s.h, '')
        FROM upward w LEFT JOIN nodes s ON s.tree = 'top' AND s.none IS NULL AND s.level = w.level AND s.i = xor(w.i, 1)
        WHERE w.n > 1
    )
    SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = t.h AS verified
    FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN upward u ON u.lang IS NOT DISTINCT FROM l.lang AND u.at = l.i AND u.n = 1
    JOIN top t ON t.n = 1
"""
