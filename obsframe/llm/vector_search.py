"""Exact top-k inner products by vector-approximation files.

Rows are written once in two tables: tiles of 8-bit cells per dimension, and the
exact integers. The scan reads cells only: blocks of queries meet parts of the
tiles, and each leaves the rows whose score may reach the k-th best lower bound;
one part is scanned first, so that each query brings such a bound to all others.
Exact vectors are then read in order of their upper bound: the first k of each
query, and of the rest those that the k-th exact score doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import field, store

CELLS = 256
#: Rows of a tile and its bytes, at most; tiles of a part and queries of a block, about. A task holds one part and one block.
TILE = 4096
TILE_BYTES = 4 << 20
PART = 16
BLOCK = 4096
#: Queries that are held against a tile at once.
STEP = 256
_SAFE = 2.0**52


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold a null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Cells:
    """A tile: rows of one dimension as cells. Bounds hold for any query of integers."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.low, self.step, self.cells = low, step, cells

    @classmethod
    def of(cls, exact: np.ndarray) -> Cells:
        low, high = exact.min(0).astype(np.float64), exact.max(0).astype(np.float64)
        step = np.maximum((high - low + 1) / CELLS, 1e-9)
        return cls(low, step, np.clip((exact - low) / step, 0, CELLS - 1).astype(np.uint8))

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query and row a product, and per query what to add to it and by how much the score may then differ;
        that also covers rounding. Products are of single precision where no sum can leave its range."""
        size, n = np.abs(queries), queries.shape[1]
        reach = CELLS * (size @ self.step)
        single = reach.max(initial=0) < 1e30
        kind = np.float32 if single else np.float64
        product = (queries * self.step).astype(kind) @ self.cells.T.astype(kind)
        about = queries @ (self.low + 0.5 * self.step)
        margin = 0.5 * (size @ self.step) + (n + 8) * float(np.finfo(kind).eps) * reach + 1e-9 * (size @ np.abs(self.low) + reach) + 1e-6
        return product, about, margin


def candidates(tiles: list[tuple[np.ndarray, np.ndarray, Cells]], query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[np.ndarray]:
    """For (rows, their ids, cells) of `tiles`: the place of the query, the row, and the bounds of the score from below
    and above, of all rows of other ids that may be among the query's k best. Query ids are distinct. `floor`: a score
    that each query's k-th best is known to reach."""
    floor = np.full(len(query_ids), -np.inf) if floor is None else floor.copy()
    order = np.argsort(query_ids)
    ranked = query_ids[order]
    found = []
    for rows, ids, cells in tiles:
        at = np.minimum(np.searchsorted(ranked, ids), len(ranked) - 1)
        own = np.flatnonzero(ranked[at] == ids)
        asks = order[at[own]]
        for first in range(0, len(queries), STEP):
            product, about, margin = cells.scores(queries[first : first + STEP])
            mine = (asks >= first) & (asks < first + STEP)
            product[asks[mine] - first, own[mine]] = -np.inf
            held = floor[first : first + STEP]
            if len(rows) >= k:
                np.maximum(held, np.partition(product, -k, axis=1)[:, -k] + about - margin, out=held)
            q, r = np.nonzero((product >= (held - about - margin)[:, None]) & (product > -np.inf))
            middle = product[q, r] + about[q]
            found.append((q + first, rows[r], middle - margin[q], middle + margin[q]))
    q, row, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
    by_low = np.lexsort((-low, q))
    start = np.searchsorted(q[by_low], np.arange(len(queries)))
    many = np.flatnonzero(np.diff(np.r_[start, len(q)]) >= k)
    floor[many] = np.maximum(floor[many], low[by_low[start[many] + k - 1]])
    kept = high >= floor[q]
    return [c[kept] for c in (q, row, low, high)]


def scores(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Integer inner products of lists of equal lengths; beyond 2**52 by Python integers, held to the range of long."""
    sizes = pa.compute.list_value_length(left).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = left.flatten().to_numpy(zero_copy_only=False), right.flatten().to_numpy(zero_copy_only=False)
    if np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * sizes.max(initial=0) < _SAFE:
        sums = np.r_[0, np.cumsum(a * b)]
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]
    exactly = [sum(x * y for x, y in zip(u, v, strict=True)) for u, v in zip(left.to_pylist(), right.to_pylist(), strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exactly], np.int64)


def _vectors(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def write_tiles(rows: DataFrame) -> DataFrame:
    """The quantised table of `rows` (row, id, v): one row a tile, whose number is that of its first row."""
    schema = "n int, tile long, rows binary, ids binary, low binary, step binary, cells binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                same, most = batch.filter(pa.array(sizes == n)), max(1, min(TILE, TILE_BYTES // max(n, 1)))
                for at in range(0, same.num_rows, most):
                    part = same.slice(at, most)
                    row, ids = (part.column(c).to_numpy() for c in (0, 1))
                    tile = Cells.of(_vectors(part.column(2), n))
                    held = [x.tobytes() for x in (row, ids, tile.low, tile.step, tile.cells)]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([int(row[0])]), *(pa.array([x], pa.binary()) for x in held)], names=names)

    names = ["n", "tile", "rows", "ids", "low", "step", "cells"]
    return store(rows.select("row", "id", "v").mapInArrow(run, schema), "tiles")


def scan(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, row, low, high): the rows that may be among a query's k best, from the cells alone.

    Parts of about PART tiles and blocks of about BLOCK queries meet once each, in tasks that hold one of both; the
    tiles are shuffled once a block, the queries once a part, and nothing passes through the driver but two counts. A
    task sends only what can reach the k-th best lower bound of the first part, which is k rows or fewer for most."""
    tiles = write_tiles(rows)
    parts, blocks = max(1, -(-tiles.count() // PART)), max(1, -(-asked.count() // BLOCK))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    tiles = tiles.withColumn("part", dealt("tile", parts))
    if parts > 1:
        # what one part holds for a query bounds what any other part must beat to be sent on
        first = _met(tiles.where("part = 0"), asked.withColumn("floor", F.lit(float("-inf"))), [0], blocks, k)
        best = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("_n") == k)
        asked = asked.join(best.select(F.col("query_id").alias("id"), F.col("low").alias("floor")), "id", "left").fillna(float("-inf"), "floor")
    else:
        asked = asked.withColumn("floor", F.lit(float("-inf")))
    return store(_met(tiles, asked, range(parts), blocks, k), "candidates")


def _met(tiles: DataFrame, asked: DataFrame, parts: Sequence[int], blocks: int, k: int) -> DataFrame:
    """`scan` of the tiles of `parts`, with a floor for each query."""
    every = lambda numbers: F.explode(F.array(*map(F.lit, numbers)) if len(numbers) == 1 else F.sequence(F.lit(numbers[0]), F.lit(numbers[-1])))
    left = tiles.withColumn("block", every(range(blocks)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    grouped = asked.groupBy(F.size("v").alias("n"), block).agg(F.collect_list(F.struct("id", "v", "floor")).alias("asked"))
    right = grouped.withColumn("part", every(parts))
    keys = ("n", "part", "block")

    def search(tiles: pa.Table, block: pa.Table) -> pa.Table:
        q = ([], [], [], [])
        if tiles.num_rows and block.num_rows:
            n = tiles.column("n")[0].as_py()
            queries = block.column("asked").combine_chunks().flatten()
            ids, floor = (queries.field(c).to_numpy(zero_copy_only=False) for c in ("id", "floor"))
            held = []
            for t in tiles.to_pylist():
                row, own, low, step = (np.frombuffer(t[c], kind) for c, kind in (("rows", np.int64), ("ids", np.int64), ("low", float), ("step", float)))
                held.append((row, own, Cells(low, step, np.frombuffer(t["cells"], np.uint8).reshape(len(row), n))))
            q = candidates(held, ids, _vectors(queries.field("v"), n).astype(np.float64), k, floor)
            q[0] = ids[q[0]]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(q, kinds, strict=True)], names=["query_id", "row", "low", "high"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, row long, low double, high double")


def read_exact(found: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score) of the rows that `found` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2), batch.column(3)), pa.int64())], names=["query_id", "id", "score"])

    queries = asked.select(F.col("id").alias("query_id"), F.col("v").alias("_q"))
    named = found.select("query_id", "row").join(rows.select("row", "id", "v"), "row").join(queries, "query_id")
    return named.select("query_id", "id", "v", "_q").mapInArrow(run, "query_id long, id long, score long")


def exact_top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row the k rows of other ids with the highest integer inner product.

    Returns `query_id`, `rank` (int, from 1), the id and `score` (long); ties go to
    the smaller id, and all rows come back where there are fewer than k.
    Components become floor(scale * x). Vectors that are null or hold a null,
    NaN or infinity take no part, nor do rows with a null id; empty vectors
    score 0 with one another. Rows of another length than the query aren't its
    candidates. Repeated rows are candidates each; of rows that repeat a query
    id, the one with the smallest vector asks. Other columns are left out.

    The exact rows, their cells, the queries and the candidates are tables in the
    checkpoint folder.
    """
    # the ids must be integers for the arrays in the tasks
    read = df.select(F.col(id_col).cast("long").alias("id"), integer_components(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = store(read.where("id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = store(rows.where("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    found = scan(rows, asked, k)
    of_query = Window.partitionBy("query_id")

    def least_of_best(scored: DataFrame, by: str) -> DataFrame:
        """Each query's k-th highest of column `by`; queries with fewer are left out."""
        best = scored.select("query_id", by, F.row_number().over(of_query.orderBy(F.desc(by))).alias("_n")).where(F.col("_n") <= k)
        return best.groupBy("query_id").agg(F.min(by).alias("_least"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")

    in_reach = lambda these, least: these.join(least, "query_id", "left").where("_least is null or high >= _least").drop("_least")
    ordered = store(in_reach(found, least_of_best(found, "low")).withColumn("_at", F.row_number().over(of_query.orderBy(F.desc("high"), "row"))), "ordered")
    first = store(read_exact(ordered.where(F.col("_at") <= k), rows, asked), "first")
    rest = read_exact(in_reach(ordered.where(F.col("_at") > k), least_of_best(first, "score")), rows, asked)
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").cast(field(df, id_col).dataType).alias(id_col), "score")
