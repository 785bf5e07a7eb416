"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a row's cell is the pair
of its centroids.  For a query, the centroids of each half are sorted by inner
product, and a heap walks the pairs from the greatest sum down until the cells
met hold the share of rows that the fit found to be needed.  Rows of the cells
met are reranked by their exact inner product in double precision.

Fit: k-means and the share come from at most FIT_ROWS vectors (those first by
a hash of their id).  The share is the least that finds TARGET of the sample's
true neighbours, so recall is measured, not assumed.  Every row is indexed.

Search runs in blocks: cells in order fill blocks of rows (a cell beyond a
block's size is dealt to several), queries go to the blocks that hold a cell
they met, and a task handles one block of rows with one block of queries.
Both sizes are bounded, whatever cell is hot.

Vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows without an id or vectors of another length than the most
frequent one.  Of rows that repeat an id the one with the smallest vector
counts.  Ties go to the smaller id; with fewer candidates than asked all are
returned; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqlens.llm.common import written

FIT_ROWS = 8192
FIT_QUERIES = 256
CENTROIDS = 64
ROUNDS = 12
TARGET = 0.95


@dataclass
class Index:
    first: np.ndarray  # centroids of the first half
    second: np.ndarray
    share: float  # of the rows that a query's cells have to hold

    def sums(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return vectors[:, :half] @ self.first.T, vectors[:, half:] @ self.second.T

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _nearest(vectors[:, :half], self.first) * len(self.second) + _nearest(vectors[:, half:], self.second)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    different = np.unique(x, axis=0)
    centroids = different[rng.permutation(len(different))[:k]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centroids)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].mean(axis=0)
    return centroids


def walk(s1: np.ndarray, s2: np.ndarray, counts: np.ndarray, need: int) -> tuple[list[int], float]:
    """Cells by falling sum until they hold ``need`` rows, and the last sum."""
    o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
    a, b = (-s1[o1]).tolist(), (-s2[o2]).tolist()
    o1, o2, n2 = o1.tolist(), o2.tolist(), len(b)
    heap = [(a[0] + b[0], 0, 0)]
    met, held, least = [], 0, np.inf
    while heap and held < need:
        least, i, j = heapq.heappop(heap)
        cell = o1[i] * n2 + o2[j]
        met.append(cell)
        held += counts[cell]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < n2:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return met, -least


def fit(sample: np.ndarray, k: int, centroids: int = CENTROIDS, target: float = TARGET, seed: int = 5) -> Index:
    """Quantise the halves and measure the share of rows that queries need."""
    rng = np.random.default_rng(seed)
    half = max(1, sample.shape[1] // 2)
    index = Index(_kmeans(sample[:, :half], centroids, rng), _kmeans(sample[:, half:], centroids, rng), 1.0)
    n, some = len(sample), np.sort(rng.permutation(len(sample))[:FIT_QUERIES])
    exact = sample[some] @ sample.T
    exact[np.arange(len(some)), some] = -np.inf
    top = np.argsort(-exact, axis=1, kind="stable")[:, : min(k, n - 1)]
    if top.shape[1] == 0:
        return index
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    s1, s2 = index.sums(sample[some])
    sums = (s1[:, :, None] + s2[:, None, :]).reshape(len(some), -1)
    order = np.argsort(-sums, axis=1, kind="stable")
    upto = np.empty_like(order)
    np.put_along_axis(upto, order, np.cumsum(counts[order], axis=1), axis=1)
    needed = np.take_along_axis(upto, cells[top], axis=1) / n
    index.share = float(min(1.0, np.quantile(needed, target)))
    return index


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector")).filter("id is not null and vector is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def search(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    target: float = TARGET,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The ``k`` nearest found for every row that ``is_query`` (a condition on
    the column ``id``) selects: query_id, rank, id and score."""
    spark = df.sparkSession
    rows = written(usable(df, id_col, vector_col), "ann-rows")
    kind = rows.schema["id"].dataType.simpleString()
    result = f"query_id {kind}, id {kind}, score double"
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    width = lengths["n"]
    rows = rows.filter(F.size("vector") == width)
    # bounded by fit_rows
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vector").toArrow()
    index = fit(_matrix(sample.column("vector"), width), k, centroids, target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = index.cells(_matrix(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    indexed = written(rows.mapInArrow(assign, f"id {kind}, vector array<double>, cell int"), "ann-index")
    # one row per cell, at most centroids squared
    held = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    counts[list(held)] = list(held.values())
    total, asked = int(counts.sum()), rows.filter(is_query).count()
    row_block, query_block = _clamp(total // 16, 2048, 131072), _clamp(asked // 8, 256, 65536)
    # blocks: cells in order until full; a cell beyond a block has its own
    block, parts, at, fill = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell in np.flatnonzero(counts):
        n = int(counts[cell])
        if fill and fill + n > row_block:
            at, fill = at + 1, 0
        block[cell] = at
        if n > row_block:
            parts[cell] = -(-n // row_block)
            at, fill = at + int(parts[cell]), 0
        else:
            fill += n
    need = max(k + 1, int(np.ceil(index.share * total)))
    shared = spark.sparkContext.broadcast((index, counts, block, parts))  # bounded by the centroids

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, block, parts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), width)
            s1, s2 = index.sums(vectors)
            least, to = [], []
            for i in range(len(vectors)):
                met, last = walk(s1[i], s2[i], counts, need)
                met = np.array([c for c in met if counts[c]], np.int64)
                goals = set(block[met].tolist())
                for c in met[parts[met] > 1].tolist():
                    goals.update(range(int(block[c]), int(block[c] + parts[c])))
                least.append(last)
                to.append(sorted(goals))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(least, pa.float64()), pa.array(to, pa.list_(pa.int64()))],
                names=["id", "vector", "least", "blocks"],
            )

    lots = max(1, -(-asked // query_block))
    queries = rows.filter(is_query).mapInArrow(route, f"id {kind}, vector array<double>, least double, blocks array<long>")
    lot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lots))
    queries = queries.select("id", "vector", "least", F.explode("blocks").alias("block"), lot.alias("lot"))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, block, parts = shared.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(block[cell]), pa.array(parts[cell])], names=["id", "vector", "cell", "first", "parts"]
            )

    placed = indexed.mapInArrow(blocks_of, f"id {kind}, vector array<double>, cell int, first long, parts long")
    placed = placed.select(
        "id",
        "vector",
        "cell",
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"),
    )

    def rerank(own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if own.num_rows and asked.num_rows:
            index = shared.value[0]
            x, q = _matrix(own.column("vector"), width), _matrix(asked.column("vector"), width)
            x_id, q_id = own.column("id").to_numpy(), asked.column("id").to_numpy()
            least, cell = asked.column("least").to_numpy(), own.column("cell").to_numpy()
            c1, c2 = np.divmod(cell, len(index.second))
            for at in range(0, len(q), 64):
                part = slice(at, at + 64)
                s1, s2 = index.sums(q[part])
                near = q[part] @ x.T
                near[s1[:, c1] + s2[:, c2] < least[part, None] - 1e-9] = -np.inf  # cells not met
                near[q_id[part, None] == x_id[None, :]] = -np.inf
                for i, row in enumerate(near):
                    some = np.flatnonzero(row > -np.inf)
                    if len(some) > k:
                        bar = np.partition(row[some], len(some) - k)[len(some) - k]
                        some = some[row[some] >= bar - 1e-9]
                    score = (x[some] * q[at + i]).sum(axis=1)  # the same for equal vectors
                    best = np.lexsort((x_id[some], -score))[:k]
                    found.append((np.full(len(best), q_id[at + i]), x_id[some][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        kinds = [own.schema.field("id").type] * 2 + [pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "id", "score"])

    group = ["block", "lot"]
    scored = placed.groupBy(*group).cogroup(queries.groupBy(*group)).applyInArrow(rerank, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
