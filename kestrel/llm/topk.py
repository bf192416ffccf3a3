"""Exact top-k inner products: a ball tree per shard, branch and bound.

Vectors are quantised to integers.  A bounded sample gives coarse centres, and every
vector goes to the cell of its nearest one; large cells are dealt into shards by a
hash, and every shard builds a ball tree over its own.  For a query q, no vector of a
node (or cell) with centre c and radius r scores above <q, c> + |q| r: nodes are visited
best bound first, and one whose bound is under the query's current k-th score is left
out with all below.

Rounds share that score between shards.  Each query first searches the cell of its
best bound, then its next 2, 4, 8, ... cells in the order of their bounds, and each
round begins with the k-th score of the rounds before: a cell under it is never sent
the query, and a query is done when its next cell is.  Only k rows per query and shard
leave a task.

A task holds one shard and at most ``QUERY_BLOCK`` queries; a shard that more queries
ask is copied for each block of them.  Where bounds exclude nothing (vectors spread
evenly in many dimensions), every query visits every cell: exactness then costs as
much as comparing all queries with all rows, in blocks.

Defined results: vectors that are null, empty, or hold null or non-finite components
take no part, as query or candidate, nor do rows with a null id; only vectors of one
dimension are compared; a query never finds its own row (repeated ids are other rows);
ties go to the smaller id; fewer candidates than k give them all; very long vectors
are rows like any other; scores beyond 2**52 raise an error, so no result is ever
inexact; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.storage import Scratch, materialize, scratch

K, SCALE = 10, 1024
LEAF = 64
SHARD_ROWS, QUERY_BLOCK = 16_384, 4_096
#: Cells of one dimension at most, and sampled vectors for each: they bound what is collected and broadcast.
MAX_CELLS, PER_CELL = 1_024, 16
FOUND = "row long, q long, id long, score long"


class BallTree:
    """Balls over the rows of an integer matrix, split at the median of the widest direction."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[self.order[a:b]]
            centre = own.mean(axis=0)
            node = len(self.span)
            self.span.append((a, b))
            self.children.append(None)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            if parent >= 0:
                left, right = self.children[parent] or (-1, -1)
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > LEAF and radii[-1] > 0:
                along = own[:, own.var(axis=0).argmax()]
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
                stack += [(a + half, b, node, 1), (a, a + half, node, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, ids: np.ndarray, own_row: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Best (score, -id) pairs at or above ``floor``, at most k, other than row ``own_row``."""
        norm = float(np.sqrt(query @ query))
        bounds = self.centres @ query + norm * self.radii
        bounds = bounds + 1 + 1e-9 * np.abs(bounds)  # rounding never prunes
        best: list[tuple[int, int]] = []  # a heap; its least is the current kth
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if (below := self.children[node]) is not None:
                for child in below:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = self.order[slice(*self.span[node])]
            scores = self.points[rows] @ query
            for at in np.flatnonzero(scores >= floor).tolist():
                if rows[at] == own_row:
                    continue
                found = (int(scores[at]), -int(ids[rows[at]]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
                if len(best) == k:
                    floor = max(floor, best[0][0])
        return best


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _centres(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Means of a few rounds of nearest-centre assignment."""
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = _nearest(sample, centres)[0]
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, and the distance from it."""
    square = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    own = square.argmin(axis=1)
    return own, np.sqrt(((points - centres[own]) ** 2).sum(axis=1))


def _bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No vector of the cell scores above this, whatever is rounded."""
    at = queries @ centres.T + np.sqrt((queries**2).sum(axis=1))[:, None] * radii[None, :]
    return at + 1 + 1e-9 * np.abs(at)


def _whole(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, radius and shards of a dimension that is one cell: no bound leaves it out."""
    return np.zeros((1, dim)), np.array([1e280]), np.ones(1, dtype=np.int64)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _dealt(rows: DataFrame, out: Scratch, shard_rows: int) -> tuple[DataFrame, dict]:
    """``rows`` with cell and shard, written; and for each dimension of several shards its centres, radii and shards a cell."""
    spark = rows.sparkSession
    # Only dimensions of more than one shard have cells: the driver sees one row for each ``shard_rows`` vectors at most.
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().where(F.col("count") > shard_rows).collect()}
    cells = {dim: min(MAX_CELLS, -(-n // shard_rows)) for dim, n in sizes.items()}
    large, share = F.col("dim").isin(list(sizes)), F.lit(0.0)
    for dim, n in sizes.items():
        share = F.when(F.col("dim") == dim, min(1.0, PER_CELL * cells[dim] / n)).otherwise(share)
    some = rows.where(large & (F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) <= share * (1 << 30))).select("dim", "x")
    found: dict[int, list] = {}
    for dim, x in some.collect():  # some PER_CELL vectors for each cell
        found.setdefault(dim, []).append(x)
    centres = {
        dim: _centres(np.array(found[dim], dtype=np.float64), n) if dim in found else np.zeros((1, dim)) for dim, n in cells.items()
    }
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                cell, far = _nearest(_matrix(own.column("x")), shared.value.get(dim, _whole(dim)[0]))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*own.schema.names, "cell", "far"]
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = out.write(rows.mapInArrow(place, f"{fields}, cell int, far double"), "cells")
    # One row for each cell.
    told = placed.where(large).groupBy("dim", "cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    cut = {dim: (c, np.full(len(c), -np.inf), np.ones(len(c), dtype=np.int64)) for dim, c in centres.items()}
    for t in told:
        cut[t.dim][1][t.cell] = t.r
        cut[t.dim][2][t.cell] = -(-t.n // shard_rows)
    table = spark.createDataFrame([(t.dim, t.cell, -(-t.n // shard_rows)) for t in told], "dim int, cell int, n long")
    shard = F.pmod(F.xxhash64("row"), F.coalesce("n", F.lit(1))).cast("int")
    held = placed.drop("far").join(F.broadcast(table), ["dim", "cell"], "left").withColumn("shard", shard).drop("n")
    return out.write(held, "shards"), cut


def top_k(
    vectors: DataFrame, query_if, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, id, score of the k best for every row on which ``query_if`` holds."""
    with scratch(vectors.sparkSession) as out:
        found = _top_k(vectors, query_if, k, id_col, vector_col, scale, shard_rows, query_block, out)
        best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return materialize(ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score"), "topk")[0]


def _top_k(vectors, query_if, k, id_col, vector_col, scale, shard_rows, query_block, out) -> DataFrame:
    """(row, q, id, score): at least the k best of every query."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], FOUND)
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = out.write(
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
        .where(fine)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(query_if, F.lit(False)).alias("asks"),
            x.alias("x"),
            F.size(vector_col).alias("dim"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    if (top := rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]) and top >= 2.0**52:
        raise ValueError("scores are too large to be exact")
    if top is None:
        return nothing
    held, cut = _dealt(rows, out, shard_rows)
    shared = spark.sparkContext.broadcast(cut)

    def route(first: int, last: int):
        """Sends each query to the shards of its cells first to last - 1, in the order of bounds, that may hold a better vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, own in _by_dim(batch):
                    centres, radii, shards = shared.value.get(dim) or _whole(dim)
                    bound = _bounds(_matrix(own.column("x")), centres, radii)
                    cells = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    kth = own.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                    open_ = np.take_along_axis(bound, cells, axis=1) >= np.where(np.isnan(kth), -np.inf, kth)[:, None]
                    open_ &= np.isfinite(np.take_along_axis(bound, cells, axis=1))
                    at, place = np.nonzero(open_)
                    cell = cells[at, place]
                    each = shards[cell]
                    shard = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    sent = own.take(pa.array(np.repeat(at, each)))
                    yield pa.RecordBatch.from_arrays(
                        [*sent.columns, pa.array(np.repeat(cell, each).astype(np.int32)), pa.array(shard.astype(np.int32))],
                        names=[*sent.schema.names, "cell", "shard"],
                    )

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got: tuple[list, ...] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by("row")
            points, ids = _matrix(left.column("x")), left.column("id").to_numpy()
            row_at = {r: i for i, r in enumerate(left.column("row").to_pylist())}
            tree = BallTree(points)
            asked = _matrix(right.column("q_x"))
            for q, row, floor, query in zip(*(right.column(c).to_pylist() for c in ("q_id", "q_row", "q_kth")), asked, strict=True):
                for score, other in tree.search(query, ids, row_at.get(row, -1), k, -np.inf if floor is None else floor):
                    for to, v in zip(got, (row, q, -other, score), strict=True):
                        to.append(v)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("row", "q", "id", "score"), got, strict=True)})

    by = ["dim", "cell", "shard"]
    queries = out.write(held.where("asks").select("id", "row", "dim", "x"), "queries")
    found, first, width = nothing, 0, 1
    most = max([1, *(len(c) for c, _, _ in cut.values())])
    kth = None
    while first < most:
        asking = queries.withColumn("kth", F.lit(None).cast("double")) if kth is None else queries.join(kth, "row", "left")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asking.schema)
        sent = out.write(asking.mapInArrow(route(first, first + width), f"{fields}, cell int, shard int"), "sent")
        counts = out.write(sent.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / query_block).alias("blocks")), "counts")
        if not counts.limit(1).count():  # all further bounds are lower still
            break
        left = held.select("id", "row", "x", *by).join(counts, by)
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        right = sent.join(counts, by).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
        right = right.select(*(F.col(c).alias(f"q_{c}") for c in ("id", "row", "kth", "x", *by, "block")))
        new = left.groupBy(*by, "block").cogroup(right.groupBy(*(f"q_{c}" for c in (*by, "block")))).applyInArrow(search, FOUND)
        best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
        ranked = found.unionByName(new).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = out.write(ranked.drop("rank"), "found")
        kth = found.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
        first, width = first + width, 2 * width
    return found


def report(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score; the queries are the ids divisible by 100."""
    return top_k(vectors, F.col("vec_id") % 100 == 0)
