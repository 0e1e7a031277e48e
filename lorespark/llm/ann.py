"""Approximate nearest neighbours by collision counting.

Vectors are projected on a number of random directions, and each direction keeps one array sorted by projection. A query
opens a window around its own projection in each array; a vector collides in as many arrays as have it in the window.
Windows widen step by step (virtual rehashing: nothing is hashed again), and a vector whose collisions pass the threshold
is verified exactly, once; no cosine of any other vector is computed. A query ends when its windows are so wide, against
the distance of its k-th best, that a nearer vector would pass the threshold almost surely, or when all vectors are
verified. There is no cap on candidates.

A projection of a difference of length d is normal with deviation d. So a window of REACH times d holds a vector at
distance d with a known probability, and one at RATIO times d with a smaller one. plan() takes from these how many arrays
and which threshold it needs to miss MISSED of the first at most, and to pass PASSED of the second.

Where the work goes:

1. Space is cut into cells: quartiles of the projections on g further directions, where g follows the number of vectors, so
   that a cell has about `shard_rows`. A larger cell is split by a hash of the id; every vector is indexed.
2. A query is searched in its own cell. The distance of its k-th best there bounds what can still matter.
3. With that bound it goes to the cells whose ranges of projections lie within CELL_REACH times the bound of its own, and
   opens its windows there at once. Each further direction rules out a share of the cells, so the share that a query
   meets falls as vectors grow. Without k vectors in its own cell it goes to all cells.

Queries of a cell come in blocks of at most about `block_rows`, so a group has a bounded size. Equal vectors lie in one
cell; of those only the k + 1 smallest ids are indexed, as no query can have more of them among its k nearest.

Defined cases: rows with a null id, or a vector that is null, empty, zero or has a null or non-finite component take no
part; candidates are vectors of the query's length; of rows with equal ids the smallest vector counts; fewer candidates
than k: all of them; ties go to the smaller id; no vectors or queries: no rows. Further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import release
from lorespark.operators.tables import written

#: Half the width of a window, in units of the distance that it must reach.
REACH = 1.5
#: A vector this many times as far as the k-th nearest is far; shares of near ones that are missed, and of far ones that pass.
RATIO, MISSED, PASSED = 1.25, 0.03, 0.15
#: Distances within which 99 of 100 projections of a distance fall: how far a cell may lie from a query.
CELL_REACH = 2.576
#: Rounding of projections.
ROUNDING = 1e-9
#: Parts that each direction of the cells is cut into.
PARTS = 4
#: Decimals in which cosines are compared.
DECIMALS = 12
SEED = 11


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((n, dim))


def plan(reach: float = REACH, ratio: float = RATIO, missed: float = MISSED, passed: float = PASSED) -> tuple[int, int]:
    """Number of arrays, and of collisions that make a candidate."""
    normal = NormalDist()
    near, far = (2 * normal.cdf(reach / r) - 1 for r in (1.0, ratio))
    near_z, far_z = -normal.inv_cdf(missed), -normal.inv_cdf(passed)
    arrays = math.ceil(((near_z * math.sqrt(near * (1 - near)) + far_z * math.sqrt(far * (1 - far))) / (near - far)) ** 2)
    return arrays, math.floor(arrays * near - near_z * math.sqrt(arrays * near * (1 - near)))


class CollisionIndex:
    """Sorted projections of the vectors of one group.

    A window is a range of ranks in a sorted array, so a vector's collisions are the arrays in which its rank is in the
    window. All arrays are tested at once; widening a window only moves its two ranks.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, arrays: int | None = None, least: int | None = None, widen: float = 1.3, seed: int = SEED) -> None:
        self.ids, self.vectors, self.widen = ids, vectors, widen
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        planned = plan()
        arrays = planned[0] if arrays is None else arrays
        self.least = planned[1] if least is None else least
        self.directions = directions(vectors.shape[1], arrays, seed)
        at = ((vectors / self.norms[:, None]) @ self.directions.T).T
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=1)
        self.rank = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.ranks = np.empty(at.shape, dtype=self.rank)
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=self.rank)[None, :], axis=1)

    def colliding(self, centre: np.ndarray, reach: float) -> np.ndarray:
        """The vectors that are in enough of the windows of centre +- reach."""
        low = np.array([s.searchsorted(c - reach, side="left") for s, c in zip(self.sorted, centre, strict=True)])
        high = np.array([s.searchsorted(c + reach, side="right") for s, c in zip(self.sorted, centre, strict=True)])
        # numbers wrap, so ranks under the window are beyond its width, too; a window of all has no other ranks
        inside = self.ranks - low.astype(self.rank)[:, None] < (high - low).astype(self.rank)[:, None]
        return np.flatnonzero(np.add.reduce(inside, axis=0, dtype=np.uint16) >= self.least)

    def nearest(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query's row, id and cosine of the k nearest found of each query, and how many vectors were verified for it. own: ids that the queries must not find; bound: distance (of unit vectors) beyond which nothing matters, NaN: unknown."""
        size = np.sqrt((queries * queries).sum(axis=1))
        centre = (queries / size[:, None]) @ self.directions.T
        out = []
        for q in range(len(queries)):
            known = not np.isnan(bound[q])
            reach = REACH * bound[q] + ROUNDING if known else 0.1
            verified = self.ids == own[q]
            others = len(self.ids) - int(verified.sum())
            at, cosine = np.empty(0, dtype=np.int64), np.empty(0)
            while True:
                found = self.colliding(centre[q], reach)
                found = found[~verified[found]]
                verified[found] = True
                at = np.concatenate([at, found])
                cosine = np.concatenate([cosine, (self.vectors[found] @ queries[q]) / (self.norms[found] * size[q])])
                compared = np.round(cosine, DECIMALS)
                least = np.partition(compared, len(at) - k)[len(at) - k] if len(at) >= k else -2.0
                # no wider than the k-th best so far asks for
                enough = REACH * np.sqrt(max(0.0, 2 - 2 * least)) + ROUNDING if len(at) >= k else np.inf
                if known or len(at) == others or reach >= enough:
                    break
                reach = min(reach * self.widen, enough)
            best = np.flatnonzero(compared >= least)
            best = best[np.lexsort((self.ids[at[best]], -compared[best]))[:k]]
            # the order of a product's sum depends on how many rows it has: the reported ones are summed alike
            exact = (self.vectors[at[best]] * queries[q]).sum(axis=1) / (self.norms[at[best]] * size[q])
            out.append((np.full(len(best), q), self.ids[at[best]], exact, np.full(len(best), len(at))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return np.asarray(whole.flatten(), dtype=np.float64).reshape(len(whole), -1)


def _search(k: int, index: dict):
    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        if have.num_rows and ask.num_rows:
            at = CollisionIndex(np.asarray(have.column("id")), _matrix(have.column("v")), **index)
            ids = np.asarray(ask.column("id"))
            row, found, cosine, verified = at.nearest(ids, _matrix(ask.column("v")), np.asarray(ask.column("bound").fill_null(np.nan), dtype=np.float64), k)
            # the number is told once for each query
            columns = [ids[row], found, cosine, np.where(np.append(True, row[1:] != row[:-1]), verified, 0)[: len(row)]]
            del at
            release()
        else:
            columns = [[], [], [], []]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "verified"])

    return run


def _projected(g: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                v = np.asarray(part.column("v").flatten(), dtype=np.float64).reshape(-1, d)
                at = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ directions(d, g, SEED + 1).T
                yield pa.RecordBatch.from_arrays([part.column("dim"), part.column("id"), part.column("v"), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), g).cast(pa.list_(pa.float64()))], ["dim", "id", "v", "at"])

    return run


def _digits(at: np.ndarray, cuts: np.ndarray, side: str = "right") -> np.ndarray:
    """In which part of each direction the projections lie."""
    return np.stack([np.searchsorted(c, x, side=side) for c, x in zip(cuts, at.T, strict=True)], axis=1)


def _cells(cuts: dict[int, np.ndarray], g: int):
    """Rows with the cell they are in."""
    weights = PARTS ** np.arange(g, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = np.asarray(b.column("dim")), np.zeros(b.num_rows, dtype=np.int64)
            if b.num_rows:
                at = np.asarray(b.column("at").flatten()).reshape(-1, g)
                for d in np.unique(dims).tolist():
                    cell[dims == d] = _digits(at[dims == d], cuts[d]) @ weights
            yield pa.RecordBatch.from_arrays([b.column("dim"), pa.array(cell), b.column("id"), b.column("v"), b.column("at")], ["dim", "cell", "id", "v", "at"])

    return run


def _reached(cuts: dict[int, np.ndarray], g: int):
    """A row for each other cell that a query may reach; cells that are not there fall out in the join that follows."""
    weights = PARTS ** np.arange(g, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, own = np.asarray(b.column("at").flatten()).reshape(-1, g), np.asarray(b.column("cell"))
            bound = np.asarray(b.column("bound").fill_null(np.inf), dtype=np.float64)[:, None] * CELL_REACH + ROUNDING
            row, cells = [], []
            for r, d in enumerate(np.asarray(b.column("dim")).tolist()):
                low, high = _digits(at[r : r + 1] - bound[r], cuts[d], "left")[0], _digits(at[r : r + 1] + bound[r], cuts[d])[0]
                found = np.zeros(1, dtype=np.int64)
                for j in range(g):
                    found = (found[:, None] + weights[j] * np.arange(low[j], high[j] + 1)).ravel()
                found = found[found != own[r]]
                cells.append(found)
                row.append(np.full(len(found), r))
            pick = np.concatenate(row)
            for a in range(0, len(pick), 1 << 14):
                part = b.select(["dim", "id", "v", "bound"]).take(pa.array(pick[a : a + (1 << 14)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(cells)[a : a + (1 << 14)])], ["dim", "id", "v", "bound", "cell"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, block_rows: int = 1024, **index: float) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) and verified (how many vectors the query was compared with exactly). is_query: a condition on the column `id`."""
    v, key = F.col("v"), ["dim", "cell"]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    have, asked = rows.withColumn("copy", copies).filter(F.col("copy") <= k + 1).drop("copy"), rows.filter(is_query)
    count, g = rows.count(), 1
    while PARTS**g * shard_rows < count:
        g += 1
    shape = "dim int, id long, v array<double>, at array<double>"
    have, asked = (x.select("dim", "id", "v").mapInArrow(_projected(g), shape) for x in (have, asked))
    have = written(have)
    fractions = [p / PARTS for p in range(1, PARTS)]
    # a few numbers for each length of vectors
    made = have.groupBy("dim").agg(*(F.percentile_approx(F.col("at")[j], fractions, 1000).alias(f"c{j}") for j in range(g))).collect()
    cuts = {r["dim"]: np.array([r[f"c{j}"] for j in range(g)]) for r in made}
    if count <= shard_rows:
        cuts = {d: np.full((g, PARTS - 1), np.inf) for d in cuts}  # one cell
    shape = "dim int, cell long, id long, v array<double>, at array<double>"
    have, asked = have.mapInArrow(_cells(cuts, g), shape), written(asked.mapInArrow(_cells(cuts, g), shape))
    sizes = written(have.groupBy(*key).agg(F.ceil(F.count("*") / shard_rows).alias("subs")))

    def searched(ask: DataFrame) -> DataFrame:
        ask = ask.join(sizes, key)
        blocks = ask.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).alias("blocks"), F.first("subs").alias("subs"))
        left = have.join(blocks, key).withColumn("sub", F.pmod(F.xxhash64("id"), "subs")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = ask.join(blocks.drop("subs"), key).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        by = [*key, "sub", "block"]
        left, right = left.select(*by, "id", "v"), right.select(*by, "id", "v", "bound")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k, index), "query_id long, vec_id long, score double, verified long")
        return written(ranked(found))

    def ranked(found: DataFrame) -> DataFrame:
        whole = Window.partitionBy("query_id")
        rank = F.row_number().over(whole.orderBy(F.desc("score"), "vec_id"))
        counted = found.withColumns({"verified": F.sum("verified").over(whole), "rank": rank})
        return counted.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")

    near = searched(asked.select("dim", "cell", "id", "v", F.lit(None).cast("double").alias("bound")))
    if count <= shard_rows:
        return near
    bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))
    further = asked.join(bound, "id", "left").select("dim", "cell", "id", "v", "at", "bound").mapInArrow(_reached(cuts, g), "dim int, id long, v array<double>, bound double, cell long")
    # each part's number is of a query, on all its rows: told once again
    once = [x.withColumn("verified", F.when(F.col("rank") == 1, F.col("verified")).otherwise(0)).drop("rank") for x in (near, searched(further))]
    return ranked(once[0].union(once[1]))
