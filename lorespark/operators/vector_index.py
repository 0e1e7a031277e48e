"""A table of vectors with coarse cells and short codes, so that a search reads the cells near its query and not all vectors.

Cells are the centroids of a k-means over a bounded sample of the vectors there are at first, scaled to length 1. Each
vector is in the cell of its most similar centroid, and has a code: what it is beside its centroid, in one signed byte a
dimension, with its own scale. Rows lie in files by range of cell, sorted, so a filter on cells skips row groups.

search() probes the `probes` cells nearest to a query, ranks their rows by codes, and takes the best `again` of these for an
exact comparison with the vectors themselves. The probe list is exact on codes of the probed cells: no cell is cut, and a cell
that very many vectors lie in is read in as many tasks as its files have. So results can miss a neighbour that lies in a cell
not probed, or one that codes place too low; `share` of the result says how many vectors were read.

Insertions and deletions are commits of a Store: cells belong to ranges of ids there, and change with the row. Centroids stay as
they are until rebuild() is called, as a cell does not depend on what else is in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.vectors import BLOCK, top_k
from lorespark.operators.tables import written
from lorespark.sources.sinks import Store

#: Vectors that centroids are fitted on at most, rounds of k-means, and cells at most: the probe of a query looks at all centroids.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 4096


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means. A cell that loses its vectors gets the one that is worst placed."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    c = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        at = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(s.max(axis=1))[: len(empty)]]
        c = unit(sums)
    return c


def fit(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids from at most `sample` vectors, chosen by a hash of the id. cells: about the root of the number of vectors, else."""
    have = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    count = have.count()
    cells = min(MOST_CELLS, max(1, round(count**0.5))) if cells is None else cells
    rows = have.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vector_col).cast("array<double>").alias("v")).collect()
    return centroids(np.array([r.v for r in rows], dtype=np.float64), cells) if rows else np.zeros((0, 0))


def coded(vectors: DataFrame, centres: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The rows with cell, scale and code. centres: of MOST_CELLS at most, so each task may have them."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kept = [c for c in vectors.columns if c not in ("cell", "scale", "code")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            column = b.column(b.schema.get_field_index(vector_col))
            v = unit(np.asarray(column.flatten(), dtype=np.float64).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, c.shape[1]))
            cell = (v @ c.T).argmax(axis=1)
            rest = v - c[cell]
            scale = np.abs(rest).max(axis=1, initial=0) / 127
            code = np.round(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in kept), pa.array(cell.astype(np.int32)), pa.array(scale), pa.array([x.tobytes() for x in code], pa.binary())], [*kept, "cell", "scale", "code"])

    shape = ", ".join(f"`{x}` {vectors.schema[x].dataType.simpleString()}" for x in kept)
    return vectors.select(*kept).filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == centres.shape[1])).mapInArrow(run, f"{shape}, cell int, scale double, code binary")


def search(table: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 8, again: int | None = None, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "v") -> tuple[DataFrame, dict[str, int]]:
    """query_id, id_col, similarity (cosine, 0 at least, to 4 digits) and rank of the k nearest found of each query, ties to the smaller id; and how many vectors there are and were read.

    table: as coded. Queries of up to BLOCK go to every task; more go in blocks, one after the other.
    """
    spark, again = table.sparkSession, again or 8 * k
    kind = table.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == centres.shape[1]))
    n = asked.count()
    blocks = max(1, -(-2 * n // BLOCK)) if n > BLOCK else 1
    parts, read = [], set()
    for b in range(blocks):
        few = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about half of BLOCK
        if not few or not len(centres):
            continue
        names, q = np.array([r.q for r in few], dtype=np.int64), unit(np.array([r.v for r in few], dtype=np.float64))
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        cells = sorted(set(near.ravel().tolist()))
        read.update(cells)
        wants: dict[int, np.ndarray] = {c: np.flatnonzero((near == c).any(axis=1)) for c in cells}
        shared = spark.sparkContext.broadcast((names, q, centres, wants))
        rows = table.filter(F.col("cell").isin(cells))
        picked = rows.select(id_col, "cell", "scale", "code", F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(_near(shared, again, k), f"q long, {id_col} {kind}, guess double, similarity double")
        # a batch has compared its own best exactly; those that are among the best of all by code count
        parts.append(written(top_k(picked, ["q"], [F.desc("guess"), F.col(id_col)], again).drop("rank")))
    shape = f"query_id long, {id_col} {kind}, similarity double, rank int"
    if not parts:
        return spark.createDataFrame([], shape), {"vectors": table.count(), "read": 0}
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = top_k(every.withColumnRenamed("q", "query_id"), ["query_id"], [F.desc("similarity"), F.col(id_col)], k).select("query_id", id_col, "similarity", "rank")
    size = table.groupBy("cell").count()
    counted = size.agg(F.sum("count"), F.sum(F.when(F.col("cell").isin(sorted(read)), F.col("count")))).first()
    return best, {"vectors": int(counted[0] or 0), "read": int(counted[1] or 0)}


def _near(shared, again: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, centres, wants = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, cells = np.array(b.column(0).to_pylist(), dtype=object), np.asarray(b.column("cell"))
            scale = np.asarray(b.column("scale"))
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.int8).reshape(b.num_rows, -1)
            vectors = np.asarray(b.column("vector").flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for c in np.unique(cells).tolist():
                at, who = np.flatnonzero(cells == c), wants[c]
                guess = (queries[who] @ centres[c])[:, None] + (queries[who] @ code[at].T.astype(np.float64)) * scale[at]
                for n, w in enumerate(who.tolist()):
                    found.setdefault(w, []).append((at, guess[n]))
            q, row, guesses = [], [], []
            for w, parts in found.items():
                at, guess = (np.concatenate(x) for x in zip(*parts, strict=True))
                first = np.argsort(-guess, kind="stable")[:again]
                # ties at the end stay in
                first = np.flatnonzero(guess >= guess[first[-1]]) if len(guess) > again else first
                q.append(np.full(len(first), w))
                row.append(at[first])
                guesses.append(guess[first])
            q, row, guesses = (np.concatenate(x) for x in (q, row, guesses))
            exact = np.round(np.maximum((unit(vectors[row]) * queries[q]).sum(axis=1), 0.0), 4)
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[row].tolist(), b.schema.types[0]), pa.array(guesses), pa.array(exact)], ["q", b.schema.names[0], "guess", "similarity"])

    return run


class VectorIndex:
    """Coded vectors as a table of a store: rows (relpath, id, vector) change with their documents, in its commits. The centroids are a document of their own, so that a reader never sees codes of others."""

    CENTROIDS = ""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root, {"vectors": "relpath", "centroids": "relpath"})

    def centres(self, at: int | None = None) -> np.ndarray:
        rows = self.store.read("centroids", self.CENTROIDS, at).orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), -1)

    def _table(self, centres: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame([(self.CENTROIDS, k, c.tolist()) for k, c in enumerate(centres)], "relpath string, cell int, vector array<double>")

    def _commit(self, rows: DataFrame, centres: np.ndarray, new: bool, gone: DataFrame | None, after: int) -> None:
        made = coded(rows.select("relpath", "id", "vector"), centres).repartitionByRange("cell").sortWithinPartitions("cell")
        self.store.commit({"vectors": made, "centroids": self._table(centres if new else centres[:0])}, gone, after)

    def put(self, rows: DataFrame, gone: DataFrame | None = None, cells: int | None = None) -> None:
        """Rows of documents in place of those they had; gone: relpath of documents that go. The first call fits the centroids."""
        after = self.store.latest()
        centres = self.centres(after) if after else fit(rows, "id", "vector", cells)
        self._commit(rows, centres, not after, gone, after)

    def rebuild(self, cells: int | None = None) -> None:
        """New centroids from what is stored now, and all rows coded anew."""
        after = self.store.latest()
        rows = written(self.store.read("vectors", at=after).select("relpath", "id", "vector"))
        self._commit(rows, fit(rows, "id", "vector", cells), True, None, after)

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> tuple[DataFrame, dict[str, int]]:
        at = self.store.latest()
        return search(self.store.read("vectors", at=at), self.centres(at), queries, k, probes)
