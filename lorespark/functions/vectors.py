"""Vector functions: a hashing embedder, cosine similarity, and exact search in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import tokens

DIMENSIONS = 128
#: Query vectors, and vectors of the base, that a group holds at once; tokens whose buckets a task remembers.
BLOCK, SHARD, MOST_KNOWN = 1024, 8192, 200_000
#: Similarities, and tokens (of one text at least), that a task has at hand at once.
CELLS, TOKENS = 1 << 19, 1 << 17


def _buckets(found: pa.Array, dimensions: int, known: dict[str, int]) -> np.ndarray:
    """Buckets of tokens; known ones are looked up, and each different one is a string of Python once."""
    coded = found.dictionary_encode()
    names = coded.dictionary.to_pylist()
    for t in names:
        if t not in known:
            known[t] = int(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dimensions
    return np.array([known[t] for t in names], dtype=np.int64)[np.asarray(coded.indices)] if names else np.empty(0, dtype=np.int64)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that have no more than `most` together, or are one row."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + most, "right")))
        yield begin, end
        begin = end


def embedded(docs: DataFrame, id_col: str, text_col: str, *more: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """id_col, further columns and vector: counts of a text's tokens by bucket, scaled to length 1; all 0 without tokens. Each text is embedded where it lies, with no shuffle; only its tokens and its vector pass between the JVM and Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(whole.column(whole.num_columns - 1)), 0), dtype=np.int64)
            # a run has 1,024 texts at most, which bounds its vectors
            for begin, end in _runs(np.maximum(lengths, TOKENS // 1024), TOKENS):
                *kept, rows = whole.slice(begin, end - begin).columns
                sizes = lengths[begin:end]
                if len(known) > MOST_KNOWN:
                    known.clear()
                at = _buckets(rows.flatten(), dimensions, known)
                counts = np.bincount(np.repeat(np.arange(len(sizes)) * dimensions, sizes) + at, minlength=len(sizes) * dimensions).reshape(-1, dimensions).astype(np.float64)
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                v = np.divide(counts, norm, out=counts, where=norm > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dimensions), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*kept, lists], [*whole.schema.names[:-1], "vector"])

    names = [id_col, *more]
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, tokens(F.col(text_col)).alias("__tokens")).mapInArrow(run, f"{shape}, vector array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is 0."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k a group before it shuffles."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), dtype=np.float64).reshape(len(whole), -1)


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first; the first of equal ones. Only what reaches the k-th largest is sorted."""
    if s.shape[1] <= 4 * k:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    out = np.empty((len(s), k), dtype=np.int64)
    for r, (row, low) in enumerate(zip(s, least, strict=True)):
        over, tied = np.flatnonzero(row > low), np.flatnonzero(row == low)
        at = np.append(over, tied[: k - len(over)])
        out[r] = at[np.lexsort((at, -row[at]))]
    return out


def _best(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and similarity of the k nearest of each query among some vectors; ties to the smaller id. At most CELLS similarities are held at once."""
    order = np.argsort(ids, kind="stable")
    ids, base = ids[order], _unit(base[order])
    places, values = np.empty((len(queries), 0), dtype=np.int64), np.empty((len(queries), 0))
    step = max(1, min(len(ids), 2048))
    high = max(1, CELLS // step)
    for begin in range(0, len(ids), step):
        found = []
        for top in range(0, len(queries), high):
            s = np.round(np.maximum(queries[top : top + high] @ base[begin : begin + step].T, 0.0), digits)
            first = _first(s, k)
            found.append((first + begin, np.take_along_axis(s, first, axis=1)))
        # what was found before has smaller ids, and stays first among equal ones
        places, values = np.hstack([places, np.vstack([f[0] for f in found])]), np.hstack([values, np.vstack([f[1] for f in found])])
        first = _first(values, k)
        places, values = np.take_along_axis(places, first, axis=1), np.take_along_axis(values, first, axis=1)
    return np.repeat(names, places.shape[1]), ids[places].ravel(), values.ravel()


def nearest(base: DataFrame, base_id: str, base_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, digits: int = 4) -> DataFrame:
    """query_id, base_id, similarity (cosine, 0 at least, rounded) and rank of the k nearest of each query, exactly.

    Up to BLOCK queries (they are counted first) go to every task, and the base stays where it lies. More are dealt to blocks,
    and the base to shards of SHARD rows; each block meets each shard in a group of bounded size. Similarities of a group, or
    a batch, are one product of matrices, of which k rows a query pass on; ties go to the smaller id.
    """
    spark = base.sparkSession
    rows = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("v is not null")
    have = base.select(base_id, F.col(base_vector).cast("array<double>").alias("v")).filter("v is not null")
    kind = base.schema[base_id].dataType.simpleString()
    shape = f"query_id long, {base_id} {kind}, similarity double"
    asked = rows.count()

    def table(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: pa.DataType) -> pa.Table:
        q, i, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pa.table([pa.array(q, pa.int64()), pa.array(i, ids), pa.array(s, pa.float64())], names=["query_id", base_id, "similarity"])

    if asked <= BLOCK:
        few = rows.collect()  # BLOCK at most
        shared = spark.sparkContext.broadcast((np.array([r.q for r in few], dtype=np.int64), _unit(np.array([r.v for r in few], dtype=np.float64).reshape(len(few), -1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for b in batches:
                for some in (b.slice(begin, SHARD) for begin in range(0, b.num_rows, SHARD) if len(names)):
                    yield from table([_best(names, matrix, np.array(some.column(0)), _matrix(some.column(1)), k, digits)], some.schema.types[0]).to_batches()

        found = have.mapInArrow(run, shape)
    else:
        blocks, shards = -(-asked // BLOCK), max(1, -(-base.count() // SHARD))
        left = have.withColumn("shard", F.pmod(F.xxhash64(base_id), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = rows.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

        def meet(some: pa.Table, ask: pa.Table) -> pa.Table:
            both = some.num_rows and ask.num_rows
            return table([_best(np.array(ask.column("q")), _unit(_matrix(ask.column("v"))), np.array(some.column(base_id)), _matrix(some.column("v")), k, digits)] if both else [], some.schema.field(base_id).type)

        left, right = left.withColumn("shard", F.col("shard").cast("long")), right.select("shard", "block", "q", "v")
        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, shape)
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col(base_id)], k)
