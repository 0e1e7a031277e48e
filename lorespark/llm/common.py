"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.tables import partitions, written  # noqa: F401

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def held_out(id_col: str, n: int) -> Column:
    """True where crc32 of the id as text is 2 modulo n; a null id is never held out."""
    return F.coalesce(crc_bucket(id_col, n) == 2, F.lit(False))


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns used, so that others, whatever their names, do no harm. Texts stay strings."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has about `size` bytes of text, or one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        piece = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives unused memory back to the system: a Python worker may wait long for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order looks random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words. The dictionary is emptied when it is full, so memory is bounded."""

    def __init__(self, most: int = 400_000) -> None:
        import xxhash

        self.hash, self.most, self.known = xxhash.xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, get = self.known, self.known.get
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in set(words):
                if get(w) is None:
                    known[w] = self.hash(w)
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes: a polynomial, then mixed. Shorter inputs give none."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - n + 1 + k]
    return mixed(out)


#: Bytes that word hashes are computed for at once, but for longer words.
BLOCK_BYTES = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> list[np.ndarray]:
    """FACTOR to the powers 0, 1, ..., and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, f in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            steps = np.full(n, f, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def scanned(rows: list[bytes], separator: np.ndarray = _SPACE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row, and of each word its begin, its end, its 64-bit hash and its text's number. separator: for each byte whether it parts words; a line feed must.

    Hashes are polynomials over bytes, taken for all words at once as differences of running sums.
    """
    whole = b"\n".join(rows)
    b = np.frombuffer(whole, dtype=np.uint8)
    inside = ~separator[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    hashes = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        low = begin[at]
        to = max(at + 1, int(np.searchsorted(end, low + BLOCK_BYTES, side="right")))
        n = int(end[to - 1] - low)
        up, down = _powers(max(n + 1, BLOCK_BYTES + 1))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((b[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = begin[at:to] - low, end[at:to] - low
        hashes[at:to] = mixed((sums[e] - sums[s]) * down[s])
        at = to
    starts = np.cumsum(np.fromiter((len(r) + 1 for r in rows), dtype=np.int64, count=len(rows)))
    return whole, begin, end, hashes, np.searchsorted(starts, begin, side="right")
