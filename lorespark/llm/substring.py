"""Substring dedup: words covered by a passage that also starts in a document with a smaller id go.

A window is `length` consecutive words. The method is an FM-index per shard with backward search; shards are made so that
each only holds passages that may repeat, and none grows with the number of copies:

1. Each window picks an anchor: its run of `anchor` words with the smallest hash. Equal windows pick equal anchors, so a
   window found in two documents has its anchor in both. Documents lie in buckets by a hash of the id; each bucket tells
   its distinct anchors, how often it has them, and its smallest and largest document that has them, and learns which
   anchors occur in more than one document overall.
2. Around each such anchor a bucket cuts the passage of all windows that picked it, and sends each distinct passage once,
   with the smallest and the largest document, to the shard of the anchor. An anchor of more than HOT occurrences may have as
   many different passages as there are contexts at its edges; of such an anchor each window is a passage of its own, and
   goes to the shard of the window.
3. A shard streams its distinct passages through an FM-index over all of them. Backward search gives the matching statistic
   at the end of each window, as far as `length` words; the window's suffix interval holds all its occurrences, and a
   wavelet matrix and the smallest document of each suffix are all that is kept of the index. The bucket gets back the
   smallest document of each window, for the passages where it matters.
4. Each bucket removes the covered words of its documents.

A passage with millions of copies costs one row a bucket in each shuffle. All windows are searched in the shard that all
their occurrences reached, so the result is exact up to 64-bit hash collisions of words and passages.

Defined cases: a null text has no words; a text of fewer than `length` words is left whole; a null id neither removes
nor is removed (such rows lie in buckets by their text); rows with equal ids do not remove each other's words; repeats
inside one document stay; an empty table gives no rows. Windows are judged on the input, not on what is left. Further input
columns, whatever their names, are ignored by dedup and kept by dedup_texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import partitions, release, rolling, scanned, slices, texts
from lorespark.llm.fmindex import FmIndex

NONE = np.iinfo(np.int64).max
#: Buckets and shards for each of the session's shuffle partitions: small groups, as a task holds one whole.
BUCKETS, SHARDS = 4, 4
#: Occurrences of an anchor beyond which its windows are dealt one by one.
HOT = 4096


def anchored(h: np.ndarray, row: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that pick the same anchor: the first and last start of each run, and the anchor's hash. row: each word's text."""
    none = np.empty(0, dtype=np.int64)
    if len(h) < length:
        return none, none, none.astype(np.uint64)
    least, wide, every = rolling(h, anchor), 1, length - anchor + 1
    while wide < every:  # minima over 2, 4, 8, ... neighbours, then over all that a window has
        step = min(wide, every - wide)
        least, wide = np.minimum(least[: len(least) - step], least[step:]), wide + step
    starts = np.flatnonzero(row[: len(h) - length + 1] == row[length - 1 :])
    if not len(starts):
        return none, none, none.astype(np.uint64)
    pick = least[starts]
    first = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return starts[first], starts[np.append(first[1:], len(starts)) - 1], pick[first]


def cut_runs(first: np.ndarray, last: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each passage, and its run: a run of windows is one passage, or each window where hot."""
    sizes = np.where(hot, last - first + 1, 1)
    run = np.repeat(np.arange(len(first)), sizes)
    step = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = first[run] + step
    return begin, np.where(hot[run], begin, last[run]), run


def passage_key(passage: bytes) -> int:
    return xxhash.xxh3_64_intdigest(passage) - (1 << 63)


def _found(anchors: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each anchor is among anchors (sorted); -1: nowhere."""
    if not len(anchors):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(anchors, key), len(anchors) - 1)
    return np.where(anchors[at] == key, at, -1)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers, NONE for null."""
    return np.asarray(pc.fill_null(column, int(NONE)), dtype=np.int64)


def _pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
    return slices(iter(t.to_batches()), "text")


def tell_anchors(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in slices(batches, "text"):
            ids, bucket = _ids(batch.column("id")), np.asarray(batch.column("bucket"))
            *_, h, row = scanned(texts(batch, "text"))
            first, _, key = anchored(h, row, length, anchor)
            found.append((bucket[row[first]], key, ids[row[first]]))
        if not found:
            return
        bucket, key, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = ids != NONE
        bucket, key, ids = bucket[keep], key[keep], ids[keep]
        if not len(key):
            return
        order = np.lexsort((ids, key, bucket))
        bucket, key, ids = bucket[order], key[order], ids[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
        last = np.append(first[1:], len(key)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[first], key[first].view(np.int64), ids[first], ids[last], (last - first + 1).astype(np.int32))], ["bucket", "anchor", "low", "high", "n"])
        del found, bucket, key, ids, order, first, last, keep
        release()

    return run


def tell_passages(length: int, anchor: int):
    """For a bucket's documents and its shared anchors: the distinct passages, with their smallest and largest document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.asarray(right.column("anchor"), dtype=np.int64)
        order = np.argsort(shared)
        shared, is_hot = shared[order], np.asarray(right.column("hot").to_numpy(zero_copy_only=False), dtype=bool)[order]
        number: dict[bytes, int] = {}  # a passage has one anchor
        anchors, hots, low, high = [], [], [], []
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        for batch in _pieces(left) if len(shared) else ():
            ids = _ids(batch.column("id"))
            whole, begin, end, h, row = scanned(texts(batch, "text"))
            first, last, key = anchored(h, row, length, anchor)
            at = _found(shared, key.view(np.int64))
            hit = np.flatnonzero((at >= 0) & (ids[row[first]] != NONE))
            a, b, runs = cut_runs(first[hit], last[hit], is_hot[at[hit]])
            spans = begin[a].tolist(), end[b + length - 1].tolist()
            for x, y, k, w, i in zip(*spans, key.view(np.int64)[hit][runs].tolist(), is_hot[at[hit]][runs].tolist(), ids[row[a]].tolist(), strict=True):
                n = number.setdefault(b" ".join(whole[x:y].split()), len(anchors))
                if n == len(anchors):
                    anchors.append(k)
                    hots.append(w)
                    low.append(i)
                    high.append(i)
                elif i < low[n]:
                    low[n] = i
                elif i > high[n]:
                    high[n] = i
        deal = [passage_key(p) if w else k for p, k, w in zip(number, anchors, hots, strict=True)]
        made = pa.table(
            {
                "deal": pa.array(deal, pa.int64()),
                "anchor": pa.array(anchors, pa.int64()),
                "hot": pa.array(hots, pa.bool_()),
                "bucket": pa.array(np.full(len(anchors), bucket, dtype=np.int32)),
                "passage": pa.array(number, pa.binary(), size=len(number)),
                "low": pa.array(low, pa.int64()),
                "high": pa.array(high, pa.int64()),
            }
        )
        del number, anchors, hots, low, high, deal
        release()
        return made

    return run


def search_shard(length: int):
    """For a shard's passages: the smallest document of each window, for the buckets with a larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        coded = t.column("passage").combine_chunks().dictionary_encode()
        passages, which = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
        anchor, bucket, low, high = (np.asarray(t.column(c), dtype=np.int64) for c in ("anchor", "bucket", "low", "high"))
        hot = np.asarray(t.column("hot").to_numpy(zero_copy_only=False), dtype=bool)
        del t, coded, rows
        owner = np.full(len(passages), NONE)
        np.minimum.at(owner, which, low)
        *_, h, row = scanned(passages)
        lengths = np.bincount(row, minlength=len(passages)) + 1
        ends = np.cumsum(lengths) - 1
        symbols = np.zeros(len(h) + len(passages), dtype=np.int64)
        symbols[np.arange(len(h)) + row] = np.unique(h, return_inverse=True)[1] + 1
        del h, row
        index = FmIndex(symbols, length)
        owner_of = np.append(np.repeat(owner, lengths)[index.suffixes], NONE)
        del index.suffixes  # a suffix's smallest document is all that is asked for
        sizes = lengths - length
        last = np.cumsum(sizes)
        begin = last - sizes
        starts = np.repeat(ends - lengths + 1 - begin, sizes) + np.arange(last[-1])
        mins = np.repeat(owner, sizes)
        windows = np.lib.stride_tricks.sliding_window_view(symbols, length)
        for k in range(0, len(starts), 1 << 15):
            # an interval of one suffix is the passage's own, whatever is left to match
            a, b, matched = index.search(windows[starts[k : k + (1 << 15)]])
            assert ((matched == length) | (b - a == 1)).all()
            least = owner_of[a]
            many = np.flatnonzero(b - a > 1)
            if len(many):
                # intervals of different windows are disjoint: each is looked through once, however many windows have it
                low_at, at, same = np.unique(a[many], return_index=True, return_inverse=True)
                borders = np.stack([low_at, b[many][at]], axis=1).ravel()
                least[many] = np.minimum.reduceat(owner_of, borders)[::2][same]
            mins[k : k + (1 << 15)] = least
        asked = np.flatnonzero(np.minimum.reduceat(mins, begin)[which] < high)
        at = which[asked]
        keys = [passage_key(passages[p]) for p in at.tolist()]
        flat = mins[np.repeat(begin[at] - (np.cumsum(sizes[at]) - sizes[at]), sizes[at]) + np.arange(sizes[at].sum())]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[at])]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[asked], pa.int32()), pa.array(anchor[asked]), pa.array(hot[asked]), pa.array(keys, pa.int64()), lists], ["bucket", "anchor", "hot", "key", "owners"])
        del index, symbols, windows, starts, mins, owner_of, passages, keys, lists, flat
        release()

    return run


def remove(length: int, anchor: int, names: list[str], schema: pa.Schema):
    """A bucket's documents with the words that stay."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, owners = np.asarray(right.column("key"), dtype=np.int64), right.column("owners").combine_chunks()
        at = {k: n for n, k in enumerate(keys.tolist())}
        anchors, nth = np.unique(np.asarray(right.column("anchor"), dtype=np.int64), return_index=True)
        is_hot = np.asarray(right.column("hot").to_numpy(zero_copy_only=False), dtype=bool)[nth]
        begins, values = np.asarray(owners.offsets, dtype=np.int64), np.asarray(owners.values, dtype=np.int64)
        parts = []
        for batch in _pieces(left):
            ids, raw = _ids(batch.column("id")), texts(batch, "text")
            whole, begin, end, h, row = scanned(raw)
            total = np.bincount(row, minlength=len(raw))
            gone = np.zeros(len(raw), dtype=np.int64)
            kept = [b" ".join(t.split()) for t in raw]
            if len(anchors) and len(h):
                first, last, key = anchored(h, row, length, anchor)
                place = _found(anchors, key.view(np.int64))
                hit = np.flatnonzero((place >= 0) & (ids[row[first]] != NONE))
                starts, stops, _ = cut_runs(first[hit], last[hit], is_hot[place[hit]])
                spans = begin[starts].tolist(), end[stops + length - 1].tolist()
                found = np.array([at.get(passage_key(b" ".join(whole[a:b].split())), -1) for a, b in zip(*spans, strict=True)], dtype=np.int64)
                starts, found = starts[found >= 0], found[found >= 0]
                sizes = begins[found + 1] - begins[found]
                step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                earlier = values[np.repeat(begins[found], sizes) + step] < np.repeat(ids[row[starts]], sizes)
                starts = (np.repeat(starts, sizes) + step)[earlier]
                cover = np.bincount(starts, minlength=len(h) + 1) - np.bincount(starts + length, minlength=len(h) + 1)
                stay = np.cumsum(cover[:-1]) == 0
                gone = np.bincount(row[~stay], minlength=len(raw))
                ends = np.cumsum(total)
                for k in np.flatnonzero(gone).tolist():
                    mine = stay[ends[k] - total[k] : ends[k]].tolist()
                    kept[k] = b" ".join([w for w, s in zip(raw[k].split(), mine, strict=True) if s])
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            parts.append(pa.Table.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "n_words", "n_removed", "kept"]))
        release()
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _deduped(docs: DataFrame, id_col: str, text_col: str, length: int, anchor: int) -> DataFrame:
    """The rows of docs, its columns but the text named c0, c1, ... by their places; id, text, n_words, n_removed and kept (the words that stay, joined by a space)."""
    spark = docs.sparkSession
    n = BUCKETS * partitions(spark)
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).withColumns({"id": F.col(key).cast("long"), "text": F.col(text).cast("string")}).drop(text)
    names = rows.columns
    bucket = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(n)).cast("int")
    placed = rows.withColumn("bucket", bucket).repartition(n, "bucket")
    # every step takes placed as it is, so that Spark shuffles the texts once and uses them again
    told = placed.mapInArrow(tell_anchors(length, anchor), "bucket int, anchor long, low long, high long, n int")
    over = Window.partitionBy("anchor")
    shared = told.withColumns({"a": F.min("low").over(over), "b": F.max("high").over(over), "hot": F.sum("n").over(over) > HOT}).filter("a < b").select("bucket", "anchor", "hot")
    passages = placed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(tell_passages(length, anchor), "deal long, anchor long, hot boolean, bucket int, passage binary, low long, high long")
    answers = passages.repartition(SHARDS * partitions(spark), "deal").mapInArrow(search_shard(length), "bucket int, anchor long, hot boolean, key long, owners array<long>")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "bucket")
    schema = f"{fields}, n_words long, n_removed long, kept string"
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return placed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(remove(length, anchor, names, empty), schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, anchor: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed and kept of each row."""
    out = _deduped(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", "t", length, anchor)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept")


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, anchor: int = 5) -> DataFrame:
    """The rows of docs, all columns; texts that lose words have the kept ones joined by a space, the others stay as they are."""
    out = _deduped(docs, id_col, text_col, length, anchor)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")).alias(text_col)
    return out.select(*(text if c == text_col else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
