"""Benchmark decontamination: suffix arrays over the training documents, searched for every suffix of the test items.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is `window` consecutive words of an
item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

1. Test items become sequences of 64-bit word hashes, in pieces of bounded length that overlap by window - 1 words. Pieces
   are dealt to blocks whose size is checked; one block at a time is broadcast (`Settings.block` words). With several blocks
   the documents are read once for each, as every block is a query set of its own against all documents.
2. Documents are not shuffled. Each task cuts its documents into shards of `Settings.shard` words and builds each shard's
   suffix array: suffixes are ordered by prefix doubling, up to the length of the longest piece. A word that no item has
   ends every match, so suffixes in stretches of known words shorter than the shortest window are left out of the array.
3. All suffixes of the block are searched at once: interval by interval, one word further a step, with binary search for the
   next word's interval, until nothing matches. The interval at `window` words has all occurrences of the suffix's window, the
   last one that is not empty its longest verbatim match in the shard.
4. scan() has the hit words of each document and the items; longest() each item suffix's longest match over all shards and
   the first place of it; clean() the documents that are left.

No table grows with the number of occurrences: a passage in a third of all documents costs one row a document.

Defined cases: a null text has no words, in documents and items; items without words occur nowhere; equal item rows count
once; an item with a null id hits words but cannot be listed, so it is in neither items nor n_items; rows with equal ids are
rows of their own; empty tables give no hits or no rows; further columns are ignored by scan and kept by clean. Hash
collisions of 64 bits aside, results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import id_and_text, release, scanned, slices, texts, written
from lorespark.operators.tables import union_all

#: Separators: ASCII but digits and small letters, after A-Z are lower-cased.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[:128] = True
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    """window: words of a window; block: words of test items that are broadcast at once; piece: words of an item that stay together; shard: words of a suffix array, but for longer documents."""

    window: int = 10
    block: int = 1 << 20
    piece: int = 1 << 12
    shard: int = 1 << 20


@dataclass
class Tests:
    """A block of pieces: words as numbers (0 ends a piece), where each suffix that holds a window starts, its window's length, its item and its place there."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray
    widths: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: list[str | None]
    deepest: int


def item_pieces(window: int, piece: int):
    """Pieces of items: hashes of their words as bytes. The window is the item's own length where that is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("item_id").to_pylist()
            *_, h, row = scanned([t.translate(LOWER) for t in texts(batch)], SEPARATOR)
            at = np.searchsorted(row, np.arange(len(ids) + 1))
            out = []
            for k, name in enumerate(ids):
                words = h[at[k] : at[k + 1]]
                width = min(window, len(words))
                for a in range(0, max(len(words) - width + 1, 0) if width else 0, piece):
                    out.append((name, a, width, words[a : a + piece + width - 1].tobytes()))
            if out:
                names, first, width, words = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(first, pa.int64()), pa.array(width, pa.int32()), pa.array(words, pa.binary())], ["item_id", "first", "width", "words"])

    return run


def blocks(items: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The distinct pieces, written, each with its block, and how many blocks there are: as many as it takes for none to have more than twice s.block words."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(item_pieces(s.window, s.piece), "item_id string, first long, width int, words binary").distinct())
    size = F.length("words") / 8
    n = int(pieces.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] / s.block) + 1
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "first", "words"), F.lit(n)).cast("int"))
        if n == 1 or dealt.groupBy("block").agg(F.sum(size).alias("w")).agg(F.max("w")).first()[0] <= max(2 * s.block, 2 * (s.piece + s.window)):
            return dealt, n
        n *= 2


def tests_of(rows: list) -> Tests:
    """A block's pieces, made ready for the search."""
    words = [np.frombuffer(r.words, dtype=np.uint64) for r in rows]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    width = np.array([r.width for r in rows], dtype=np.int64)
    vocabulary, coded = np.unique(np.concatenate(words), return_inverse=True)
    symbols = np.zeros(int(sizes.sum()) + len(rows), dtype=np.int64)
    piece = np.repeat(np.arange(len(rows)), sizes)
    symbols[np.arange(len(coded)) + piece] = coded + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    many = sizes - width + 1
    which = np.repeat(np.arange(len(rows)), many)
    step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    names = sorted({r.item_id for r in rows if r.item_id is not None})
    number = {x: k for k, x in enumerate(names)}
    item = np.array([number.get(r.item_id, len(names)) for r in rows], dtype=np.int64)
    first = np.array([r.first for r in rows], dtype=np.int64)
    return Tests(vocabulary, symbols, begin[which] + step, width[which], item[which], first[which] + step, [*names, None], int(sizes.max()))


def suffix_order(symbols: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts, ordered by the first `depth` symbols behind each; a 0 ends a suffix. All places that a comparison meets before a 0 must be among the starts."""
    if not len(starts):
        return starts
    rank = np.zeros(len(symbols) + 1, dtype=np.int64)
    rank[starts] = symbols[starts]
    n, reach = int(symbols.max()) + 1, 1
    order = np.argsort(rank[starts], kind="stable")
    while True:
        if reach >= depth:
            return starts[order]
        key = rank[starts] * np.int64(n) + rank[np.minimum(starts + reach, len(symbols))]
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        new = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
        rank[starts[order]] = np.cumsum(new)
        n, reach = int(new.sum()) + 1, 2 * reach
        if n > len(starts):
            return starts[order]


@dataclass
class Found:
    """Of each test suffix: borders of its window's interval (equal: no occurrence), length of its longest match (0: less than a window) and one place of it; of each suffix of the array: its longest match with any test."""

    low: np.ndarray
    high: np.ndarray
    longest: np.ndarray
    place: np.ndarray
    best: np.ndarray


def search(symbols: np.ndarray, suffixes: np.ndarray, tests: Tests) -> Found:
    """Finds all test suffixes at once. Intervals narrow by one word a step: the suffixes in an interval are ordered by their next word, which binary search finds."""
    m, n = len(tests.starts), len(suffixes)
    low, high = np.zeros(m, dtype=np.int64), np.full(m, n, dtype=np.int64)
    out = Found(*(np.zeros(m, dtype=np.int64) for _ in range(4)), np.zeros(n, dtype=np.int64))
    live, depth = np.arange(m if n else 0), 0

    def border(want: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first place in [a, b) whose word at depth is not less than the one wanted."""
        a, b = a.copy(), b.copy()
        while True:
            wide = np.flatnonzero(a < b)
            if not len(wide):
                return a
            middle = (a[wide] + b[wide]) >> 1
            less = symbols[suffixes[middle] + depth] < want[wide]
            a[wide] = np.where(less, middle + 1, a[wide])
            b[wide] = np.where(less, b[wide], middle)

    while True:
        c = tests.symbols[tests.starts[live] + depth]
        live, c = live[c > 0], c[c > 0]
        a = border(c, low[live], high[live])
        b = border(c + 1, a, high[live])
        some = a < b
        live, a, b = live[some], a[some], b[some]
        if not len(live):
            return out
        low[live], high[live] = a, b
        depth += 1
        at = tests.widths[live] == depth
        out.low[live[at]], out.high[live[at]] = a[at], b[at]
        deep = tests.widths[live] <= depth
        if deep.any():
            out.longest[live[deep]], out.place[live[deep]] = depth, suffixes[a[deep]]
            inside = np.cumsum(np.bincount(a[deep], minlength=n + 1) - np.bincount(b[deep], minlength=n + 1))[:n] > 0
            out.best[inside] = depth


class Shard:
    """Documents side by side: the words as numbers of the block's vocabulary, 0 for others and between documents; the suffix array, and what is found in it."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, rows: int, tests: Tests) -> None:
        at = np.searchsorted(tests.vocabulary, hashes)
        at[at == len(tests.vocabulary)] = 0
        known = tests.vocabulary[at] == hashes
        symbols = np.zeros(len(hashes) + rows + 1, dtype=np.int64)
        self.where = np.arange(len(hashes)) + row  # one 0 behind each document
        symbols[self.where[known]] = at[known] + 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], symbols > 0, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= tests.widths.min()
        starts, _ = spread(begin[keep], end[keep])
        short = np.ones(len(symbols), dtype=bool)
        short[starts] = False
        symbols[short] = 0  # what is left out ends matches, too
        self.symbols = symbols
        self.suffixes = suffix_order(symbols, starts, tests.deepest)
        self.found = search(symbols, self.suffixes, tests)

    def word(self, place: np.ndarray) -> np.ndarray:
        """The number of the word at a place of the symbols."""
        return np.searchsorted(self.where, place)


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [begin, end), and the number of the range each is of."""
    sizes = end - begin
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), which


def _shards(batches: Iterator[pa.RecordBatch], size: int, text: str = "text") -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The rows, their word hashes and each word's row, in shards of about `size` words, or one document."""
    held, parts, rows, words = [], [], 0, 0
    for batch in slices(batches, text):
        *_, h, row = scanned([t.translate(LOWER) for t in texts(batch, text)], SEPARATOR)
        parts.append((h, row + rows))
        held.append(batch)
        rows += batch.num_rows
        words += len(h)
        if words >= size:
            yield pa.Table.from_batches(held), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            held, parts, rows, words = [], [], 0, 0
    if held:
        yield pa.Table.from_batches(held), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_RUNS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan(tests, size: int):
    """Of each document: number of words, runs of hit words, items, longest match and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tests | None = tests.value if tests is not None else None
        for held, h, row in _shards(batches, size):
            rows = held.num_rows
            n = np.bincount(row, minlength=rows)
            first = np.cumsum(n) - n
            runs, items = [[] for _ in range(rows)], [[] for _ in range(rows)]
            longest, at = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            if t is not None and len(h):
                shard = Shard(h, row, rows, t)
                low, high = shard.found.low, shard.found.high
                some = np.flatnonzero(low < high)
                # equal windows have the same interval and width: it is looked through once for all their items
                key, window = np.unique(np.stack([low[some], high[some], t.widths[some]]), axis=1, return_inverse=True)
                window = window.ravel()
                place, which = spread(key[0], key[1])
                start, whole = shard.suffixes[place], len(shard.symbols) + 1
                cover = np.bincount(start, minlength=whole) - np.bincount(start + key[2][which], minlength=whole)
                hit = (np.cumsum(cover) > 0)[shard.where]
                new = np.append(True, row[1:] != row[:-1])
                begin = np.flatnonzero(hit & (new | np.append(True, ~hit[:-1])))
                end = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True)) + 1
                for a, b, k in zip(begin - first[row[begin]], end - first[row[begin]], row[begin].tolist(), strict=True):
                    runs[k].append({"begin": a, "end": b})
                of_window = np.split(t.item[some][np.argsort(window, kind="stable")], np.cumsum(np.bincount(window, minlength=key.shape[1]))[:-1])
                doc, windows = np.unique(np.stack([row[shard.word(start)], which]), axis=1)
                edge = np.flatnonzero(np.diff(doc, prepend=-1))
                for k, ws in zip(doc[edge].tolist(), np.split(windows, edge[1:]) if len(edge) else (), strict=True):
                    items[k] = [t.ids[x] for x in np.unique(np.concatenate([of_window[w] for w in ws.tolist()])).tolist() if t.ids[x] is not None]
                word = shard.word(shard.suffixes)
                order = np.lexsort((-word, shard.found.best))  # of a document the last one stays: the first of its longest
                word, doc = word[order], row[word[order]]
                longest[doc], at[doc] = shard.found.best[order], word - first[doc]
                del shard, place, which, start, cover, hit, word, order
            own = held.drop_columns(["text"]).combine_chunks()
            made = [pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string())), pa.array(longest), pa.array(at, mask=longest == 0)]
            yield from pa.Table.from_arrays([*own.columns, *made], names=[*own.column_names, "n_words", "runs", "items", "longest", "longest_at"]).to_batches()
        release()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of several blocks as runs that do not touch."""
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            one: list[dict] = []
            for r in runs:
                if one and r["begin"] <= one[-1]["end"]:
                    one[-1]["end"] = max(one[-1]["end"], r["end"])
                else:
                    one.append(r)
            out.append(one)
        yield batch.set_column(batch.schema.get_field_index("runs"), "runs", pa.array(out, _RUNS))


_MADE = "n_words long, runs array<struct<begin:long,end:long>>, items array<string>, longest long, longest_at long"


def _broadcast(items: DataFrame, s: Settings, item_id: str, item_text: str) -> list:
    """One broadcast for each block, made one by one; None where a block has no words."""
    dealt, n = blocks(items, s, item_id, item_text)
    made = []
    for k in range(n):
        rows = dealt.filter(F.col("block") == k).collect()
        made.append(items.sparkSession.sparkContext.broadcast(tests_of(rows)) if rows else None)
    return made


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_hit, runs of hit words (begin, end: the place behind the last), items (ids as strings, sorted by bytes), longest (words of the longest verbatim match, 0 without one) and longest_at (its first word) of each row."""
    rows = id_and_text(docs, id_col, text_col)
    tests = _broadcast(items, settings, item_id, item_text)
    if len(tests) == 1:
        found = rows.mapInArrow(_scan(tests[0], settings.shard), f"doc_id long, {_MADE}")
    else:
        # every block's result has every row: equal rows have equal results, and are told once with their number
        told = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        made = ("n_words", "runs", "items", "longest", "longest_at")
        parts = [written(told.mapInArrow(_scan(t, settings.shard), f"doc_id long, digest string, {_MADE}").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in made))) for t in tests]
        best = F.max(F.struct("longest", (-F.col("longest_at")).alias("at")))
        merged = union_all(parts).groupBy("doc_id", "digest").agg(
            F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("best"),
        )
        each = merged.select("doc_id", "n_words", "runs", "items", F.col("best.longest").alias("longest"), (-F.col("best.at")).alias("longest_at"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        found = each.drop("copy").mapInArrow(_joined, f"doc_id long, {_MADE}")
    return found.withColumn("n_hit", F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"]))


def longest(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """item_id, first (word of the item a suffix begins with), n_words (its longest verbatim match in any document, within a piece of Settings.piece + window - 1 words), doc_id and at (the smallest document that a shard has it in, and the word there), for suffixes whose window occurs."""
    rows = id_and_text(docs, id_col, text_col)

    def finder(tests):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t: Tests = tests.value
            for held, h, row in _shards(batches, settings.shard):
                if not len(h):
                    continue
                shard = Shard(h, row, held.num_rows, t)
                some = np.flatnonzero(shard.found.longest)
                word = shard.word(shard.found.place[some])
                begin = np.searchsorted(row, np.arange(held.num_rows))
                ids = held.column("doc_id").combine_chunks().take(pa.array(row[word]))
                names = pa.array([t.ids[k] for k in t.item[some].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(t.place[some]), pa.array(shard.found.longest[some]), ids, pa.array(word - begin[row[word]])], ["item_id", "first", "n_words", "doc_id", "at"])
            release()

        return run

    schema = "item_id string, first long, n_words long, doc_id long, at long"
    parts = [rows.mapInArrow(finder(t), schema) for t in _broadcast(items, settings, item_id, item_text) if t is not None]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("n_words", "doc_id", "at"), F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("at")).alias("a")))
    return union_all(parts).groupBy("item_id", "first").agg(best.alias("b")).select("item_id", "first", "b.*")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns, without the documents that have a hit word. With several blocks each works on what the ones before it left."""
    names = docs.columns
    out = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text = f"c{names.index(text_col)}"

    def filter_by(tests):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t: Tests = tests.value
            for held, h, row in _shards(batches, settings.shard, text):
                keep = np.ones(held.num_rows, dtype=bool)
                if len(h):
                    shard = Shard(h, row, held.num_rows, t)
                    keep[row[shard.word(shard.suffixes[shard.found.best > 0])]] = False
                yield from held.filter(pa.array(keep)).to_batches()
            release()

        return run

    for k, t in enumerate(_broadcast(items, settings, item_id, item_text)):
        if t is not None:
            out = (written(out) if k else out).mapInArrow(filter_by(t), out.schema)
    return out.toDF(*names)
