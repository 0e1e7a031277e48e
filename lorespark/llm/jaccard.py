"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A text is the set of its five-word shingles (a text of fewer words: one shingle of all of them). Texts with equal sets
are collapsed to one before anything else, so copies cost one row. Each of `trees` prefix tries holds all texts by a
signature of `depth` MinHash values, in sorted order, so a prefix is a range of texts. The prefix that two texts must share
is shortened from `depth`, one value at a time, until the chance that a pair at the threshold shares it in some tree reaches
`recall`. How far that is depends on the texts: sets of few shingles can only have a few similarities, and where the least
one that counts is well above the threshold, a longer prefix does; sets of many shingles need the shortest one.

Each text is compared with all other members of its nodes of that length; deeper nodes hold no further pairs. Each pair
is verified once, on the whole sets, so `n_links` counts every link of a pair that meets in a node. Classes are the
connected components of the links.

Skew: texts lie in buckets by key, and buckets in about sqrt(2 n) blocks. A bucket tells each of its nodes once and gets
back which blocks hold members of the node; a text then goes once to each pair of blocks in which it can meet another. So
a node with a third of all texts costs its members about sqrt(2 n) rows each, and its comparisons are spread over all
pairs of blocks. Their number is the square of the group's size: pairs are formed in the task, never as rows, and only
counts and a spanning forest of the links leave it.

Defined cases: a null text or one without words has no shingles and is alone in its class; copies (equal sets, so also
rows repeated as they are) share a class and its links; a null id is a row like others, and the class id is the smallest
id that is not null (null if there is none); an empty table gives no rows. Further input columns are ignored by
classes() and kept by distinct_documents().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import WordHashes, id_and_text, mixed, partitions, release, rolling, scanned, slices, texts, unused
from lorespark.operators.components import connected_components
from lorespark.operators.tables import written

SHINGLE = 5
#: Words whose hashes a task remembers.
REMEMBERED = 100_000


def shingles(text: bytes, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes(words)
    return np.unique(rolling(h, min(n, len(words))))


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a shingle set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_similarity(m: int, threshold: float) -> float:
    """The least Jaccard similarity, from the threshold on, that a set of m can have with another set."""
    found = []
    for q in range(math.ceil(threshold * m - 1e-9), math.floor(m / threshold + 1e-9) + 1):
        i = math.ceil(threshold * (m + q) / (1 + threshold) - 1e-9)
        if i <= min(m, q) and (q != m or i < m):
            found.append(i / (m + q - i))
    return min(found, default=1.0)


class Forest:
    def __init__(self, trees: int = 16, depth: int = 8, threshold: float = 0.8, recall: float = 0.995, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.threshold = trees, depth, threshold
        shortened = lambda s: next((d for d in range(depth, 1, -1) if 1 - (1 - s**d) ** trees >= recall), 1)
        #: The shortest prefix: what sets of any size share at the threshold.
        self.shortest = shortened(threshold)
        #: Prefixes of sets by their size, as far as some are longer; larger sets need the shortest.
        by_size = [shortened(least_similarity(m, threshold)) if m else depth for m in range(200)]
        longer = max((m for m in range(1, 200) if by_size[m] > self.shortest), default=0)
        self.by_size = np.array([*by_size[: longer + 1], self.shortest])
        #: Sets up to this size may meet one that needs a longer prefix, so they have all values.
        self.small = math.floor(longer / threshold + 1e-9)
        self.factors = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def prefixes(self, sizes: np.ndarray) -> np.ndarray:
        """How many values a set of each size must share."""
        return self.by_size[np.minimum(sizes, len(self.by_size) - 1)]

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """16 bits of each MinHash value of non-empty sets, (sets, trees * depth). Large sets have 0 beyond the shortest prefix."""
        out = np.zeros((len(sets), len(self.factors)), dtype=np.uint16)
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        for rows, first, last in ((np.arange(len(sets)), 0, self.shortest), (np.flatnonzero(sizes <= self.small), self.shortest, self.depth)):
            if not len(rows) or first == last:
                continue
            flat, starts = np.concatenate([sets[r] for r in rows.tolist()]), np.cumsum(sizes[rows]) - sizes[rows]
            buffer = np.empty_like(flat)
            for k in (t * self.depth + d for t in range(self.trees) for d in range(first, last)):
                np.bitwise_xor(flat, self.salts[k], out=buffer)
                buffer *= self.factors[k]
                # the low bits of the smallest value are as good as random, but for a mix
                out[rows, k] = mixed(np.minimum.reduceat(buffer, starts)) >> np.uint64(48)
        return out

    def nodes(self, signatures: np.ndarray) -> np.ndarray:
        """Key of each text's node of the shortest prefix in each tree, (texts, trees)."""
        s = signatures.reshape(len(signatures), self.trees, self.depth).astype(np.uint64)
        at = mixed(np.broadcast_to(np.arange(1, self.trees + 1, dtype=np.uint64), s.shape[:2]).copy())
        for d in range(self.shortest):
            at = mixed(at * np.uint64(3) + s[:, :, d] + np.uint64(1))
        return at.view(np.int64)

    def packed(self, signatures: np.ndarray) -> list[bytes]:
        """Of each text its nodes, then the values beyond the shortest prefix, by tree."""
        deeper = signatures.reshape(len(signatures), self.trees, self.depth)[:, :, self.shortest :]
        return [a.tobytes() + b.tobytes() for a, b in zip(self.nodes(signatures), deeper, strict=True)]

    def tries(self, packed: list[bytes]) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each tree, and each length of a prefix from the shortest on: the texts in the trie's order, and where the range of each text's prefix begins and ends."""
        whole = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
        nodes = np.ascontiguousarray(whole[:, : 8 * self.trees]).view(np.int64)
        deeper = np.ascontiguousarray(whole[:, 8 * self.trees :]).view(np.uint16).reshape(len(packed), self.trees, -1)
        out = []
        for t in range(self.trees):
            values = [nodes[:, t], *deeper[:, t].T]
            order = np.lexsort(values[::-1])
            ranges, new = [], np.zeros(len(order), dtype=bool)
            new[:1] = True
            for v in values:
                v = v[order]
                new[1:] |= v[1:] != v[:-1]
                starts = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                low, high = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
                low[order], high[order] = starts[group], np.append(starts[1:], len(order))[group]
                ranges.append((order, low, high))
            out.append(ranges)
        return out


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text, which with the id tells rows apart that share one."""
    return id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))


def signed_texts(docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hash of the text, key of the shingle set (null without shingles) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(REMEMBERED)
        for batch in slices(batches):
            sets = [shingles(t, hashes) for t in texts(batch)]
            some = [s for s in sets if len(s)]
            signatures = iter(forest.signatures(some) if some else ())
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            values = pa.array([next(signatures).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), keys, values], ["doc_id", "hash", "key", "signature"])
        hashes.known.clear()
        release()

    return _hashed(docs, id_col, text_col).mapInArrow(run, "doc_id long, hash long, key long, signature binary")


def _bucketed(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _signatures(t: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint16).reshape(t.num_rows, -1)


def _nodes(forest: Forest, t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts, and their nodes, (texts, trees)."""
    return np.asarray(t.column("key")), forest.nodes(_signatures(t))


def _tell(forest: Forest):
    """Each bucket's distinct nodes, with the smallest and largest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            if b.num_rows:
                key, node = _nodes(forest, b)
                found.append((np.repeat(np.asarray(b.column("bucket")), forest.trees), node.ravel(), np.repeat(key, forest.trees)))
        if not found:
            return
        bucket, node, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((key, node, bucket))
        bucket, node, key = bucket[order], node[order], key[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])))
        last = np.append(first[1:], len(key)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[first], node[first], key[first], key[last])], ["bucket", "node", "low", "high"])
        del found, bucket, node, key, order, first, last
        release()

    return run


def _placed(forest: Forest, n_blocks: int):
    """The pairs of blocks that each text of a bucket goes to, with its nodes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"unit": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "nodes": pa.array([], pa.binary())})
        key, node = _nodes(forest, left)
        own = left.column("bucket")[0].as_py() % n_blocks
        right = right.sort_by("node")
        known, blocks = np.asarray(right.column("node")), right.column("blocks").combine_chunks()
        counts, others = np.asarray(blocks.value_lengths()), np.asarray(blocks.flatten(), dtype=np.int64)
        starts = np.cumsum(counts) - counts
        at = np.minimum(np.searchsorted(known, node), len(known) - 1)
        row, tree = np.nonzero(known[at] == node)
        at = at[row, tree]
        size = counts[at]
        other = others[np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        unit = np.minimum(own, other) * n_blocks + np.maximum(own, other)
        found = np.unique(np.stack([np.repeat(row, size), unit], axis=1), axis=0)
        row, unit = found[:, 0], found[:, 1]
        packed = forest.packed(_signatures(left))
        made = pa.table({"unit": pa.array(unit), "key": pa.array(key[row]), "nodes": pa.array([packed[i] for i in row.tolist()], pa.binary())})
        del key, node, known, at, tree, other, found, packed
        release()
        return made

    return run


def _sets(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of each text, one text after the other, with where each begins and how many it has. A text of fewer than SHINGLE words has none: its set is in no other text's."""
    _, _, _, words, row = scanned(rows)
    h = rolling(words, SHINGLE)
    inside = row[: len(h)] == row[len(row) - len(h) :]
    known, number = np.unique(h[inside], return_inverse=True)
    most = max(1, len(known))
    both = np.unique(row[: len(h)][inside].astype(np.int64) * most + number)
    lengths = np.bincount(both // most, minlength=len(rows))
    return (both % most).astype(np.int32), np.cumsum(lengths) - lengths, lengths


def _compared(forest: Forest):
    """Of all pairs of a pair of blocks that share a node: the number n of links of each key, and links (key, pivot) that join the same keys as all of them."""

    def run(t: pa.Table) -> pa.Table:
        key, block, threshold = np.asarray(t.column("key")), np.asarray(t.column("block")), forest.threshold
        tries = forest.tries(t.column("nodes").to_pylist())
        flat, starts, lengths = _sets([x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()])
        mixed_blocks = bool((block != block[0]).any())
        prefix = forest.prefixes(lengths) - forest.shortest
        longest = int(prefix.max(initial=0))
        count, label = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        there, near = np.zeros(int(flat.max(initial=-1)) + 1, dtype=np.uint8), np.zeros(len(key), dtype=bool)
        keys, others = [], []
        for i in range(len(key)):
            near[:] = False
            for ranges in tries:
                # who needs no longer prefix than this text, and then who needs a longer one
                for d in range(prefix[i], longest + 1):
                    order, low, high = ranges[d]
                    if high[i] - low[i] > 1:
                        some = order[low[i] : high[i]]
                        near[some if longest == prefix[i] else some[prefix[some] <= d] if d == prefix[i] else some[prefix[some] == d]] = True
            near[: i + 1] = False
            if mixed_blocks:
                near &= block != block[i]
            m = lengths[i]
            p = np.flatnonzero(near)
            p = p[np.minimum(lengths[p], m) >= threshold * np.maximum(lengths[p], m) - 1e-9]
            p = p[lengths[p] > 0]
            if not len(p) or not m:
                continue
            own = flat[starts[i] : starts[i] + m]
            there[own] = 1
            size = lengths[p]
            ends = np.cumsum(size)
            shared = np.add.reduceat(there[flat[np.repeat(starts[p] - ends + size, size) + np.arange(ends[-1])]], ends - size, dtype=np.int64)
            there[own] = 0
            p = p[shared / (m + size - shared) >= threshold]
            count[i] += len(p)
            count[p] += 1
            for j in p[np.unique(label[p], return_index=True)[1]].tolist():
                if label[j] != label[i]:
                    keys.append(key[i])
                    others.append(key[j])
                    label[label == label[j]] = label[i]
        some = np.flatnonzero(count)
        made = pa.table({
            "key": pa.array([*key[some].tolist(), *keys], pa.int64()),
            "pivot": pa.array([*[None] * len(some), *others], pa.int64()),
            "n": pa.array([*count[some].tolist(), *[None] * len(keys)], pa.int64()),
        })
        del tries, flat, starts, lengths, there, near
        release()
        return made

    return run


def links(texts_of: Callable[[DataFrame], DataFrame], reps: DataFrame, forest: Forest) -> DataFrame:
    """Rows with a number n of verified links of a key (to be added up), and rows with a pivot: links that join the same keys as all links do. reps: key and signature of different texts; texts_of: key and text for a table of keys."""
    n = partitions(reps.sparkSession)
    n_blocks = math.isqrt(2 * n - 1) + 1
    placed = _bucketed(reps.select("key", "signature"), n).repartition(n, "bucket")
    told = placed.mapInArrow(_tell(forest), "bucket int, node long, low long, high long").withColumn("block", F.col("bucket") % n_blocks)
    node, part = Window.partitionBy("node"), Window.partitionBy("node", "block")
    told = told.repartition(n, "node").sortWithinPartitions("node", "block")
    shared = told.withColumns({"least": F.min("low").over(node), "most": F.max("high").over(node)}).filter("least < most")
    shared = shared.withColumn("alone", F.min("low").over(part) == F.max("high").over(part)).withColumn("blocks", F.collect_set("block").over(node))
    # a text that is alone in its block meets others of the node in other blocks only
    shared = shared.select("bucket", "node", F.when(F.col("alone"), F.array_remove("blocks", F.col("block"))).otherwise(F.col("blocks")).alias("blocks"))
    units = written(placed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_placed(forest, n_blocks), "unit long, key long, nodes binary"))
    used = texts_of(units.select("key").distinct())
    sent = _bucketed(units.join(used, "key"), n).select("unit", "key", (F.col("bucket") % n_blocks).alias("block"), "nodes", "text")
    return written(sent.groupBy("unit").applyInArrow(_compared(forest), "key long, pivot long, n long"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """For each row doc_id, hash (of the text), class_id, class_size (rows), n_links (verified links of its text to different texts) and n_copies (rows with the same shingles)."""
    forest = forest or Forest()
    rows = written(signed_texts(docs, forest, id_col, text_col))
    reps = rows.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "hash")).alias("row"), F.min("signature").alias("signature"), F.count("*").alias("n_copies")
    )
    reps = written(reps)

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = reps.join(keys, "key", "left_semi").select("key", F.col("row.doc_id").alias("r_id"), F.col("row.hash").alias("r_hash"))
        all_texts = _hashed(docs, id_col, text_col)
        found = all_texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")))
        return found.select("key", "text").dropDuplicates(["key"])

    near = links(texts_of, reps, forest)
    degree = near.filter("pivot is null").groupBy("key").agg(F.sum("n").alias("n_links"))
    parts = connected_components(near.filter("pivot is not null"), "key", "pivot").select(F.col("node").alias("key"), "component")
    named = reps.select("key", "first_id", "n_copies").join(parts, "key", "left").join(degree, "key", "left")
    named = written(named.withColumn("component", F.coalesce("component", "key")))
    lead = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("n_copies").alias("class_size"))
    named = named.join(lead, "component").select("key", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = rows.select("doc_id", "hash", "key").join(named, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    counts = [F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (("class_size", 1), ("n_links", 0), ("n_copies", 1))]
    return out.select("doc_id", "hash", own, *counts)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """The rows of docs, all columns, of which each class keeps one: that with the smallest id (of equal rows all)."""
    i, h = unused(docs, "id", "hash")
    gone = classes(docs, id_col, text_col, forest).filter("class_size > 1 and not (doc_id <=> class_id)").select(F.col("doc_id").alias(i), F.col("hash").alias(h)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h))
    return docs.join(gone, same, "left_anti")
