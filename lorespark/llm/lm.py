"""Language-model scoring by a weighted backoff automaton.

Words are lower-cased in A-Z; each text ends with one end token. Training texts give the counts, of all n-grams of up to
`order` tokens, from one occurrence on. The automaton's states are the n-grams of at most order - 1 tokens that occur in
training, and the state of no tokens, the root. An n-gram that occurs is an arc with a weight; each state but the root has
a failure arc, with a weight of its own, to the state without its first token. The root has an arc for every token: the
add-one probability, which is also the base score. One left-to-right traversal carries the state: where a state has no arc
for the token it takes the failure arc and tries again, and adds up the weights of all arcs it took.

Smoothing is hierarchical (Dirichlet): p(w | c) = (count(c w) + mass * p(w | c')) / (count(c) + mass), where c' is c
without its first token. So an arc weighs log10 p(w | c), a failure arc log10 (mass / (count(c) + mass)), and the
probabilities of each state sum to 1.

What is kept where: texts lie in small buckets by a hash of the id, n-grams in parts by their keys. A bucket tells each part
once which of its n-grams it has and how often: a sorted list of keys, kept as differences. The part adds them up and
sends back the sums, in the same order, so an n-gram costs a bucket a few bytes, whatever its number of occurrences, and no
count passes the driver or a broadcast. Only the numbers of tokens and of distinct tokens reach the driver. A bucket then
builds that part of the automaton that its texts can reach, and its texts run through it side by side. What is gathered
grows with the input; nothing is pruned.

Words and n-grams are told apart by 53 bits of a hash, and by the number of tokens.

Defined cases: a null text is empty: it has the end token only; a null id is never held out; no training text: every
token has probability 1 / (V + 1) with V = 0; equal texts get equal scores, ids may repeat; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import FACTOR, mixed, partitions, release, scanned, slices, texts

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The end token's hash.
END = np.uint64(0x5851F42D4C957F2D)
#: Buckets for each of the session's shuffle partitions, and training tokens for each part: small groups, as a task holds one whole.
BUCKETS, PART = 4, 500_000
#: Tokens of a lane: lanes are traversed side by side.
LANE = 512


def joined(context: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """Keys of n-grams from those of their first n - 1 tokens and of their last one."""
    return keyed(mixed(context * np.uint64(FACTOR) + token), n)


def keyed(h: np.ndarray, n: int) -> np.ndarray:
    """53 bits of a hash, and the number of tokens in the lowest three of 56."""
    return h >> np.uint64(11) << np.uint64(3) | np.uint64(n)


def tokens(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts in a row, and where each text ends."""
    *_, h, row = scanned([t.translate(LOWER) for t in rows])
    ends = np.cumsum(np.bincount(row, minlength=len(rows)) + 1)
    out = np.full(int(ends[-1]) if len(rows) else 0, END, dtype=np.uint64)
    out[np.arange(len(h)) + row] = h
    return keyed(out, 1), ends


def grams(token: np.ndarray, ends: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, keys of what starts at each token, and the starts of n-grams within one text."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    key = token
    for n in range(1, min(order, len(token)) + 1):
        if n > 1:
            key = joined(key[:-1], token[n - 1 :], n)
        yield n, key, np.flatnonzero(row[: len(key)] == row[n - 1 :])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sum of the counts (the last array) and any of the other values."""
    key, *others, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    return key, *(x[first] for x in others), np.bincount(at, weights=counts, minlength=len(key)).astype(np.int64)


def counted(pieces: Iterator[pa.RecordBatch], order: int) -> list[tuple[np.ndarray, ...]]:
    """Of each n from 1: the distinct n-grams of the texts, sorted, those without their last and without their first token, and how often training texts have them."""
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]
    for batch in pieces:
        token, ends = tokens(texts(batch))
        learn = np.repeat(np.asarray(batch.column("learn").fill_null(False).to_numpy(zero_copy_only=False), dtype=bool), np.diff(ends, prepend=0))
        shorter = token
        for n, key, at in grams(token, ends, order):
            found[n - 1].append(_merged([(key[at], shorter[at], shorter[at + (n > 1)], learn[at].astype(np.int64))]))
            shorter = key
    return [_merged(x) if x else (*[np.empty(0, dtype=np.uint64)] * 3, np.empty(0, dtype=np.int64)) for x in found]


def _pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
    return slices(iter(t.to_batches()))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers as bytes, (numbers, bytes that the largest one needs)."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _wide(b: bytes, count: int) -> np.ndarray:
    """The numbers again."""
    out = np.zeros((count, 8), dtype=np.uint8)
    narrow = np.frombuffer(b, dtype=np.uint8).reshape(count, -1)
    out[:, : narrow.shape[1]] = narrow
    return out.view("<u8")[:, 0]


def _cut(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Numbers in binary lists that begin at starts."""
    b = _narrow(x)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(x)) * b.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(b))])


def _dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by part, then by key; where each part begins; its number; and what the keys in it are divided to."""
    part, rest = key % np.uint64(parts), key // np.uint64(parts)
    order = np.lexsort((rest, part))
    part = part[order].astype(np.int32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, dtype=np.int64)
    return order, starts, part[starts], rest[order]


TOLD = "part int, bucket int, size int, keys binary, counts binary"


def _tell(order: int, parts: int):
    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        levels = counted(_pieces(t), order)
        key, n = np.concatenate([x[0] for x in levels]), np.concatenate([x[-1] for x in levels])
        by, starts, part, rest = _dealt(key, parts)
        steps = np.diff(rest, prepend=np.uint64(0))
        steps[starts] = rest[starts]
        sizes = np.diff(np.append(starts, len(rest)))
        made = [pa.array(part), pa.array(np.full(len(part), bucket, dtype=np.int32)), pa.array(sizes.astype(np.int32)), _cut(steps, starts), _cut(n[by], starts)]
        del levels, key, n, by, rest, steps
        release()
        return pa.table(made, names=["part", "bucket", "size", "keys", "counts"])

    return run


def _sum(t: pa.Table) -> pa.Table:
    """What each bucket has told a part, with the sums over all buckets in place of its own counts."""
    sizes = np.asarray(t.column("size"), dtype=np.int64)
    rows = list(zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), sizes.tolist(), strict=True))
    keys = np.concatenate([np.cumsum(_wide(k, n), dtype=np.uint64) for k, _, n in rows])
    counts = np.concatenate([_wide(c, n) for _, c, n in rows])
    _, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, weights=counts).astype(np.int64)[at]
    ends = np.cumsum(sizes)
    packed = [_narrow(sums[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return pa.table([t.column("bucket"), t.column("part"), t.column("size"), pa.array(packed, pa.binary())], names=["bucket", "part", "size", "sums"])


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is in keys (sorted); -1: nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Automaton:
    """The states and arcs that a bucket's texts can reach. levels: as counted() gives them, but with counts over all buckets."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]], total: int, distinct: int, mass: float) -> None:
        self.order = len(levels)
        #: Of states: key, number of tokens, and the failure arc's target and weight. The first is the root.
        key, level, fail, back = ([np.zeros(1, dtype=t)] for t in (np.uint64, np.int64, np.int64, np.float64))
        #: Of arcs, by number of tokens: keys, sorted, their weights and targets.
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        states, below_state, below_p, below_n, below_key = 1, None, None, None, None
        for n, (keys, context, suffix, count) in enumerate(levels, 1):
            some = count > 0
            if n == 1:
                p = (count + 1) / (total + distinct + 1)
                shorter = np.zeros(len(keys), dtype=np.int64)  # the root
                self.known = some
            else:
                keys, context, suffix, count = (x[some] for x in (keys, context, suffix, count))
                down = _at(below_key, suffix)
                p = (count + mass * below_p[down]) / (below_n[_at(below_key, context)] + mass)
                shorter, some = below_state[down], np.ones(len(keys), dtype=bool)
            state = shorter  # a token or n-gram that is no state leads to the longest one it ends with
            if n < self.order:
                state = np.where(some, states + np.cumsum(some) - 1, shorter)
                states += int(some.sum())
                for into, x in zip((key, level, fail, back), (keys[some], np.full(int(some.sum()), n), shorter[some], np.log10(mass / (count[some] + mass))), strict=True):
                    into.append(x)
            self.arcs.append((keys, np.log10(p), state))
            below_key, below_state, below_p, below_n = keys, state, p, count
        self.key, self.level, self.fail, self.back = map(np.concatenate, (key, level, fail, back))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state, and the weight of the arcs taken, from each state by a token."""
        weight, target, live, at = np.zeros(len(state)), np.empty(len(state), dtype=np.int64), np.arange(len(state)), state
        for n in range(self.order, 0, -1):
            keys, weights, targets = self.arcs[n - 1]
            here = np.flatnonzero(self.level[at] == n - 1)  # states whose arcs are n-grams
            word = token[live[here]]
            arc = _at(keys, joined(self.key[at[here]], word, n) if n > 1 else word)
            found = arc >= 0
            hit = live[here[found]]
            weight[hit] += weights[arc[found]]
            target[hit] = targets[arc[found]]
            lost = here[~found]
            weight[live[lost]] += self.back[at[lost]]
            at = at.copy()
            at[lost] = self.fail[at[lost]]
            keep = np.ones(len(live), dtype=bool)
            keep[here[found]] = False
            live, at = live[keep], at[keep]
        return target, weight

    def weights(self, token: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each token. Texts are cut into lanes, which start order - 1 tokens early: a state depends on no more."""
        count, early = len(token), self.order - 1
        first = np.zeros(count + 1, dtype=bool)
        first[0] = first[ends] = True
        begin = np.arange(0, count, LANE)
        state, out = np.zeros(len(begin), dtype=np.int64), np.zeros(count)
        for k in range(-early, min(LANE, count)):
            at = begin + k
            a, b = int(np.searchsorted(at, 0)), int(np.searchsorted(at, count))
            at = at[a:b]
            moved, weight = self.step(np.where(first[at], 0, state[a:b]), token[at])
            state[a:b] = moved
            if k >= 0:
                out[at] = weight
        return out


NAMES = {"doc_id": pa.int64(), "learn": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _score(order: int, total: int, distinct: int, mass: float, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in NAMES.items()})
        levels = counted(_pieces(left), order)
        right = right.sort_by("part")
        sums = np.concatenate([_wide(x, n) for x, n in zip(right.column("sums").to_pylist(), right.column("size").to_pylist(), strict=True)]).astype(np.int64)
        everywhere = np.empty_like(sums)
        everywhere[_dealt(np.concatenate([x[0] for x in levels]), parts)[0]] = sums
        borders = np.cumsum([len(x[0]) for x in levels])[:-1]
        levels = [(*x[:-1], n) for x, n in zip(levels, np.split(everywhere, borders), strict=True)]
        automaton, words, counts = Automaton(levels, total, distinct, mass), levels[0][0], levels[0][-1]
        base = np.log10((counts + 1) / (total + distinct + 1))
        out = []
        for batch in _pieces(left):
            token, ends = tokens(texts(batch))
            starts, at = np.concatenate([[0], ends[:-1]]), _at(words, token)
            made = [ends - starts, np.add.reduceat((counts[at] > 0).astype(np.int64), starts), np.full(len(starts), total), np.add.reduceat(base[at], starts), np.add.reduceat(automaton.weights(token, ends), starts)]
            out.append(pa.Table.from_arrays([batch.column("doc_id"), batch.column("learn"), *map(pa.array, made)], names=list(NAMES)))
        del levels, automaton, sums, everywhere
        release()
        return pa.concat_tables(out)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each slice, with their counts."""
    for batch in slices(batches):
        key, n = np.unique(tokens(texts(batch))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])
    release()


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, mass: float = 8.0) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score and score of each row's whole text."""
    if not 1 <= order <= 7:
        raise ValueError("an order from 1 to 7")
    n = BUCKETS * partitions(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), learn.alias("learn"))
    counts = rows.filter("learn").select("text").mapInArrow(_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    # rows without an id are told apart by their text, so that they do not meet in one bucket
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n)).cast("int")).repartition(n, "bucket")
    # both uses take placed as it is, so that Spark shuffles the texts once and uses them again
    # a bucket tells one row a part, so parts follow the session's partitions where those follow the input
    parts = min(-(-total // PART) + 1, n)
    told = placed.groupBy("bucket").applyInArrow(_tell(order, parts), TOLD).repartition(parts, "part")
    answers = told.groupBy("part").applyInArrow(_sum, "bucket int, part int, size int, sums binary")
    schema = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score(order, total, distinct, mass, parts), schema)
