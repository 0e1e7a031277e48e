"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the V terms that at least
`least` of its documents have. In a group (a source within a language, or the language as a whole) a kept term that occurs
count times of N has p = 1 + floor(SCALE * (count + 1) / (N + V)); a term of group p costs floor((p - q)^2 / q) against
another group's q. All numbers are integers and exact: no division is rounded twice.

1. Tasks count the terms of their documents slice by slice, one row a term with the counts of its sources, so the shuffle by
   language and term carries neither occurrences nor one row a source. Sums and kept terms are aggregates.
2. Kept terms are dealt to buckets by a hash, so many that a bucket's counts (terms times sources) stay below CELLS.
3. In a bucket, terms of a language, the most frequent first, are the leaves of a binary segment tree for each group. Nodes
   are hash-consed: a leaf is its count, an inner node the pair of its children, and equal subtrees are one node, of whatever
   group and place. Two groups' trees are walked together from the roots down; equal pairs of nodes met in a walk are one
   entry with a multiplicity, so each is expanded once, and each pair of counts is priced once.
4. Prices of pairs of groups are summed over buckets. Terms of a group against its language are found by a walk that leaves
   out subtrees where the group has nothing; a bucket sends the `terms` dearest of each group, which Spark ranks.

The report has a row for each ordered pair of sources of a language, as is its purpose; no other table has pairs.

Defined cases: null texts, languages and sources count as empty ones; a group whose documents have no terms is priced with
counts of 0; a language without kept terms has pairs with value 0 and no terms; a language's only source has no pairs; equal
values are ranked by the item's UTF-8 bytes; repeated rows count as documents of their own; an empty table gives no rows;
further columns are ignored. Terms are told apart by 64-bit hashes within a slice and by their bytes from there on; sources
by 64-bit hashes. A sum stays below 2^63 for up to 5e8 kept terms a language and bucket, counts below 9e15.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import partitions, release, scanned, slices, texts, written

SCALE = 1_000_000_000
#: Separators: ASCII but small letters, after A-Z are lower-cased.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[:128] = True
SEPARATOR[0x61:0x7B] = False
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text whose terms are counted together.
COUNTED = 12 << 20
#: Counts that a bucket has at most, as far as hashes deal evenly.
CELLS = 1 << 20


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term and of each source its code, how often it has the term and in how many documents."""
    for batch in slices(batches, size=COUNTED):
        langs, sources = batch.column("lang").to_pylist(), np.asarray(batch.column("code"), dtype=np.int64)
        names = sorted(set(langs))
        number = {x: k for k, x in enumerate(names)}
        lang = np.array([number[x] for x in langs], dtype=np.int32)
        codes, source = np.unique(sources, return_inverse=True)
        raw = texts(batch)
        whole, begin, end, h, row = scanned([t.translate(LOWER) for t in raw], SEPARATOR)
        if not len(h):
            continue
        # by language, term and source; rows stay in order, so a change of row is another document
        group = (lang[row].astype(np.int64) * len(codes) + source[row]).astype(np.int32)
        order = np.argsort(group, kind="stable")
        order = order[np.argsort(h[order], kind="stable")]
        order = order[np.argsort(lang[row[order]], kind="stable")]
        g, key, doc = group[order], h[order], row[order]
        new_term = np.append(True, (key[1:] != key[:-1]) | (lang[doc[1:]] != lang[doc[:-1]]))
        new = new_term | np.append(True, g[1:] != g[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(g)))
        df = np.add.reduceat((new | np.append(True, doc[1:] != doc[:-1])).astype(np.int64), first)
        terms = np.flatnonzero(new_term)
        at = order[terms]
        spelled = pa.array([whole[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(np.searchsorted(first, terms), len(first)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(codes[source[doc[first]]]), pa.array(n, pa.int64()), pa.array(df)], ["code", "n", "df"]),
        )
        of = pa.DictionaryArray.from_arrays(pa.array(lang[doc[terms]]), pa.array(names, pa.string())).cast(pa.string())
        made = pa.RecordBatch.from_arrays([of, spelled, lists], ["lang", "term", "counts"])
        del whole, begin, end, h, row, group, order, g, key, doc, new, new_term
        for k in range(0, made.num_rows, 1 << 16):
            yield made.slice(k, 1 << 16)
        del made, lists, spelled
    release()


class Trees:
    """Hash-consed segment trees over the rows of a matrix of counts. Node ids are numbers by level: at level 0 a node is a count, above it a pair of nodes of the level below."""

    def __init__(self, counts: np.ndarray) -> None:
        rows, n = counts.shape
        self.values, ids = np.unique(counts, return_inverse=True)
        wide = 1 << max(n - 1, 0).bit_length()
        nodes = np.full((rows, wide), len(self.values), dtype=np.int64)  # that number is a place without a term
        nodes[:, :n] = ids.reshape(rows, n)
        self.values = np.append(self.values, 0)
        self.pad = len(self.values) - 1
        self.any = [np.append(self.values[:-1] > 0, False)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            left, right = nodes[:, ::2].ravel(), nodes[:, 1::2].ravel()
            size = len(self.any[-1])
            pairs, ids = np.unique(left * size + right, return_inverse=True)
            self.children.append((pairs // size, pairs % size))
            self.any.append(self.any[-1][pairs // size] | self.any[-1][pairs % size])
            nodes = ids.reshape(rows, -1)
        self.roots = nodes[:, 0]

    def count_pairs(self, one: int, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """For row `one` against each of `others`: the distinct pairs of counts (number of the other, count, count) and how many terms have each."""
        which, a, b = np.arange(len(others)), np.full(len(others), self.roots[one]), self.roots[others]
        times = np.ones(len(others), dtype=np.int64)
        for level in range(len(self.children) - 1, -1, -1):
            left, right = self.children[level]
            size = len(self.any[level])
            key = np.concatenate([(which * size + left[a]) * size + left[b], (which * size + right[a]) * size + right[b]])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.add.reduceat(np.concatenate([times, times])[order], first)
            key = key[first]
            which, a, b = key // size // size, key // size % size, key % size
        keep = (a != self.pad) & (b != self.pad)
        return which[keep], self.values[a[keep]], self.values[b[keep]], times[keep]

    def places(self, one: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where row `one` has a count above 0, and the counts of both rows there."""
        a, b, at = self.roots[[one]], self.roots[[other]], np.zeros(1, dtype=np.int64)
        for level in range(len(self.children), -1, -1):
            live = self.any[level][a]
            a, b, at = a[live], b[live], at[live]
            if level:
                left, right = self.children[level - 1]
                a, b, at = (np.concatenate([x, y]) for x, y in ((left[a], right[a]), (left[b], right[b]), (2 * at, 2 * at + 1)))
        return at, self.values[a], self.values[b]


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in steps of 1000, which stay within 64 bits."""
    left, out = count + 1, np.zeros(len(count), dtype=np.int64)
    whole, left = left // total, left % total
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return 1 + whole * SCALE + out


def cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_SCHEMA = "lang string, source string, part string, item string, value long"


def price(most: int):
    """For a bucket: the price of each pair of sources of each language, and the dearest terms of each source."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        first = key[0].as_py() == 0
        groups: dict[str, list[tuple[str, int, int, int]]] = {}
        for lang, source, code, total, lang_total in zip(*(right.column(c).to_pylist() for c in ("lang", "source", "code", "total", "lang_total")), strict=True):
            groups.setdefault(lang, []).append((source, code, total, lang_total))
        out: dict[str, list] = {c: [] for c in ("lang", "source", "part", "item", "value")}

        def add(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> None:
            for c, x in (("lang", [lang] * len(item)), ("source", source), ("part", [part] * len(item)), ("item", item), ("value", value.tolist())):
                out[c] += x

        of = left.column("lang").combine_chunks().dictionary_encode()
        numbers = np.asarray(of.indices, dtype=np.int64)
        where = {x: k for k, x in enumerate(of.dictionary.to_pylist())}
        for lang, members in groups.items():
            names = [m[0] for m in members]
            mine = np.flatnonzero(numbers == where[lang]) if lang in where else []
            if not len(mine):
                if first:
                    for g, name in enumerate(names):
                        others = names[:g] + names[g + 1 :]
                        add(lang, [name] * len(others), "pair", others, np.zeros(len(others), dtype=np.int64))
                continue
            rows = left.take(pa.array(mine)).combine_chunks()
            lists = rows.column("counts").combine_chunks()
            codes = np.array([m[1] for m in members], dtype=np.int64)
            by_code = np.argsort(codes)
            flat = lists.flatten()
            source = by_code[np.searchsorted(codes[by_code], np.asarray(flat.field("code"), dtype=np.int64))]
            term = np.repeat(np.arange(len(mine)), np.asarray(lists.value_lengths(), dtype=np.int64))
            counts = np.zeros((len(members) + 1, len(mine)), dtype=np.int64)
            counts[source, term] = np.asarray(flat.field("n"), dtype=np.int64)
            counts[-1] = counts[:-1].sum(axis=0)
            order = np.argsort(-counts[-1], kind="stable")
            trees = Trees(counts[:, order])
            spelled = rows.column("term").combine_chunks().take(pa.array(order))
            totals = np.array([m[2] for m in members] + [members[0][3]], dtype=np.int64)
            for g, name in enumerate(names):
                others = np.arange(g + 1, len(names))
                if len(others):
                    which, a, b, times = trees.count_pairs(g, others)
                    p, q = probability(a, np.full(len(a), totals[g])), probability(b, totals[others[which]])
                    for x, y, there in ((p, q, True), (q, p, False)):
                        sums = np.zeros(len(others), dtype=np.int64)
                        np.add.at(sums, which, cost(x, y) * times)
                        away = [names[k] for k in others.tolist()]
                        add(lang, [name] * len(away) if there else away, "pair", away if there else [name] * len(away), sums)
                at, a, b = trees.places(g, len(names))
                if not len(at):
                    continue
                pair, back = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
                p, q = probability(pair[0], np.full(pair.shape[1], totals[g])), probability(pair[1], np.full(pair.shape[1], totals[-1]))
                value = np.where(p > q, cost(p, q), -1)[back.ravel()]
                at, value = at[value >= 0], value[value >= 0]
                if len(at) > most:
                    lowest = np.partition(value, len(value) - most)[len(value) - most]
                    at, value = at[value >= lowest], value[value >= lowest]
                found = sorted(zip((-value).tolist(), spelled.take(pa.array(at)).to_pylist(), strict=True))[:most]
                add(lang, [name] * len(found), "term", [x[1] for x in found], -np.array([x[0] for x in found], dtype=np.int64))
        made = pa.table({c: pa.array(x, pa.int64() if c == "value" else pa.string()) for c, x in out.items()})
        release()
        return made

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, terms: int = 200) -> DataFrame:
    """lang, source, part (`pair` or `term`), item (another source, or a term), value and rank, from 1 in each group and part: pairs all, terms the first `terms` of those more frequent than in the language."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    coded = rows.select("lang", F.xxhash64("source").alias("code"), "text")
    told = coded.mapInArrow(count_terms, "lang string, term string, counts array<struct<code:long,n:long,df:long>>")
    # one shuffle: both sums below are over rows that lie together by language and term
    summed = told.repartition(n, "lang", "term").select("lang", "term", F.inline("counts")).groupBy("lang", "term", "code").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = written(summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("code", "n")).alias("counts")).filter(F.col("df") >= least).drop("df"))
    each = kept.select("lang", F.inline("counts")).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = rows.select("lang", "source").distinct().withColumn("code", F.xxhash64("source")).join(size, "lang", "left").join(each, ["lang", "code"], "left").fillna(0, ["v", "n"])
    whole = Window.partitionBy("lang")
    totals = written(groups.select("lang", "source", "code", (F.col("n") + F.col("v")).alias("total"), (F.sum("n").over(whole) + F.col("v")).alias("lang_total"), "v", F.count(F.lit(1)).over(whole).alias("s")))
    cells = totals.groupBy("lang").agg((F.max("v") * (F.max("s") + 1)).alias("cells")).agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    buckets = max(2 * n, -(-cells // CELLS))
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    everywhere = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    priced = dealt.groupBy("bucket").cogroup(everywhere.groupBy("bucket")).applyInArrow(price(terms), _SCHEMA)
    summed = written(priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda part, rows: rows.filter(F.col("part") == part).withColumn("rank", F.row_number().over(by_value))
    # a group's terms come from all buckets: cut them in as many parts as its rows then come from
    salt = F.pmod(F.xxhash64("item"), F.lit(max(1, math.isqrt(n))))
    cut = summed.withColumn("salt", salt).withColumn("at", F.row_number().over(Window.partitionBy("lang", "source", "part", "salt").orderBy(F.col("value").desc(), F.col("item"))))
    dearest = ranked("term", cut.filter((F.col("part") == "term") & (F.col("at") <= terms)).drop("salt", "at"))
    return ranked("pair", summed).unionByName(dearest.filter(F.col("rank") <= terms))
