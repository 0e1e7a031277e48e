"""Posting lists: which documents have a term, so that a question reads the lists of its terms and not all texts.

A list is cut into blocks of at most BLOCK postings, the weightiest first, and a block's row tells its number of postings and
the marks that any of them has. A term that very many documents have is salted: its postings are dealt to as many lists as
there are parts of `part_docs` documents, so no list grows with the input. Lists are made for the documents of one
commit, or of one range of a store's base; a posting names its document, and those of replaced documents are left out
when a list is read.

Page search (page_search) finds the best pages by retrieval.wiki_score, exactly. A term of a question counts where it is
part of a longer word, too, so it is looked up in the lists' terms, which are read without their postings.

1. Per question, terms are ordered by the length of their lists. The rarest are read first.
2. The page that has most of these is scored on its own text: the best page has that score at least.
3. Further lists are read only as long as a page that is in none of those read could reach that score by all the others.
4. Pages that can reach it with what is not read are scored on their texts, each once for all questions; only these texts
   are read. Where the lists to be read hold more than DENSE postings for each page there is, as for many long questions of
   frequent terms, all texts are read in their place: rows of lists would be questions times pages.

So lists of frequent terms are mostly skipped. The blocks read are counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import lexical_terms, query_terms
from lorespark.functions.vectors import top_k
from lorespark.operators.retrieval import small, wiki_score, wiki_search

BLOCK, PART_DOCS = 512, 50_000
#: Pages whose terms are told at once.
ROWS = 128
#: Postings a page from which the texts of all pages are read in place of lists.
DENSE = 4
#: Postings of a question that are read before the first score is known, but for one whole term.
FIRST = 4 * BLOCK
#: Marks of the fields that a term is in, and what each counts.
TITLE, SUMMARY, BODY = 4, 2, 1
WORD = re.compile("[A-Za-z0-9一-鿿]{2,}")


def impact(mask: Column) -> Column:
    """What a term counts in a page with these marks."""
    return F.when(mask.bitwiseAND(TITLE) > 0, 4).otherwise(0) + F.when(mask.bitwiseAND(SUMMARY) > 0, 3).otherwise(0) + F.when(mask.bitwiseAND(BODY) > 0, 1).otherwise(0)


def page_entries(pages: DataFrame, *by: str) -> DataFrame:
    """relpath, key (the slug), term and mask of each term of pages (slug, title, summary, body, source_relpath)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, ROWS):
                some = b.slice(begin, ROWS)
                sizes, terms, marks = [], [], []
                for texts in zip(*(some.column(c) for c in ("title", "summary", "body")), strict=True):
                    masks: dict[str, int] = {}
                    for text, mark in zip(texts, (TITLE, SUMMARY, BODY), strict=True):
                        for w in set(WORD.findall(text.as_py())):
                            masks[w] = masks.get(w, 0) | mark
                    sizes.append(len(masks))
                    terms += masks
                    marks += masks.values()
                at = pa.array(np.repeat(np.arange(some.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(at) for c in (*by, "relpath", "key")), pa.array(terms, pa.string()), pa.array(marks, pa.int32())], [*by, "relpath", "key", "term", "mask"])

    low = pages.select(*by, F.col("source_relpath").alias("relpath"), F.col("slug").alias("key"), *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "summary", "body")))
    kinds = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in by)
    return low.mapInArrow(run, f"{kinds}relpath string, key string, term string, mask int")


def node_entries(nodes: DataFrame, *by: str) -> DataFrame:
    """relpath, key (the preorder), term and mask (its points: 2 in the title, 1 in the summary) of each term of tree nodes."""
    points = lambda c, n: F.transform(lexical_terms(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(n).alias("mask")))
    e = F.concat(points("title", 2), points("summary", 1))
    rows = nodes.filter("summary != ''").select(*by, "relpath", F.col("preorder").cast("string").alias("key"), F.explode(e).alias("e"))
    return rows.groupBy(*by, "relpath", "key", F.col("e.term").alias("term")).agg(F.sum("e.mask").cast("int").alias("mask"))


def build(entries: DataFrame, docs: int, *by: str, part_docs: int = PART_DOCS) -> DataFrame:
    """Lists of entries (relpath, key, term, mask): by, term, salt, block, n, marks (of any posting) and posts. docs: the number of documents."""
    salts = max(1, -(-docs // part_docs))
    rows = entries.select(*by, "term", F.pmod(F.xxhash64("relpath"), F.lit(salts)).cast("int").alias("salt"), "relpath", "key", "mask")
    of_list = [*by, "term", "salt"]
    # lists lie whole in a partition, one after the other, so a block is a run of rows
    rows = rows.repartition(*of_list).sortWithinPartitions(*of_list, impact(F.col("mask")).desc(), "key", "relpath")
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in of_list)
    size, wide = BLOCK, len(of_list)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(table: pa.Table, number: int, last: bool) -> tuple[pa.RecordBatch, pa.Table, int]:
            """Blocks of rows, the first of which has that number in its list; and rows of a block that may go on, and its number."""
            n = table.num_rows
            begins = np.zeros(n, dtype=bool)
            for k in range(wide):
                begins[1:] |= np.asarray(pc.not_equal(table.column(k).slice(1), table.column(k).slice(0, n - 1)))
            lists = np.append(0, np.flatnonzero(begins))
            nth = np.arange(n) - np.repeat(lists, np.diff(np.append(lists, n)))
            nth[: lists[1] if len(lists) > 1 else n] += number * size
            starts = np.append(np.flatnonzero(begins | (nth % size == 0) | (np.arange(n) == 0)), n)
            whole = starts if last else starts[:-1]
            end, first = whole[-1], pa.array(whole[:-1])
            posts = pa.StructArray.from_arrays([c.slice(0, end).combine_chunks() for c in table.columns[wide:]], ["relpath", "key", "mask"])
            marks = np.bitwise_or.reduceat(np.asarray(table.column("mask"))[:end], whole[:-1]) if len(first) else np.empty(0, dtype=np.int32)
            heads = [c.combine_chunks().take(first) for c in table.columns[:wide]]
            columns = [*heads, pa.array(nth[whole[:-1]] // size, pa.int32()), pa.array(np.diff(whole), pa.int32()), pa.array(marks, pa.int32()), pa.ListArray.from_arrays(pa.array(whole, pa.int32()), posts)]
            return pa.RecordBatch.from_arrays(columns, [*of_list, "block", "n", "marks", "posts"]), table.slice(end), int(nth[end] // size) if end < n else 0

        left, number = None, 0
        for b in batches:
            if b.num_rows:
                table = pa.Table.from_batches([b])
                done, left, number = cut(table if left is None else pa.concat_tables([left, table]), number, False)
                yield done
        if left is not None:
            yield cut(left, number, True)[0]

    return rows.mapInArrow(run, f"{kinds}block int, n int, marks int, posts array<struct<relpath: string, key: string, mask: int>>")


def _asked_in(terms: list[str]):
    """Rows of lists with each asked term that their own contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asked = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            asked.add_word(t, k)
        if terms:
            asked.make_automaton()
        for b in batches if terms else ():
            for begin in range(0, b.num_rows, 1024):
                some = b.slice(begin, 1024)
                found = [sorted({k for _, k in asked.iter(w)}) for w in some.column("term").to_pylist()]
                at = pa.array(np.repeat(np.arange(some.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([*(x.take(at) for x in some.columns), pa.array([terms[k] for x in found for k in x], pa.string())], [*b.schema.names, "t"])

    return run


def _read(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, t, times, relpath, key and mask, with the batch of the list, of the postings of wanted lists (query_id, t, times, term)."""
    words = wanted.select("term").distinct()
    some = lists.join(words, "term", "left_semi") if words.limit(2001).count() > 2000 else lists.filter(F.col("term").isin([r["term"] for r in words.collect()]))  # 2,000 at most reach the scan's filter
    posts = some.select("term", "batch", F.inline("posts"))
    return posts.join(wanted.select("query_id", "t", "times", "term"), "term").select("query_id", "t", "times", "relpath", "key", "mask", "batch")


def page_search(questions: DataFrame, lists: DataFrame, pages: DataFrame, current: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """query_id, slug and score of the best page of each question, as wiki_search gives them, and the numbers of blocks: all, of lists with a question's term, and read.

    lists: as built, with the batch of each; current: leaves of rows (relpath, batch, ...) those of documents as they are.
    What is told of a question and its terms is on the driver, as their number is checked: lists, postings and pages are not.
    """
    spark = questions.sparkSession
    asked = questions.select("query_id", "question", F.lower(F.trim("question")).alias("q"), query_terms(F.col("question")).alias("terms"))
    few = {r["query_id"]: r for r in small(asked).collect()}  # MOST_QUESTIONS at most
    words = sorted({t for r in few.values() for t in r["terms"]})
    heads = lists.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.bit_or("marks").alias("marks"))
    hits = heads.mapInArrow(_asked_in(words), "term string, n long, blocks long, marks int, t string").persist()
    of_t = {r["t"]: (r["n"], r["marks"]) for r in hits.groupBy("t").agg(F.sum("n").alias("n"), F.bit_or("marks").alias("marks")).collect()}  # a row a term asked for
    # each question's terms by the length of their lists, and the most that a term counts
    ordered: dict[int, list[tuple[int, str, int, int]]] = {}
    for i, r in few.items():
        times = Counter(t for t in r["terms"] if t in of_t)
        ordered[i] = sorted((of_t[t][0], t, n, n * _most(of_t[t][1])) for t, n in times.items())

    def first_of(rows: list[tuple[int, str, int, int]]) -> int:
        """How many terms are read before a score is known."""
        lengths = np.cumsum([x[0] for x in rows])
        return max(min(1, len(rows)), int((lengths <= FIRST).sum()))

    def partial(read: dict[int, int]) -> DataFrame:
        """What pages have by the first terms of each question: query_id, relpath, key, least, have."""
        chosen = [(i, t, n) for i, k in read.items() for _, t, n, _ in ordered[i][:k]]
        wanted = spark.createDataFrame(chosen, "query_id long, t string, times int").join(hits.select("t", "term"), "t")
        one = current(_read(lists, wanted)).groupBy("query_id", "t", "times", "relpath", "key").agg(F.bit_or("mask").alias("mask"))
        return one.groupBy("query_id", "relpath", "key").agg(F.sum(F.col("times") * impact(F.col("mask"))).cast("int").alias("least"), F.sum("times").alias("have"))

    texts = pages.select(F.col("source_relpath").alias("relpath"), F.col("slug").alias("key"), *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "summary", "body")))
    told = F.broadcast(spark.createDataFrame([(i, r["q"], r["terms"]) for i, r in few.items()], "query_id long, q string, terms array<string>"))  # of checked size

    def scored(some: DataFrame) -> DataFrame:
        """query_id, slug and score, by their texts, of pages (query_id, relpath, key)."""
        have = texts.join(some, ["relpath", "key"]).join(told, "query_id")
        score = wiki_score(F.col("q"), F.col("terms"), F.col("title"), F.col("summary"), F.col("body"))
        return have.select("query_id", F.col("key").alias("slug"), score.cast("int").alias("score"))

    read = {i: first_of(rows) for i, rows in ordered.items() if rows}
    seen = partial(read).persist()
    best = {r["query_id"]: r["score"] for r in scored(top_k(seen, ["query_id"], [F.desc("least"), F.col("key")], 1).select("query_id", "relpath", "key")).collect()}
    # a page in no list that is read has, by the others, less than what is reached; and it lacks the rarest term, so it does not hold the whole question
    more, limits = dict(read), []
    for i, k in read.items():
        rows, reached = ordered[i], best.get(i, 1)
        while k < len(rows) and sum(x[3] for x in rows[k:]) >= reached:
            k += 1
        more[i] = k
        # the whole question counts 18 at most, and only where every term of it is
        every = len(few[i]["terms"]) == sum(x[2] for x in rows)
        limits.append((i, reached - sum(x[3] for x in rows[k:]), sum(x[2] for x in rows[:k]) if every else -1))
    postings = sum(x[0] for i, k in more.items() for x in ordered[i][:k])
    if postings > DENSE * BLOCK and postings > DENSE * pages.count():
        able = texts
    else:
        if more != read:
            seen = partial(more)
        bounds = F.broadcast(spark.createDataFrame(limits, "query_id long, needs int, all_read long"))
        able = seen.join(bounds, "query_id").filter(F.col("least") + F.when(F.col("have") == F.col("all_read"), 18).otherwise(0) >= F.col("needs"))
        able = texts.join(able.select("relpath", "key").distinct(), ["relpath", "key"], "left_semi")
    # a page's score for a question that it is no candidate of is right, too, but not the best
    termed = spark.createDataFrame([(i, few[i]["question"]) for i in more], "query_id long, question string")
    found = wiki_search(termed, able.withColumnRenamed("key", "slug"))
    # questions without a term have no lists: their pages are looked for in the texts
    bare = [(i, r["question"]) for i, r in few.items() if not r["terms"]]
    if bare:
        found = found.unionByName(wiki_search(spark.createDataFrame(bare, "query_id long, question string"), pages))
    used = sorted({x[1] for i, k in more.items() for x in ordered[i][:k]})
    one = lambda c: F.coalesce(F.sum(c), F.lit(0))
    words_of = hits.groupBy("term").agg(F.first("blocks").alias("blocks"), F.bool_or(F.col("t").isin(used)).alias("used"))
    matching, taken = words_of.agg(one("blocks"), one(F.when(F.col("used"), F.col("blocks")))).first()
    return found, {"all": lists.count(), "matching": matching, "read": taken}


def _most(marks: int) -> int:
    """impact() of a number."""
    return 4 * bool(marks & TITLE) + 3 * bool(marks & SUMMARY) + bool(marks & BODY)


def node_search(questions: DataFrame, lists: DataFrame, current: Callable[[DataFrame], DataFrame], keep: int = 5) -> DataFrame:
    """query_id, relpath, preorder, score and rank of the best tree nodes of each question, as tree_candidates ranks them."""
    terms = small(questions).select("query_id", F.explode(lexical_terms(F.col("question"))).alias("t"), F.lit(1).alias("times")).withColumn("term", F.col("t"))
    points = current(_read(lists, terms)).groupBy("query_id", "relpath", F.col("key").cast("int").alias("preorder")).agg(F.sum("mask").alias("points"))
    scored = points.withColumn("score", F.least(F.col("points") / 10, F.lit(0.85))).drop("points")
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("relpath"), F.col("preorder")], keep)
