"""Answering batches of questions: routing, four collectors, rank fusion, evidence, write-back.

Questions are a stated set: a table (query_id, question). A block of at most MOST_QUESTIONS is checked before it is
broadcast; `in_blocks` makes such blocks of a set of any size, and answers them one after the other. Pages, chunks and trees may have any size: each is read once a
block, scored where it lies, and cut to the best rows of each question before anything is shuffled.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.text import evidence_quote, graph_terms, lexical_terms, query_terms
from lorespark.functions.vectors import cosine, embedded, nearest, top_k
from lorespark.operators.tables import partitions, union_all, written

MOST_QUESTIONS = 5_000
#: Scores of nodes that are broadcast, and parts of a node's edges where there are more.
MOST_SCORES, SALTS = 200_000, 16
ROUTES = ("wiki", "graph", "vector", "page_tree")

# Routing rules (id, priority, route, second route, keywords), and words that change a route's weight.
RULES = (
    ("summary", 10, "wiki", None, ("總結", "摘要", "概述", "重點", "報告"), ("summary", "summarize", "overview", "tl;dr")),
    ("relation", 20, "graph", "wiki", ("影響", "關係", "依賴", "為什麼", "原因", "受影響"), ("impact", "relation", "depends", "dependency", "why", "because")),
    ("detail", 30, "vector", None, ("原文", "細節", "條款", "片段", "引用"), ("excerpt", "detail", "clause", "passage", "verbatim")),
)
DEFAULT_ROUTE = "vector"
WIKI_WORDS = ("摘要", "總結", "重點", "說明", "summary", "overview")
LEXICAL_BONUS, SIMILARITY_FLOOR, RRF_K = 0.35, 0.2, 60
WIKI_PRIMARY, WIKI_SECONDARY = 1.0, 0.65


def small(questions: DataFrame) -> DataFrame:
    """questions, marked for broadcast after a check of their number."""
    if questions.limit(MOST_QUESTIONS + 1).count() > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions: use in_blocks")
    return F.broadcast(questions)


def in_blocks(questions: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers to all questions, block by block. A block holds half of MOST_QUESTIONS in expectation; each one's answers are written before the next begins."""
    blocks = -(-2 * questions.count() // MOST_QUESTIONS)
    if blocks <= 2:
        return answer(questions)
    at = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.union, [written(answer(questions.filter(at == k))) for k in range(blocks)])


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    rows = [(i, p, r, s, list(zh), list(en)) for i, p, r, s, zh, en in rules]
    return spark.createDataFrame(rows, "rule_id string, priority int, target_route string, secondary string, zh array<string>, en array<string>")


def route(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """query_id, rule_id, route, secondary, hits (of the chosen rule) and score. The first rule with a keyword wins, else the most similar, else the default."""
    keys = F.concat("zh", "en")
    texts = rules.select(F.col("rule_id"), F.array_join(keys, " ").alias("text"))
    prototypes = embedded(texts, "rule_id", "text").withColumnRenamed("vector", "rule_vector")
    asked = embedded(questions, "query_id", "question", "question")
    both = asked.crossJoin(F.broadcast(rules.join(prototypes, "rule_id")))  # a handful of rules
    q, low = F.col("question"), F.lower("question")
    hits = F.size(F.filter("zh", lambda k: q.contains(k))) + F.size(F.filter("en", lambda k: low.contains(k)))
    similar = F.coalesce(cosine(F.col("vector"), F.col("rule_vector")), F.lit(0.0))
    scored = both.select("query_id", "rule_id", "priority", "target_route", "secondary", hits.alias("hits"), F.round(similar + hits * LEXICAL_BONUS, 4).alias("score"))
    pick = F.struct((F.col("hits") > 0).alias("hit"), F.when(F.col("hits") > 0, 0.0).otherwise(F.col("score")).alias("by"), (-F.col("priority")).alias("first"), "rule_id", "target_route", "secondary", "hits", "score")
    best = scored.groupBy("query_id").agg(F.max(pick).alias("b")).select("query_id", "b.*")
    use = F.col("hit") | (F.col("score") > 0)
    return best.select(
        "query_id",
        F.when(use, F.col("rule_id")).otherwise("default").alias("rule_id"),
        F.when(use, F.col("target_route")).otherwise(DEFAULT_ROUTE).alias("route"),
        F.when(use, F.col("secondary")).alias("secondary"),
        "hits",
        "score",
    )


def wiki_score(question: Column, terms: Column, title: Column, summary: Column, body: Column) -> Column:
    """The whole question in title, summary, body: 8, 6, 4; each term: 4, 3, 1. All in lower case."""
    fields = (title, summary, body)
    whole = sum((F.when(f.contains(question), w).otherwise(0) for f, w in zip(fields, (8, 6, 4), strict=True)), F.lit(0))
    one = lambda t: sum((F.when(f.contains(t), w).otherwise(0) for f, w in zip(fields, (4, 3, 1), strict=True)), F.lit(0))
    return whole + F.aggregate(terms, F.lit(0), lambda s, t: s + one(t))


class Containment:
    """Scores of texts against all questions at once: one automaton finds every term and question that a text contains in one pass."""

    def __init__(self, questions: list[tuple[int, str, list[str]]], whole: tuple[int, ...], term: tuple[int, ...]) -> None:
        import ahocorasick

        self.ids, self.whole, self.term = np.array([i for i, _, _ in questions], dtype=np.int64), whole, term
        number: dict[str, int] = {}
        uses: list[tuple[int, int, int, int]] = []  # pattern, question, as a whole, as a term
        for k, (_, q, terms) in enumerate(questions):
            uses += [(number.setdefault(t, len(number)), k, 0, n) for t, n in Counter(terms).items()]
            if q:
                uses.append((number.setdefault(q, len(number)), k, 1, 0))
        self.empty = np.array([k for k, (_, q, _) in enumerate(questions) if not q], dtype=np.int64)
        self.found = ahocorasick.Automaton()
        for p, n in number.items():
            self.found.add_word(p, n)
        if number:
            self.found.make_automaton()
        u = np.array(sorted(uses), dtype=np.int64).reshape(-1, 4)
        self.question, self.as_whole, self.as_term = u[:, 1], u[:, 2], u[:, 3]
        self.begin = np.searchsorted(u[:, 0], np.arange(len(number) + 1))

    def score(self, fields: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Questions that match, by their places, and their scores: work for what is found, not for each question."""
        places, scores = [], []
        for text, whole, term in zip(fields, self.whole, self.term, strict=True):
            places.append(self.empty)  # the empty question is in every text
            scores.append(np.full(len(self.empty), whole))
            hits = np.array([*{n for _, n in self.found.iter(text)}], dtype=np.int64) if len(self.found) else np.empty(0, dtype=np.int64)
            sizes = self.begin[hits + 1] - self.begin[hits]
            at = np.repeat(self.begin[hits] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            places.append(self.question[at])
            scores.append(whole * self.as_whole[at] + term * self.as_term[at])
        question, at = np.unique(np.concatenate(places), return_inverse=True)
        return question, np.bincount(at, weights=np.concatenate(scores), minlength=len(question)).astype(np.int64)


class Best:
    """The k best rows of each of n questions among those seen: by score, then by the smaller key. It holds n times k rows, whatever number is seen."""

    def __init__(self, n: int, k: int = 1) -> None:
        self.k, self.rows = k, [[] for _ in range(n)]
        self.least, self.last = np.full(n, -np.inf), np.full(n, None, dtype=object)  # of the last row of questions that have k

    def see(self, question: np.ndarray, score: np.ndarray, key, more: tuple = ()) -> None:
        """A row, with its score for some questions (by their places)."""
        least = self.least[question]
        takes = score > least
        tied = np.flatnonzero(score == least)
        takes[tied] = [last > key for last in self.last[question[tied]].tolist()]
        for q, s in zip(question[takes].tolist(), score[takes].tolist(), strict=True):
            rows = self.rows[q]
            insort(rows, (-s, key, more), key=lambda row: row[:2])
            del rows[self.k :]
            if len(rows) == self.k:
                self.least[q], self.last[q] = -rows[-1][0], rows[-1][1]

    def found(self) -> Iterator[tuple]:
        """Place of the question, score, key and the rest of each row."""
        return ((q, -s, key, more) for q, rows in enumerate(self.rows) for s, key, more in rows)


def _few(questions: DataFrame):
    """Id, text and terms of at most MOST_QUESTIONS questions, as a broadcast variable."""
    asked = questions.select("query_id", F.lower(F.trim("question")).alias("q"), query_terms(F.col("question")).alias("terms"))
    return questions.sparkSession.sparkContext.broadcast([(r.query_id, r.q, r.terms) for r in small(asked).collect()])


def _low(*names: str) -> list[Column]:
    return [F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in names]


PAGE, TREE = ((8, 6, 4), (4, 3, 1)), ((8, 6), (4, 3))


def wiki_search(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, slug and score (of wiki_score) of the best page of each question; ties go to the first slug. Questions that match nothing have no row.

    Every page is read once for all questions, one after the other, and a task passes on its best row a question.
    """
    shared = _few(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Containment(shared.value, *PAGE)
        best = Best(len(c.ids))
        for batch in batches:
            for slug, *fields in zip(*batch.columns, strict=True):
                question, score = c.score(tuple(f.as_py() for f in fields))
                best.see(question, score, slug.as_py())
        rows = [(int(c.ids[q]), key, int(score)) for q, score, key, _ in best.found()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["query_id", "slug", "score"])

    found = pages.select("slug", *_low("title", "summary", "body")).mapInArrow(run, "query_id long, slug string, score int")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("slug")], 1).drop("rank")


def tree_boosted_search(questions: DataFrame, pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, slug and score of the best page, where sections count too: a source's best tree (relpath, tree_slug, title, summary) adds to its pages, and if any source matches only its pages count.

    Nodes and pages of a source meet in one task, nodes first, tree by tree; they are read one after the other, and a task
    passes on, for each question, its best page with and its best page without such a source. Matches are not shuffled.
    """
    shared = _few(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages_of, trees_of = Containment(shared.value, *PAGE), Containment(shared.value, *TREE)
        n = len(pages_of.ids)
        with_, without = Best(n), Best(n)
        some, boost, tree = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        at = None
        for batch in batches:
            for source, part, key, *fields in zip(*batch.columns, strict=True):
                source, part, key = source.as_py(), part.as_py(), key.as_py()
                texts = tuple(f.as_py() for f in fields)
                if at is None or at[0] != source:
                    boost, tree = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                elif at != (source, part, key):
                    boost, tree = np.maximum(boost, tree), np.zeros(n, dtype=np.int64)
                at = source, part, key
                if part == 0:
                    question, score = trees_of.score(texts[:2])
                    tree[question] += score
                    some[question] = True
                    continue
                question, own = pages_of.score(texts)
                if source is not None and boost.any():
                    whole = boost.copy()
                    whole[question] += own
                    on = np.flatnonzero(boost)
                    with_.see(on, whole[on], key)
                    rest = boost[question] == 0
                    question, own = question[rest], own[rest]
                without.see(question, own, key)
        # a question that a tree matches takes no page without one, even where that tree's source has no page
        rows = [(int(pages_of.ids[q]), key, int(score), has) for best, has in ((with_, True), (without, False)) for q, score, key, _ in best.found()]
        rows += [(int(pages_of.ids[q]), None, 0, True) for q in np.flatnonzero(some)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.bool_()))], ["query_id", "slug", "score", "boosted"])

    node = nodes.select(F.col("relpath").alias("source"), F.lit(0).alias("part"), F.col("tree_slug").alias("key"), *_low("title", "summary"), F.lit("").alias("body"))
    page = pages.select(F.col("source_relpath").alias("source"), F.lit(1).alias("part"), F.col("slug").alias("key"), *_low("title", "summary", "body"))
    # rows without a source need not meet, so they are dealt by their keys
    rows = node.unionByName(page).repartition("source", F.when(F.col("source").isNull(), F.col("key"))).sortWithinPartitions("source", "part", "key")
    found = rows.mapInArrow(run, "query_id long, slug string, score long, boosted boolean")
    return top_k(found, ["query_id"], [F.desc("boosted"), F.desc("score"), F.col("slug")], 1).filter("score > 0").select("query_id", "slug", "score")


def section_context(hits: DataFrame, manifest: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits (relpath, tree_node_id) with section_path, where the tree (relpath, node_id, section_path, source_sha256) is of the digest the manifest (relpath, sha256) has."""
    fresh = nodes.join(manifest.select("relpath", F.col("sha256").alias("source_sha256")), ["relpath", "source_sha256"], "left_semi")
    return hits.join(fresh.select("relpath", F.col("node_id").alias("tree_node_id"), "section_path"), ["relpath", "tree_node_id"], "left")


def best_hit(hits: DataFrame) -> DataFrame:
    """The hit of each question with the most common terms, then the highest similarity."""
    shared = F.size(F.array_intersect(lexical_terms(F.col("question")), lexical_terms(F.col("text"))))
    return top_k(hits.withColumn("shared", shared), ["query_id"], [F.desc("shared"), F.desc("similarity"), F.col("chunk_id")], 1).drop("rank", "shared")


def wiki_overview(pages: DataFrame, n: int = 5) -> DataFrame:
    """The first pages by slug, as one text of bullets."""
    first = pages.select("slug", "title", "summary").orderBy("slug").limit(n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("slug", "title", "summary"))), lambda p: F.concat(F.lit("- "), p.getField("title"), F.lit(": "), p.getField("summary")))
    return first.agg(F.array_join(lines, "\n").alias("overview"))


def wiki_candidates(questions: DataFrame, pages: DataFrame, routed: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """best: what wiki_search gives, if it is there: a row a question, so it goes to where the pages are."""
    hit = F.broadcast(wiki_search(questions, pages) if best is None else best).join(pages.select("slug", "title", "summary", "source_relpath"), "slug")
    words = reduce(lambda a, w: a | F.lower("question").contains(w), WIKI_WORDS, F.lit(False))
    open_ = questions.join(routed.select("query_id", "route"), "query_id").filter((F.col("route") == "wiki") | words)
    score = F.when(F.col("route") == "wiki", WIKI_PRIMARY).otherwise(WIKI_SECONDARY)
    return open_.join(hit, "query_id").select("query_id", F.lit(0).alias("idx"), F.lit("wiki").alias("route"), score.alias("score"), F.concat("title", F.lit(": "), "summary").alias("text"), F.col("source_relpath").alias("relpath"), F.lit(None).cast("string").alias("section_path"))


def relevant(question: Column, text: Column, similarity: Column) -> Column:
    """A hit that shares a term with the question; without terms, one that is similar enough."""
    terms = lexical_terms(question)
    return F.when(F.size(terms) > 0, F.arrays_overlap(terms, lexical_terms(text))).otherwise(similarity >= SIMILARITY_FLOOR)


def _path(df: DataFrame) -> Column:
    """section_path of a table that may have none."""
    return (F.col("section_path") if "section_path" in df.columns else F.lit(None).cast("string")).alias("section_path")


def vector_candidates(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 50, keep: int = 5) -> DataFrame:
    """chunks: chunk_id, relpath, text; vectors: chunk_id, vector."""
    asked = embedded(questions, "query_id", "question").withColumnRenamed("vector", "v")
    # k rows a question, of a checked number: they go to the texts, which are not shuffled
    few = small(questions)
    hits = F.broadcast(nearest(vectors, "chunk_id", "vector", asked, "query_id", "v", k)).join(chunks.select("chunk_id", "relpath", "text", _path(chunks)), "chunk_id").join(few, "query_id")
    near = hits.filter(relevant(F.col("question"), F.col("text"), F.col("similarity"))).drop("rank")
    best = top_k(near, ["query_id"], [F.desc("similarity"), F.col("chunk_id")], keep)
    return best.select("query_id", (F.col("rank") - 1).alias("idx"), F.lit("vector").alias("route"), F.col("similarity").alias("score"), "text", "relpath", "section_path")


def tree_candidates(questions: DataFrame, nodes: DataFrame, keep: int = 5) -> DataFrame:
    """nodes: relpath, preorder, title, summary. Only nodes with a common term count: 2 for each in the title, 1 in the summary. A node's terms are looked up among those of the questions where it lies, and a task passes on `keep` rows a question."""
    asked = [(r["query_id"], r["terms"]) for r in small(questions.select("query_id", lexical_terms(F.col("question")).alias("terms"))).collect()]  # MOST_QUESTIONS at most
    shared = nodes.sparkSession.sparkContext.broadcast(asked)
    have = nodes.filter("summary != ''").select("relpath", "preorder", "title", "summary", _path(nodes), lexical_terms(F.col("title")).alias("__title"), lexical_terms(F.col("summary")).alias("__summary"))
    names = ["relpath", "preorder", "title", "summary", "section_path"]
    shape = ", ".join(f"{c} {have.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in shared.value], dtype=np.int64)
        wants: dict[str, list[int]] = {}
        for k, (_, terms) in enumerate(shared.value):
            for t in terms:
                wants.setdefault(t, []).append(k)
        of = {t: np.array(k, dtype=np.int64) for t, k in wants.items()}
        best, kinds = Best(len(ids), keep), None
        for batch in batches:
            kinds = batch.schema.types[:-2]
            for *kept, title, summary in zip(*batch.columns, strict=True):
                hits = [of[t] for t in title.as_py() or () if t in of]
                hits += hits
                hits += [of[t] for t in summary.as_py() or () if t in of]
                if hits:
                    question, points = np.unique(np.concatenate(hits), return_counts=True)
                    row = tuple(x.as_py() for x in kept)
                    best.see(question, np.minimum(points / 10, 0.85), tuple((x is not None, x) for x in row[:2]), row)
        rows = [(int(ids[q]), score, row) for q, score, _, row in best.found()]
        if rows:
            columns = [pa.array([r[2][k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *columns, pa.array([r[1] for r in rows], pa.float64())], ["query_id", *names, "score"])

    scored = have.mapInArrow(run, f"query_id long, {shape}, score double")
    return node_candidates(top_k(scored, ["query_id"], [F.desc("score"), F.col("relpath"), F.col("preorder")], keep))


def node_candidates(best: DataFrame) -> DataFrame:
    """Candidates from the best nodes (query_id, rank, score, title, summary, relpath, section_path)."""
    return best.select("query_id", (F.col("rank") - 1).alias("idx"), F.lit("page_tree").alias("route"), "score", F.concat("title", F.lit(": "), "summary").alias("text"), "relpath", "section_path")


def fuse(candidates: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: candidates with route_rank, rrf and position. Ties: raw score, then route order and index."""
    order = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    ranked = candidates.withColumn("route_ord", order).withColumn("route_rank", F.row_number().over(Window.partitionBy("query_id", "route").orderBy(F.desc("score"), "idx")))
    ranked = ranked.withColumn("rrf", 1.0 / (RRF_K + F.col("route_rank")))
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("score"), "route_ord", "idx")))


def rerank(fused: DataFrame, ranking: DataFrame, most: int = 10) -> DataFrame:
    """fused, in the order a reranker gave for its first rows: ranking (query_id, indices from 0); what it leaves out follows."""
    at = F.when(F.col("position") <= most, F.array_position("indices", F.col("position").cast("int") - 1)).otherwise(0)
    out = fused.join(ranking, "query_id", "left").withColumn("at", F.coalesce(at, F.lit(0)))
    order = [F.when(F.col("at") > 0, F.col("at")).otherwise(1_000_000), F.col("position")]
    return out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("at", "indices")


def valid_ranking(ranking: DataFrame, first: DataFrame) -> DataFrame:
    """Rankings (query_id, indices) whose indices are those of candidates (query_id, index) and come once each; of several of a question none."""
    n = first.groupBy("query_id").agg(F.count("*").alias("n"))
    one = ranking.groupBy("query_id").agg(F.count("*").alias("times"), F.first("indices").alias("indices")).filter("times = 1").join(n, "query_id")
    fits = (F.size(F.array_distinct("indices")) == F.size("indices")) & F.forall("indices", lambda i: F.coalesce((i >= 0) & (i < F.col("n")), F.lit(False)))
    return one.filter(fits).select("query_id", F.col("indices").cast("array<int>").alias("indices"))


def answers(questions: DataFrame, fused: DataFrame, routed: DataFrame, missing: str = "no relevant knowledge found") -> DataFrame:
    """One row a question: answer, route, confidence (the winner's own score), source and quote; a fixed answer where nothing was found."""
    best = fused.filter("position = 1").select("query_id", "text", F.col("route").alias("won"), "score", "relpath", _path(fused))
    out = questions.join(routed.select("query_id", "route"), "query_id", "left").join(best, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("text", F.lit(missing)).alias("answer"),
        F.coalesce("won", "route").alias("route"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
        F.coalesce("relpath", F.lit("")).alias("source"),
        F.coalesce(evidence_quote(F.col("text")), F.lit("")).alias("quote"),
        F.coalesce("section_path", F.lit("")).alias("section_path"),
    )


def writeback(answered: DataFrame, mode: str = "auto", threshold: float = 0.75, terminal: bool = False) -> DataFrame:
    """query_id, action and status: whether an answer goes back into the wiki."""
    sure = F.col("confidence") >= threshold
    action = {"yes": F.lit("commit"), "no": F.lit("skip"), "auto": F.when(sure, "commit").otherwise("skip"), "ask": F.lit("ask" if terminal else "skip")}[mode]
    status = {"yes": F.lit("forced"), "no": F.lit("disabled"), "auto": F.when(sure, "confident").otherwise("below_threshold"), "ask": F.lit("asked" if terminal else "no_terminal")}[mode]
    return answered.select("query_id", action.alias("action"), status.alias("status"))


def related_pages(touched: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id and the sorted slugs of pages whose source was touched (query_id, relpath)."""
    found = touched.join(pages.select("slug", F.col("source_relpath").alias("relpath")), "relpath")
    return found.groupBy("query_id").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def _with_scores(ends: DataFrame, scores: DataFrame) -> DataFrame:
    """Ends of edges (id, node) with the scores of their nodes (query_id, node, node_score). Few scores go to the edges; where there are more than MOST_SCORES, a node's edges are dealt to SALTS tasks, as one node may have most of them."""
    if scores.count() <= MOST_SCORES:
        return ends.join(F.broadcast(scores), "node")
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return ends.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["node", "salt"])


def graph_scores(questions: DataFrame, nodes: DataFrame, edges: DataFrame, keywords: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, edge id and score of edges with a score. most: of edges that have nothing but a wanted relation, only those that are among so many smallest ids of it: enough for the first `most` answers, as these all score alike. nodes: id, label, aliases; edges: id, relation, src, dst, evidence; keywords: relation, keyword.

    A node needs a common term or an alias in the question, an edge a scored end, a wanted relation or a common term, so
    questions meet nodes and edges through terms and relations. Aliases are looked up by the terms they hold.
    """
    # an edge may have rows for many questions, and all edges may lie in one small file
    edges = edges.repartition(partitions(edges.sparkSession), "id")
    asked = small(questions.select("query_id", F.lower("question").alias("q"), graph_terms(F.col("question")).alias("q_terms")))
    q_terms = F.broadcast(asked.select("query_id", "q", F.explode("q_terms").alias("term")))
    names = nodes.select(F.col("id").alias("node"), F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("names"))
    listed = names.select("node", "names", F.explode(F.array_distinct(F.flatten(F.transform("names", graph_terms)))).alias("term"))
    node = listed.join(q_terms, "term").groupBy("query_id", "node").agg(F.count("*").alias("common"), F.first("names").alias("names"), F.first("q").alias("q"))
    q = F.col("q")
    node = node.select("query_id", "node", (F.col("common") + 3.0 * F.size(F.filter("names", lambda a: q.contains(F.lower(a))))).alias("node_score"))
    wanted = desired_relations(questions, keywords)
    ends = _with_scores(edges.select("id", F.explode(F.array("src", "dst")).alias("node")), written(node)).select("query_id", "id", (1.5 * F.col("node_score")).alias("end"), F.lit(0.0).alias("s"))
    words = edges.select("id", F.explode(graph_terms(F.col("evidence"))).alias("term")).join(q_terms.select("query_id", "term"), "term").select("query_id", "id", F.lit(0.0).alias("end"), F.lit(1.0).alias("s"))
    found = ends.union(words)
    score = F.max("end") + F.sum("s")
    if most is None:
        found = found.union(edges.select("id", "relation").join(F.broadcast(wanted), "relation").select("query_id", "id", F.lit(0.0).alias("end"), F.lit(4.0).alias("s")))
        return found.groupBy("query_id", "id").agg(score.alias("score")).filter("score > 0")
    first = top_k(edges.select("id", "relation"), ["relation"], [F.col("id")], most)
    found = found.union(first.join(F.broadcast(wanted), "relation").select("query_id", "id", F.lit(0.0).alias("end"), F.lit(0.0).alias("s"))).groupBy("query_id", "id").agg(score.alias("s"))
    kind = found.join(edges.select("id", "relation"), "id").join(F.broadcast(wanted.withColumn("is_wanted", F.lit(4.0))), ["query_id", "relation"], "left")
    return kind.select("query_id", "id", (F.col("s") + F.coalesce("is_wanted", F.lit(0.0))).alias("score")).filter("score > 0")


def desired_relations(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """query_id and each relation one of whose keywords is in the question."""
    low = F.lower("question")
    return questions.crossJoin(F.broadcast(keywords)).filter(low.contains(F.col("keyword"))).select("query_id", "relation").distinct()


# Question words by relation, and answer sentences.
RELATION_WORDS = (
    ("impacts", ("影響", "受影響", "impact", "affect")),
    ("causes", ("導致", "造成", "引發", "原因", "cause", "because", "reason")),
    ("contradicts", ("矛盾", "衝突", "contradict", "conflict")),
    ("succeeds", ("接續", "後續", "接著", "follow", "succeed")),
    ("depends_on", ("依賴", "相依", "depend", "dependency")),
    ("references", ("引用", "參考", "reference")),
    ("belongs_to", ("屬於", "隸屬", "belong")),
    ("owns", ("擁有", "負責", "own")),
)
SENTENCES = {"impacts": "{} 會影響 {}", "depends_on": "{} 依賴 {}", "references": "{} 參考 {}", "belongs_to": "{} 屬於 {}", "causes": "{} 造成 {}", "contradicts": "{} 與 {} 矛盾", "succeeds": "{} 接續 {}", "owns": "{} 擁有 {}"}
EXPLAIN_WORDS = ("為什麼", "原因", "why", "because", "reason")


def keyword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, w) for r, ws in RELATION_WORDS for w in ws], "relation string, keyword string")


def graph_answers(questions: DataFrame, nodes: DataFrame, edges: DataFrame, keywords: DataFrame, keep: int = 3) -> DataFrame:
    """query_id, answer, confidence, n_edges. Edges of a wanted relation push the others out; the first three make the answer."""
    scored = graph_scores(questions, nodes, edges, keywords, keep).join(edges, "id")
    wanted = F.broadcast(desired_relations(questions, keywords).withColumn("wanted", F.lit(1)))
    scored = scored.join(wanted, ["query_id", "relation"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    # wanted ones come first, so the first row tells whether there are any; a partition passes on `keep` rows a question
    best = top_k(scored, ["query_id"], [F.desc("wanted"), F.desc("score"), F.col("id")], keep)
    best = best.withColumn("some", F.max("wanted").over(Window.partitionBy("query_id"))).filter("wanted = some")
    label = nodes.select("id", "label")
    best = best.join(label.select(F.col("id").alias("src"), F.col("label").alias("s")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("t")), "dst")
    groups = best.groupBy("query_id", "relation", "s").agg(F.min("rank").alias("at"), F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("ts"))
    targets = F.array_join(F.array_distinct(F.transform("ts", lambda x: x.getField("t"))), "、")
    sentence = F.lit(None).cast("string")
    for r, s in SENTENCES.items():
        a, b, c = s.split("{}")
        sentence = F.when(F.col("relation") == r, F.concat(F.lit(a), F.col("s"), F.lit(b), targets, F.lit(c))).otherwise(sentence)
    whole = groups.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", sentence.alias("x")))), lambda x: x.getField("x")), "；").alias("answer"))
    facts = best.groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n_edges"), F.min_by("evidence", "rank").alias("evidence"), F.min_by("source_relpath", "rank").alias("relpath"))
    why = reduce(lambda a, w: a | F.lower("question").contains(w), EXPLAIN_WORDS, F.lit(False))
    reason = F.when(why & (F.coalesce("evidence", F.lit("")) != ""), F.concat(F.lit("（依據："), F.substring("evidence", 1, 100), F.lit("）"))).otherwise("")
    confidence = F.round(F.least(F.lit(0.99), 0.55 + F.least("top", F.lit(6.0)) * 0.06 + (F.col("n_edges") - 1) * 0.05), 4)
    return questions.join(whole, "query_id").join(facts, "query_id").select("query_id", F.concat("answer", reason).alias("answer"), confidence.alias("confidence"), "n_edges", "relpath")


def graph_candidates(questions: DataFrame, nodes: DataFrame, edges: DataFrame, keywords: DataFrame) -> DataFrame:
    out = graph_answers(questions, nodes, edges, keywords)
    return out.select("query_id", F.lit(0).alias("idx"), F.lit("graph").alias("route"), F.col("confidence").alias("score"), F.col("answer").alias("text"), "relpath", F.lit(None).cast("string").alias("section_path"))
