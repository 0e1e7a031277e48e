import random
from functools import reduce
from operator import or_

import pytest
from pyspark.sql import functions as F

from lorespark.operators import postings as P
from lorespark.operators import retrieval as R

WORDS = ["alpha", "alphabet", "be", "beta", "gamma", "專案", "依賴伺服", "x1", "the", "there", "on"]


def corpus(spark, seed, n=120):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    rows = [(f"s{k:03d}", text(3), text(6).upper(), text(30), f"d/{k}") for k in range(n)] + [("z", None, None, None, "d/z")]
    asked = [(k, text(7)) for k in range(20)] + [(50, "?"), (51, ""), (52, "nowhere zz"), (53, rows[5][3]), (54, "be the"), (55, "the the the be")]
    pages = spark.createDataFrame(rows, "slug string, title string, summary string, body string, source_relpath string").repartition(3)
    return pages, spark.createDataFrame(asked, "query_id long, question string")


@pytest.mark.parametrize("seed,block,first", [(1, 4, 8), (2, 512, 2048), (3, 2, 1)])
def test_pages_equal_the_scan(spark, seed, block, first, monkeypatch):
    """Whatever the blocks, the best pages are those of a search through all texts."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "FIRST", first)
    pages, asked = corpus(spark, seed)
    lists = P.build(P.page_entries(pages), 121, part_docs=40).withColumn("batch", F.lit(""))
    assert lists.agg(F.max("n")).first()[0] <= block and lists.select("salt").distinct().count() == 4
    found, counts = P.page_search(asked, lists, pages, lambda rows: rows)
    want = R.wiki_search(asked, pages)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))
    assert 0 < counts["read"] <= counts["matching"] <= counts["all"]


def test_frequent_terms_are_not_read(spark):
    """A question with one rare and many frequent words reads the rare one's list, and few blocks."""
    rows = [(f"s{k:05d}", f"page {k}", "the summary of it", "the of and it is common words here" + (" zanzibar zebra zoology" if k == 777 else ""), f"d/{k}") for k in range(5000)]
    pages = spark.createDataFrame(rows, "slug string, title string, summary string, body string, source_relpath string")
    lists = P.build(P.page_entries(pages), 5000).withColumn("batch", F.lit(""))
    asked = spark.createDataFrame([(1, "zanzibar zebra zoology and common words")], "query_id long, question string")
    found, counts = P.page_search(asked, lists, pages, lambda rows: rows)
    assert [(r.slug, r.score) for r in found.collect()] == [("s00777", 6)]
    assert counts["read"] == 3 and counts["matching"] >= 33


def test_nodes_equal_the_join(spark):
    rng = random.Random(4)
    rows = [(f"d{k % 30}", k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5)))) for k in range(150)]
    nodes = spark.createDataFrame(rows, "relpath string, preorder int, title string, summary string")
    _, asked = corpus(spark, 5)
    lists = P.build(P.node_entries(nodes), 30, part_docs=10).withColumn("batch", F.lit(""))
    got = R.node_candidates(P.node_search(asked, lists, lambda rows: rows).join(nodes.withColumn("section_path", F.lit(None).cast("string")), ["relpath", "preorder"]))
    want = R.tree_candidates(asked, nodes)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() > 20


@pytest.mark.parametrize("dense", [0, 10**9])
def test_texts_in_place_of_long_lists(spark, dense, monkeypatch):
    """Where lists hold more postings than there are pages, all texts are read, with no join of questions and pages; else those of candidates."""
    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P, "DENSE", dense)
    pages, asked = corpus(spark, 6)
    lists = P.build(P.page_entries(pages), 121).withColumn("batch", F.lit(""))
    found, _ = P.page_search(asked, lists, pages, lambda rows: rows)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.wiki_search(asked, pages).select(found.columns).collect()))
    assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (dense > 0)


def test_blocks_of_lists_over_batches(spark, monkeypatch):
    """A list that goes over several Arrow batches has whole blocks in order, but for its last."""
    monkeypatch.setattr(P, "BLOCK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        entries = spark.createDataFrame([(f"d{k}", f"k{k:03d}", t, 1 + k % 7) for k in range(60) for t in ("a", "b", "c")[: 1 + k % 3]], "relpath string, key string, term string, mask int")
        got = P.build(entries, 60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    count = lambda m: 4 * bool(m & 4) + 3 * bool(m & 2) + bool(m & 1)
    for term, least in (("a", 0), ("b", 1), ("c", 2)):
        want = sorted((-count(1 + k % 7), f"k{k:03d}", f"d{k}", 1 + k % 7) for k in range(60) if k % 3 >= least)
        blocks = sorted((r for r in got if r.term == term), key=lambda r: r.block)
        assert [r.block for r in blocks] == list(range(len(blocks))) and all(r.n == 7 for r in blocks[:-1])
        assert [(-count(p.mask), p.key, p.relpath, p.mask) for r in blocks for p in r.posts] == want
        assert all(r.n == len(r.posts) and r.marks == reduce(or_, (p.mask for p in r.posts)) for r in blocks)
