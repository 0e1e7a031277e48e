"""Searches over questions and pages against plain Python, and what they hold at once."""

import random
import tracemalloc

import numpy as np

from lorespark.functions import vectors as V
from lorespark.operators import retrieval as R

WORDS = ["alpha", "beta", "gamma", "delta", "on", "x1"]


def test_boosts_of_trees(spark):
    """Several trees and pages a source, sources without pages, pages without sources: no match is shuffled, only best pages are."""
    rng = random.Random(1)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    pages = [(f"s{k:02d}", text(3), text(4), text(8), None if k % 5 == 0 else f"d{k % 7}") for k in range(40)]
    nodes = [(f"d{k % 4}", f"t{k % 3}", "alpha" if k % 2 else "zeta", text(2)) for k in range(12)] + [("gone", "t", "omega", "")]
    asked = [(1, "alpha beta"), (2, "gamma"), (3, "omega on"), (4, "zeta"), (5, "nowhere"), (6, "on x1 x1")]
    count = lambda q, ts, fields, whole, one: sum(w for f, w in zip(fields, whole) if q in f) + sum(w for t in ts for f, w in zip(fields, one) if t in f)
    want = []
    for i, q in asked:
        trees: dict = {}
        for d, t, title, summary in nodes:
            trees[d, t] = trees.get((d, t), 0) + count(q, q.split(), (title, summary), (8, 6), (4, 3))
        boost = {d: max(v for (e, _), v in trees.items() if e == d) for d, _ in trees}
        some = any(boost.values())
        scored = [(-(count(q, q.split(), p[1:4], (8, 6, 4), (4, 3, 1)) + boost.get(p[4], 0)), p[0]) for p in pages if not some or boost.get(p[4], 0)]
        want += [(i, slug, -s) for s, slug in sorted(scored)[:1] if s]
    p = spark.createDataFrame(pages, "slug string, title string, summary string, body string, source_relpath string").repartition(3)
    n = spark.createDataFrame(nodes, "relpath string, tree_slug string, title string, summary string").repartition(3)
    got = R.tree_boosted_search(spark.createDataFrame(asked, "query_id long, question string"), p, n)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[0] for w in want} >= {1, 2, 4}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similarities_held_at_once():
    """The nearest of many vectors, ties to the smaller id, with a bounded number of similarities at a time."""
    rng = np.random.default_rng(2)
    queries, base = V._unit(rng.integers(-2, 3, (1024, 6)).astype(float)), rng.integers(-2, 3, (8192, 6)).astype(float)
    ids = rng.permutation(8192) * 3
    tracemalloc.start()
    q, i, s = V._best(np.arange(1024), queries, ids, base, 5, 4)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 50e6  # all at once are 67 MB, and were held several times
    all_ = np.round(np.maximum(queries @ V._unit(base).T, 0), 4)
    for k in range(0, 1024, 50):
        assert i[q == k].tolist() == ids[np.lexsort((ids, -all_[k]))[:5]].tolist() and s[q == k].tolist() == sorted(all_[k], reverse=True)[:5]


def test_tokens_held_at_once():
    """Texts are embedded in runs of bounded numbers of tokens, one text at least."""
    runs = list(V._runs(np.array([5, 5, 50, 1, 2, 8, 0]), 10))
    assert runs == [(0, 2), (2, 3), (3, 5), (5, 7)]


def test_hubs_of_a_graph(spark, monkeypatch):
    """A node with most edges: many scores are dealt to parts, and give what few give."""
    nodes = spark.createDataFrame([("h", "hub", ["hub"])] + [(f"n{k}", f"name {k}", None) for k in range(50)], "id string, label string, aliases array<string>")
    edges = spark.createDataFrame([(f"e{k}", "impacts", f"n{k}", "h", "why it is") for k in range(50)], "id string, relation string, src string, dst string, evidence string")
    asked = spark.createDataFrame([(1, "why hub"), (2, "what impacts name 7")], "query_id long, question string")
    scores = lambda: sorted(map(tuple, R.graph_scores(asked, nodes, edges, R.keyword_table(spark)).collect()))
    few = scores()
    monkeypatch.setattr(R, "MOST_SCORES", 0)
    assert scores() == few and (1, "e3", 7.0) in few and len(few) == 100


def test_rows_written_by_components(spark, monkeypatch):
    """Nodes are not written again in each round."""
    from lorespark.operators import components as C

    rows, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df: (out := real(df), rows.append(out.count()))[0])
    got = C.connected_components(spark.range(400).selectExpr("id src", "id + 1 dst"))
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(401)]
    assert sum(rows) < 401 * 8
