import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import divergence
from lorespark.llm.queries import DIVERGENCE_SQL, op11_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, most=200):
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        df.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in df.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def p_of(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        p = {s: p_of(counts[lang, s]) for s in sources}
        q = p_of(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for name in ("code", "n", "term", "counts", "bucket", "value"):
        df = df.withColumn(name, F.lit(1))
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [*"abcdefg", "Ab", "aB", "é", "日本", "ß", "x1y", "don't"]
    rows = [(str(rng.choice(["en", "de", "fr"])), f"s{rng.integers(0, 5)}", " ".join(rng.choice(words, rng.integers(0, 20)))) for _ in range(n)]
    rows += [(None, "s1", "a b"), ("", None, "a a b"), ("", "s1", "a"), (None, None, None), ("en", "none", "..."), ("en", "none2", ""), ("only", "one", "w w w"), ("two", "x", "q"), ("two", "y", "r")]
    return rows + [("de", "s1", "tie ties tied")] * 4 + [("de", "s2", "long " * 5000)] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least=1, terms=4) == brute(rows, 1, 4)
    assert run(spark, rows, least=10**6) == brute(rows, 10**6)
    assert run(spark, []) == []


def test_many_small_buckets_and_slices(spark, monkeypatch):
    """The result does not depend on how terms are dealt or texts are cut."""
    import lorespark.llm.divergence as d

    rows = corpus(3)
    want = brute(rows)
    monkeypatch.setattr(d, "CELLS", 20)
    assert run(spark, rows) == want


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 40), st.integers(0, 3), st.integers(0, 10**6))
def test_trees(rows, n, most, seed):
    counts = np.random.default_rng(seed).integers(0, most + 1, (rows, n))
    trees = divergence.Trees(counts)
    for a in range(rows):
        others = np.arange(rows)
        which, x, y, times = trees.count_pairs(a, others)
        got = {(k, i, j): t for k, i, j, t in zip(which.tolist(), x.tolist(), y.tolist(), times.tolist())}
        assert got == dict(Counter((k, i, j) for k in range(rows) for i, j in zip(counts[a].tolist(), counts[k].tolist())))
        at, x, y = trees.places(a, rows - 1)
        assert sorted(zip(at.tolist(), x.tolist(), y.tolist())) == [(k, int(counts[a, k]), int(counts[-1, k])) for k in range(n) if counts[a, k]]
    # equal subtrees are one node
    again = divergence.Trees(np.vstack([counts, counts]))
    assert [len(c[0]) for c in again.children] == [len(c[0]) for c in trees.children]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 9 * 10**15 - 2), st.integers(1, 9 * 10**15))
def test_probability_is_exact(count, total):
    total = max(total, count + 1)
    assert divergence.probability(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    cur = con.execute(DIVERGENCE_SQL)
    names = [x[0] for x in cur.description]
    df = op11_divergence(spark, f"/root/testdata/{sf}")
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert sorted(names) == sorted(df.columns) and got == sorted(cur.fetchall())
    assert {r[2] for r in got} == {"pair", "term"}
