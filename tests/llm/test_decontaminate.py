import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import decontaminate
from lorespark.llm.decontaminate import Settings
from lorespark.llm.queries import DECONTAMINATE_SQL, op13_decontaminate

WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=10):
    """Rows of scan() and of longest() by comparing every document with every item."""
    out, best = [], {}
    for i, t in docs:
        w, hit, names, long, at = words(t), set(), set(), 0, None
        for name, x in items:
            v = words(x)
            k = min(window, len(v))
            for b in range(len(v) - k + 1 if k else 0):
                for a in range(len(w) - k + 1):
                    if w[a : a + k] == v[b : b + k]:
                        hit.update(range(a, a + k))
                        names |= {name} - {None}
                        n = k
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        best[name, b] = max(best.get((name, b), 0), n)
                        if n > long or n == long and a < at:
                            long, at = n, a
        out.append((i, len(w), len(hit), tuple(sorted(map(str, names))), long, at))
    return sorted(out, key=repr), best


def both(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string")
    for name in ("n_words", "runs", "items", "digest", "c0", "block"):
        d, t = d.withColumn(name, F.lit("mine")), t.withColumn(name, F.lit("mine"))
    s = Settings(**kw)
    found = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.longest, r.longest_at) for r in decontaminate.scan(d, t, settings=s).collect()), key=repr)
    want, best = brute(docs, items, s.window)
    assert found == want
    rows = decontaminate.scan(d, t, settings=s).collect()
    assert all(sum(x.end - x.begin for x in r.runs) == r.n_hit and all(a.end < b.begin for a, b in zip(r.runs, r.runs[1:])) for r in rows)
    longest = {}
    for r in decontaminate.longest(d, t, settings=s).collect():
        longest[r.item_id and int(r.item_id), r["first"]] = r.n_words
    if s.piece > 1000:
        merged = {}
        for (name, b), n in best.items():
            merged[name, b] = max(n, merged.get((name, b), 0))
        assert longest == merged
    kept = decontaminate.clean(d, t, settings=s)
    assert kept.columns == d.columns
    rows = kept.collect()
    assert sorted(((r.doc_id, len(words(r.text))) for r in rows), key=repr) == sorted(((x[0], x[1]) for x in want if not x[2]), key=repr)
    assert all(r.items == "mine" for r in rows)
    return found


def corpus(seed):
    rng = np.random.default_rng(seed)
    items = [(int(k), " ".join(rng.choice(list("abc"), rng.integers(0, 25)))) for k in rng.integers(0, 12, 14)]
    docs = []
    for _ in range(60):
        parts = [" ".join(rng.choice(list("abcdXYé"), rng.integers(0, 30)))]
        if rng.random() < 0.6:
            parts.append((items[rng.integers(len(items))][1]).upper())
        parts.append("\n".join(rng.choice(list("abz9"), rng.integers(0, 9))))
        docs.append((int(rng.integers(0, 50)), "-".join(parts)))
    docs += [(None, docs[0][1]), (None, docs[0][1]), (7, None), (8, ""), (9, "...")] + docs[:5]
    items += [(None, "a b c a b c a b c a b"), (100, None), (101, ""), (102, "?!"), (103, items[0][1]), items[1]]
    return docs, items


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"window": 4}), (3, {"window": 5, "block": 20, "piece": 7, "shard": 40}), (4, {"window": 10, "block": 30, "shard": 1})])
def test_equal_to_brute_force(spark, seed, kw):
    docs, items = corpus(seed)
    found = both(spark, docs, items, **kw) if "piece" not in kw else None
    if "piece" in kw:  # a longest match ends with its piece; what is hit does not depend on pieces
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        t = spark.createDataFrame(items, "item_id long, text string")
        found = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.scan(d, t, settings=Settings(**kw)).collect()), key=repr)
        assert found == sorted((x[:4] for x in brute(docs, items, kw["window"])[0]), key=repr)
    assert any(x[2] for x in found) and not all(x[2] for x in found)


def test_empty_tables_and_one_word_items(spark):
    docs, items = corpus(5)
    both(spark, docs, [(1, "a"), (2, "9 z"), (3, "Q")])
    for d, t in (([], items), (docs, []), ([], [])):
        both(spark, d, t)


def test_long_texts(spark):
    rng = np.random.default_rng(6)
    long = " ".join(f"w{k}" for k in rng.integers(0, 3000, 60_000))
    item = " ".join(long.split()[20_000:26_000])
    d = spark.createDataFrame([(1, long), (2, " ".join(long.split()[:25_000])), (3, "w1 w2")], "doc_id long, text string")
    t = spark.createDataFrame([(5, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.scan(d, t).collect()}
    assert out[1].n_hit == 6000 and out[2].n_hit == 5000 and out[3].n_hit == 0
    assert out[1].runs[0].begin == 20_000 and out[1].longest == 4096 + 9 and out[1].longest_at == 20_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 70))
def test_suffix_order(symbols, depth):
    s = np.array([*symbols, 0])
    starts = np.flatnonzero(s)
    order = decontaminate.suffix_order(s, starts, depth)
    until = lambda k: [int(x) for x in s[k : k + int(np.argmin(s[k:] > 0))][:depth]]
    assert sorted(order.tolist()) == starts.tolist()
    assert [until(k) for k in order.tolist()] == sorted(until(k) for k in starts.tolist())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '/root/testdata/{sf}/{name}.parquet'")
    cur = con.execute(DECONTAMINATE_SQL)
    names = [x[0] for x in cur.description]
    df = op13_decontaminate(spark, f"/root/testdata/{sf}")
    assert names == df.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(cur.fetchall())
    assert 0 < sum(r[5] for r in got) < len(got)
