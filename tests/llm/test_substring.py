import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import substring
from lorespark.llm.fmindex import FmIndex


def brute(rows, length=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - length + 1):
                x = tuple(w[k : k + length])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k : k + length])] < i:
                    gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 6))
def test_index(symbols, m):
    s = np.array([x for x in symbols] + [0])
    index = FmIndex(s, max(m, 2))
    windows = np.lib.stride_tricks.sliding_window_view(s, min(m, len(s)))
    patterns = windows[(windows > 0).all(axis=1)]
    if not len(patterns):
        return
    low, high, matched = index.search(patterns)
    for p, a, b, n in zip(patterns, low, high, matched):
        tail = p[len(p) - n :]
        want = {i for i in range(len(s) - n + 1) if (s[i : i + n] == tail).all()}
        assert set(index.suffixes[a:b].tolist()) == want
        assert n == len(p) or b - a == 1


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "q", 5) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    return sorted((tuple(r) for r in substring.dedup(df, **kw).collect()), key=repr)


def test_random_small(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abc"), 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = base[rng.integers(6)]
        a = rng.integers(0, 40)
        rows.append((int(rng.integers(0, 90)), t[a : a + int(rng.integers(0, 80))] + " \t" + " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30)))))
    rows += [(None, base[0]), (3, None), (4, ""), (5, base[0]), (5, base[0]), (-7, base[1])]
    assert run(spark, rows, length=5, anchor=2) == brute(rows, 5)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_corpus(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    out = sorted((tuple(r) for r in substring.dedup(df).collect()), key=repr)
    assert out == brute(rows)
    assert sum(r[2] for r in out) > 0


@pytest.mark.parametrize("hot", [0, 3, 10**9])
def test_hot_anchors_are_dealt_by_window(spark, hot, monkeypatch):
    """The result is the same wherever windows are dealt."""
    monkeypatch.setattr(substring, "HOT", hot)
    rng = np.random.default_rng(7)
    hub = "one passage that very many of these texts have in them at some place or other".split()
    rows = [(i, " ".join([*rng.choice(list("abcd"), 9), *hub[: rng.integers(9, 16)], *rng.choice(list("abcd"), rng.integers(0, 9))])) for i in range(300)]
    rows += [(None, rows[0][1])] * 3 + [(301, None), (302, rows[1][1]), (302, rows[1][1])]
    assert run(spark, rows) == brute(rows)


def test_many_contexts_of_one_anchor(spark):
    """100,000 passages around one anchor: keys tell them apart."""
    rows = [(i, f"w{i} x{i} y{i} z{i} the hub of all of it here w{i} x{i} y{i} z{i}") for i in range(100_000)] + [(100_000, rows_text(5)), (100_001, rows_text(77_777))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = {r.doc_id: r.n_removed for r in substring.dedup(df).filter("n_removed > 0").collect()}
    assert out == {100_000: 15, 100_001: 15}


def rows_text(i):
    return f"w{i} x{i} y{i} z{i} the hub of all of it here w{i} x{i} y{i} z{i}"


def test_texts_keep_columns(spark):
    df = spark.createDataFrame([(1, "a " * 20, None, [1]), (2, "x  " + "a " * 20, 2**60, None), (3, None, 1, None)], "doc_id long, text string, kept long, __n array<int>")
    out = {r.doc_id: r for r in substring.dedup_texts(df).collect()}
    assert out[1].text == "a " * 20 and out[2].text == "x" and out[2].kept == 2**60 and out[1].kept is None and out[3].text is None
    assert substring.dedup_texts(df).columns == df.columns
    clash = df.withColumns({c: F.lit("mine") for c in ("__text", "__id", "id", "bucket", "__bucket", "n_words", "c0", "C1")})
    rows = substring.dedup_texts(clash).collect()
    assert all(r[c] == "mine" for r in rows for c in ("__text", "__id", "id", "bucket", "__bucket", "n_words", "c0", "C1"))
    assert {r.doc_id: r.text for r in rows} == {k: r.text for k, r in out.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\xa0", max_size=30), max_size=6))
def test_scanned_words(texts):
    from lorespark.llm import common

    rows = [t.encode() for t in texts]
    for block in (3, 1 << 20):
        common.BLOCK_BYTES = block
        whole, begin, end, h, row = common.scanned(rows)
        assert [whole[a:b] for a, b in zip(begin, end)] == [w for t in rows for w in t.split()]
        assert row.tolist() == [k for k, t in enumerate(rows) for _ in t.split()]
        words = [whole[a:b] for a, b in zip(begin, end)]
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
