import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorespark.llm import jaccard


def sets(rows):
    out = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        out[n] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute(rows, threshold=0.8):
    """Links between different sets, and the class of each row, through an inverted index of shingles."""
    s = sets(rows)
    distinct = [x for x in dict.fromkeys(s.values()) if x]
    index, links = {}, set()
    for n, x in enumerate(distinct):
        shared = {}
        for g in x:
            for m in index.setdefault(g, []):
                shared[m] = shared.get(m, 0) + 1
            index[g].append(n)
        links.update((m, n) for m, c in shared.items() if c / (len(x) + len(distinct[m]) - c) >= threshold)
    root = list(range(len(distinct)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        root[find(a)] = find(b)
    at = {x: n for n, x in enumerate(distinct)}
    groups = {}
    for n in s:
        groups.setdefault(find(at[s[n]]) if s[n] else ("alone", n), []).append(rows[n][0])
    out = []
    for ids in groups.values():
        lead = min((i for i in ids if i is not None), default=None)
        out += [(i, lead, len(ids)) for i in ids]
    return links, sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_corpus(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    links, want = brute(rows)
    out = jaccard.classes(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    assert result(out) == want
    found = out.select("doc_id", "n_links", "n_copies").groupBy().agg(F.sum(F.col("n_links") / F.col("n_copies"))).first()[0]
    print("links", len(links), "found", (found or 0) / 2)
    assert 0.95 * len(links) <= found / 2 <= len(links)


def test_cases(spark):
    long = " ".join(f"w{k}" for k in range(100))
    near = long.replace("w50", "x")
    rows = [(5, long), (3, near), (9, long), (None, long), (1, None), (2, ""), (4, " \t"), (6, "a b"), (7, "a  b"), (8, "a b c"), (8, "a b c"), (5, "other text of five words here"), (11, long + " x" * 40000)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, key int, hash string")
    assert result(jaccard.classes(df)) == brute(rows)[1]
    kept = sorted((r.doc_id, r.text) for r in jaccard.distinct_documents(df).select("doc_id", "text").collect() if r.text)
    assert (3, near) in kept and (5, "other text of five words here") in kept and (6, "a b") in kept
    assert not any(t == long for _, t in kept)
    assert jaccard.distinct_documents(df).columns == df.columns
    clash = df.withColumns({c: F.lit("mine") for c in ("__id", "__hash", "_id", "_HASH", "signature", "class_id")})
    assert jaccard.distinct_documents(clash).filter("__id = 'mine' and _id = 'mine'").count() == jaccard.distinct_documents(df).count()
    assert jaccard.classes(df.filter("false")).count() == 0


def test_prefixes_follow_the_sizes():
    f = jaccard.Forest()
    for m in range(1, 60):
        least = min((i / (m + q - i) for q in range(1, 100) for i in range(1, min(m, q) + (q != m)) if i / (m + q - i) >= 0.8), default=1.0)
        assert jaccard.least_similarity(m, 0.8) == pytest.approx(least)
        d = int(f.prefixes(np.array([m]))[0])
        assert 1 - (1 - least**d) ** f.trees >= 0.995 and (d == f.depth or 1 - (1 - least ** (d + 1)) ** f.trees < 0.995)
    assert f.shortest == 5 and f.prefixes(np.array([1000]))[0] == 5 and f.prefixes(np.array([7]))[0] == 8


def test_short_texts(spark):
    """Sets of a few shingles, where the prefixes that two texts must share differ."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        w = [f"w{i}_{k}" for k in range(int(rng.integers(5, 22)))]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w, f"x{i}"])), (3 * i + 2, " ".join(w[1:]))]
    want, found = linked(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(want) > 400 and 0.985 * sum(want) <= sum(found) <= sum(want)


def test_large_group(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[: i % 200] + [f"n{i}"] + base[i % 200 + 1 :])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.classes(df)) == brute(rows)[1]


def linked(rows, df):
    """n_links of each row by brute force, and as found."""
    links, _ = brute(rows)
    s = sets(rows)
    distinct = [x for x in dict.fromkeys(s.values()) if x]
    degree = [0] * len(distinct)
    for pair in links:
        for k in pair:
            degree[k] += 1
    at = {x: n for n, x in enumerate(distinct)}
    return [degree[at[s[n]]] for n in range(len(rows))], [r.n_links for r in jaccard.classes(df).sort("doc_id").collect()]


def test_pairs_among_texts_with_a_hot_passage(spark):
    """40 pairs at 18 / 22 = 0.818 among 1500 texts that share a passage of 16 shingles (0.64 to others)."""
    passage = [f"p{k}" for k in range(20)]
    rows = [(i, " ".join([*passage, *(f"t{i}_{k}" for k in range(4))])) for i in range(1420)]
    for i in range(40):
        rows += [(1420 + 2 * i + side, " ".join([*passage, f"q{i}_0", f"q{i}_1", f"r{i}{side}_0", f"r{i}{side}_1"])) for side in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, found = linked(rows, df)
    assert found == want and sum(want) == 80
    assert result(jaccard.classes(df)) == brute(rows)[1]


def test_all_links_of_a_large_group(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[: i % 200] + [f"n{i}"] + base[i % 200 + 1 :])) for i in range(600)]
    want, found = linked(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert min(want) == 599 and sum(want) * 0.995 <= sum(found) <= sum(want)
