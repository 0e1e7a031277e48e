import random

import duckdb
import pytest

from lorespark.llm import licenses
from lorespark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
FIELDS = ("doc_id", "template", "shared", "shingles", "first_word")


def words(text):
    return (text or "").encode().translate(licenses.FOLD).split()


def brute(rows, notices):
    out = []
    for i, text in rows:
        own = words(text)
        for n, (_, notice) in enumerate(notices):
            w = words(notice)
            s = min(5, len(w))  # a notice of fewer words is one shingle
            grams = [tuple(own[k : k + s]) for k in range(len(own) - s + 1)]
            places = [tuple(w[k : k + s]) for k in range(len(w) - s + 1)] if w else []
            if not places:
                continue
            runs = [(len(set(places) & set(grams[k : k + len(places)])), -k) for k in range(len(grams)) if grams[k] in places]
            if runs and 5 * max(runs)[0] >= 4 * len(set(places)):
                out.append((i, n, max(runs)[0], len(set(places)), -max(runs)[1]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=repr)


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(oracle_sql()["op4_license_scan"])
    names = [x[0] for x in cur.description]
    want = sorted(cur.fetchall())
    df = queries()["op4_license_scan"](spark, SF)
    assert df.columns == names and sorted(map(tuple, df.collect())) == want and len(want) > 5


def changed(rng, notice):
    """A notice with about a tenth of its shingles broken, in other case and with other marks."""
    w = notice.split()
    for _ in range(max(0, len(w) // 60)):
        w[rng.randrange(len(w))] = "changed"
    return "\n* ".join(w).upper() if rng.random() < 0.5 else "  ".join(w)


@pytest.mark.parametrize("block", [64, 1 << 17])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK", block)
    rng = random.Random(block)
    common = "the of licensed under a to and software license version MIT free is 2.0 été 版".split()
    rows = []
    for i in range(300):
        text = [rng.choice(common) for _ in range(rng.choice((0, 3, 40, 400)))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            text.insert(rng.randrange(len(text) + 1), changed(rng, rng.choice(licenses.NOTICES)[1]))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, licenses.NOTICES)
    assert got(licenses.scan(df)) == want and len(want) > 100
    assert got(licenses.scan(df, most_bytes=200)) == want  # templates in several blocks


def test_defined_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, "a"), (2, "", "b"), (None, mit, "c"), (3, mit, "d"), (3, mit, "d"), (4, "x " * 200_000 + mit + " y" * 10, None), (5, "released under the", "e"), (6, "MIT License", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumnRenamed("license", "template")
    out = licenses.scan(df)
    assert got(out) == sorted([(None, 0, 1, 1, 0), (3, 0, 1, 1, 0), (3, 0, 1, 1, 0), (4, 0, 1, 1, 200_000)], key=repr)
    assert {r.license for r in out.collect()} == {"MIT"}
    assert licenses.scan(df.limit(0)).count() == 0
    assert {r.doc_id for r in licenses.scan(df, [("short", "MIT License"), ("none", "--")]).collect()} == {None, 3, 4, 6} and licenses.scan(df, []).count() == 0


def test_every_notice_is_found(spark):
    rows = [(n, f"some words before it {text} and after") for n, (_, text) in enumerate(licenses.NOTICES)]
    found = {(r.doc_id, r.template) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(n, n) for n, _ in rows} <= found


def test_bands_keep_their_promise():
    for similarity in (0.3, 0.6, 1.0):
        n = licenses.needed_bands(similarity, 2, 1e-4)
        assert (1 - similarity**2) ** n <= 1e-4
