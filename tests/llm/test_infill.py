import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import infill
from lorespark.llm.queries import INFILL_SQL, op12_infill

ODD = [(1, None), (2, ""), (3, "a"), (4, "word word\nword"), (5, "has <P> in it"), (6, "<"), (7, "<S"), (8, "日本語 é\x00  x"), (9, "z" * 100_000), (10, "ab " * 50_000), (None, "no id"), (12, "tie"), (12, "tie"), (12, "other"), (-5, "<P<S<M"), (2**62, "P> M> S>")]


def plainly(i, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units, at = [], 0
    while at < len(text):
        to = at + 1
        if re.match("[A-Za-z]", text[at]):
            while to < len(text) and re.match("[A-Za-z]", text[to]):
                to += 1
        units.append(text[at:to])
        at = to
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_odd_texts_and_clashing_columns(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("n", "form", "output", "h1", "h", "c0"):
        df = df.withColumn(name, F.lit("mine"))
    out = infill.fill_in_middle(df).withColumn("back", infill.restored()).collect()
    assert sorted((tuple(r)[:-1] for r in out), key=repr) == sorted((plainly(*x) for x in ODD), key=repr)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in ODD)
    assert infill.fill_in_middle(df.filter("false")).count() == 0
    kept = infill.transformed_texts(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((i, t if t is None else plainly(i, t)[5]) for i, t in ODD), key=repr)
    assert all(r.n == r.form == r.h1 == r.c0 == "mine" for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    cur = con.execute(INFILL_SQL)
    names = [x[0] for x in cur.description]
    df = op12_infill(spark, f"/root/testdata/{sf}")
    assert names == df.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(cur.fetchall())
    forms = {r[2] for r in got}
    assert forms == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <PSM>é\n", max_size=40), st.integers(1, 9), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_pieces_of_long_texts(text, piece, h):
    """Texts matched in pieces have the units of one match, and every output leads back to its text."""
    whole, want = infill.PIECE, infill.transform(text, h, 100, 50)
    infill.PIECE = piece
    try:
        assert infill.transform(text, h, 100, 50) == want
    finally:
        infill.PIECE = whole
    n, form, a, b, out = want
    if form != "plain":
        parts = re.split("<[PSM]>", out)
        assert len(parts) == 4 and text == (parts[1] + parts[3] + parts[2] if form == "psm" else parts[2] + parts[3] + parts[1])


def test_a_text_of_many_pieces(monkeypatch):
    text = "word, " * 900_000
    assert len(infill.borders(text)) == 2_700_000
