import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorespark.llm import mixing
from lorespark.llm.queries import MIX
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_substring import brute as brute_substring

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["quality_classifier"](spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    single = stage["ngram_jaccard_join"](spark, clean, SF)
    left = {i for i, lead, _ in brute_classes(rows)[1] if i == lead}
    assert {r.doc_id for r in single.collect()} == left
    unique = stage["substring_dedup"](spark, single, SF)
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    texts = dict(rows)
    want = {i: k if gone else texts[i] for i, _, gone, k in brute_substring(rows)}
    assert {r.doc_id: r.text for r in unique.collect()} == want
    assert all(r.n_chars == len(r.text) for r in unique.collect())
    mixed = stage["mixing"](spark, unique, SF)
    rates = mixing.mixing_rates(unique, MIX)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in rates.filter("kept").collect()}
    assert clean.columns == single.columns == unique.columns == mixed.columns == docs.columns
    coded = stage["bpe"](spark, mixed, SF).collect()
    texts, t = {r.doc_id: r.text for r in mixed.collect()}, Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert len(coded) == len(texts)
    for r in coded:
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


#: Nulls in every column, empty and repeated rows, equal ids, and columns named like the operators' own.
LONG = " ".join(f"w{k}" for k in range(40))
ODD = [
    (1, LONG, "en", "a", 200), (1, LONG, "en", "a", 200), (2, LONG + " more", None, "a", None), (3, None, "en", None, 0), (4, "", "de", "b", 0), (None, LONG, "en", "a", 200),
    (None, None, None, None, None), (None, None, None, None, None), (5, " \t\n", "fr", "b", 3), (6, "x" * 5000, "en", "a", 5000), (7, "one two", "en", "a", 7),
]
CLASHES = ("id", "text_", "bucket", "__id", "__text", "_id", "_hash", "_cell", "_rate", "_features", "c0", "n_words", "kept", "topic", "tokens", "rate", "key", "signature")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_of_each_stage(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in CLASHES})
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "bpe":
        assert len(rows) == len(ODD) and all(r.n_tokens == len(r.ids) for r in rows)
    else:
        assert out.columns == docs.columns and all(r[c] == "mine" for r in rows for c in CLASHES)
        assert len(rows) <= len(ODD)
    if name == "ngram_jaccard_join":
        # copies and near copies leave the smallest id, equal rows of one id stay together, texts without words stay
        assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in rows) == sorted([(1, "w0"), (1, "w0"), (3, ""), (4, ""), (0, ""), (0, ""), (5, " \t"), (6, "xx"), (7, "on")])
    if name == "substring_dedup":
        got = {(r.doc_id, r.text, r.n_chars) for r in rows if r.doc_id in (1, 2, None)}
        assert len(rows) == len(ODD) and got == {(1, LONG, len(LONG)), (2, "more", 4), (None, LONG, len(LONG)), (None, None, None)}
    if name == "quality_classifier":
        # equal texts are judged alike
        assert sum(r.text == LONG for r in rows) in (0, 3)
    empty = stage(spark, docs.filter("false"), SF)
    assert empty.count() == 0
