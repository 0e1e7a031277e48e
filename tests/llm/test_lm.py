import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.llm import lm
from lorespark.llm.common import held_out

ROWS = [(k, t) for k, t in enumerate(["the cat sat on the mat", "The cat ate", None, "", "a\xa0b c", "the dog sat on the mat " * 40, "zzz yyy", "É é ABC", "the cat sat on the mat"] * 6)]


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), ""]


def learnt(k):
    return zlib.crc32(str(k).encode()) % 7 != 2


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    mass = 3.0
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("bucket", F.lit("x"))
    out = {r.doc_id: r for r in lm.score(df, ~held_out("doc_id", 7), order=order, mass=mass).collect()}
    assert len(out) == len(ROWS)
    count = [Counter() for _ in range(order + 1)]
    for k, t in ROWS:
        if learnt(k):
            w = words(t)
            for n in range(1, order + 1):
                count[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, distinct = sum(count[1].values()), len(count[1])

    def p(context, w):
        if not context:
            return (count[1][w,] + 1) / (total + distinct + 1)
        return (count[len(context) + 1][*context, w] + mass * p(context[1:], w)) / (count[len(context)][context] + mass)

    for k, t in ROWS:
        w, r = words(t), out[k]
        assert (r.learn, r.n_tokens, r.train_tokens) == (learnt(k), len(w), total)
        assert r.n_known == sum(count[1][x,] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10(p((), x)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w)))
    # each state's probabilities sum to 1
    vocab = [g[0] for g in count[1]]
    for context in {g[:-1] for n in range(2, order + 1) for g in count[n]}:
        assert sum(p(context, w) for w in [*vocab, "never seen"]) == pytest.approx(1)


@pytest.mark.parametrize("lane", [1, 3, 50])
def test_lanes_do_not_change_scores(lane, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"text": [r.decode() for r in rows], "learn": [k % 3 > 0 for k in range(40)]})
    levels = lm.counted(iter([batch]), 3)
    automaton = lm.Automaton(levels, int(levels[0][-1].sum()), int((levels[0][-1] > 0).sum()), 2.0)
    token, ends = lm.tokens(rows)
    want = automaton.weights(token, ends)
    monkeypatch.setattr(lm, "LANE", lane)
    assert np.array_equal(automaton.weights(token, ends), want)


def test_better_than_base_on_held_out_texts(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ~held_out("doc_id", 7)).filter("not learn")
    base, score = out.agg(F.sum("base_score"), F.sum("score")).first()
    print("held out, log10 a text:", base / out.count(), score / out.count())
    assert score > base


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, ~held_out("doc_id", 7)).count() == 0
    df = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(df, F.lit(False)).collect()}
    assert out[1].train_tokens == 0 and out[1].n_tokens == 3 and out[1].score == 0 and out[None].n_known == 0


def test_rare_ngrams_are_kept_at_every_size(spark):
    """A bigram that occurs once in 3 million training tokens has its arc."""
    rows = [(k, "filler " * 3000) for k in range(1000)] + [(1000, "rare pair"), (1002, "rare pair")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(df, F.col("doc_id") != 1002, mass=2.0).filter("doc_id >= 1000").collect()}
    n = out[1002].train_tokens
    one = lambda c: (c + 1) / (n + 4 + 1)  # noqa: E731  rare (from the root), pair after rare, end after pair
    assert n > 3_000_000 and out[1002].score == pytest.approx(math.log10(one(1)) + math.log10((1 + 2 * one(1)) / 3) + math.log10((1 + 2 * one(1001)) / 3))
