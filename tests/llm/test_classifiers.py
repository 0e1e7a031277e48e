import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorespark.llm import langid, mixing, quality_model, quality_rules
from lorespark.llm.common import held_out, written
from lorespark.llm.queries import MIX, op5_langid, op7_quality_rules, op9_quality_model

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c a b c"), (6, "x\xa0y z # $%"), (7, "l\nl\n \nl"), (8, "1234 !!"), (9, "long " * 60_000), (9, "long " * 3), (None, "ab cd ef gh")]


def odd(spark, **more):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("words", "letters", "score", "kept", "f", "__features"):
        df = df.withColumn(name, F.lit(name))
    return df.withColumns(more) if more else df


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_base(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    want = {r["doc_id"]: base(r["text"]) for r in rows}
    out = op7_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(rows)
    for r in out:
        n = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)


def test_rules_odd_texts(spark):
    out = quality_rules.quality_rules(odd(spark)).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted((i or 0, *base(t)) for i, t in ODD)
    assert all(0 <= r.p_good <= 1 for r in out)
    assert quality_rules.quality_rules(odd(spark).filter("false")).count() == 0


def test_posteriors_equal_plain_expectation_maximisation(spark):
    """Each text by itself, in plain Python: what a vote tells of a text, and how often texts are good, by turns."""
    rows = quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    names = [f"vote_{n}" for n, _ in quality_rules.rules()]
    votes = [[r[n] for n in names] for r in rows]
    good = []
    for v in votes:
        yes, no = v.count(1), v.count(0)
        share = (yes + 1) / (yes + no + 2)
        good.append(max(share, 0.9) if yes > 2 * no else min(share, 0.3))
    prior = 0.5
    for _ in range(200):
        before, prior = prior, (sum(good) + 1) / (len(good) + 2)
        tells = []
        for k in range(len(names)):
            seen = {(y, x): 0.5 for y in (0, 1) for x in (-1, 0, 1)}
            for v, p in zip(votes, good):
                seen[1, v[k]] += p
                seen[0, v[k]] += 1 - p
            tells.append({(y, x): n / sum(seen[y, z] for z in (-1, 0, 1)) for (y, x), n in seen.items()})
        good = []
        for v in votes:
            one, other = prior, 1 - prior
            for t, x in zip(tells, v):
                one, other = one * t[1, x], other * t[0, x]
            good.append(one / (one + other))
        if abs(prior - before) < 1e-9:
            break
    # the last step sets the odds with the prior and what votes tell that its good texts led to
    assert [r.p_good for r in rows] == pytest.approx(good, abs=1e-6)
    assert [r.kept for r in rows] == [not r.base_failed and r.p_good >= 0.5 for r in rows]
    assert 0.5 < sum(r.kept for r in rows) / len(rows) < 1 and min(r.p_good for r in rows) < 0.1


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.6, 0.85]
    votes = [tuple(int(g if rng.random() < p else not g) if rng.random() < 0.7 else -1 for p in right) for g in good]
    prior, table = quality_rules.fit(sorted(Counter(votes).items()), 4)
    assert prior == pytest.approx(0.8, abs=0.04)
    for k, p in enumerate(right):
        assert table[k, 1, 2] / (table[k, 1, 1] + table[k, 1, 2]) == pytest.approx(p, abs=0.04)


def test_rules_keep_clean_texts(spark):
    out = op7_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]


def test_langid(spark):
    out = op5_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    rows = out.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_langid_odd_texts(spark):
    few = langid.Settings(per_language=50, epochs=1)
    train = spark.createDataFrame([(k, t * 20, la) for k in range(30) for t, la in (("the and of ", "en"), ("der und die ", "de"))] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    network = langid.train(train, ~held_out("doc_id", 4), settings=few)
    out = langid.predict(odd(spark), network).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert 0 <= r.score <= 1
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3, 8}
    one = langid.train(train.filter("lang = 'en'"), F.lit(True), settings=few)
    assert {r.lang_pred for r in langid.predict(odd(spark), one).collect()} == {"en", "und"}
    none = langid.train(train.filter("false"), F.lit(True), settings=few)
    assert {r.lang_pred for r in langid.predict(odd(spark), none).collect()} == {"und"}
    assert langid.predict(odd(spark).filter("false"), network).count() == 0


def test_tables_give_the_convolution():
    s = langid.Settings(window=32, filters=5)
    net = langid.Network(["a", "b", "c"], s)
    net.start()
    x = np.random.default_rng(1).integers(0, 256, (7, 32)).astype(np.uint8)
    w, pooled = net.weights, []
    for k in s.widths:
        seen = np.lib.stride_tricks.sliding_window_view(w["e"][x], k, axis=1).transpose(0, 1, 3, 2).reshape(7, 32 - k + 1, -1)
        pooled.append(np.maximum(seen @ w[f"f{k}"] + w[f"b{k}"], 0).max(axis=1))
    z = np.concatenate(pooled, axis=1) @ w["o"] + w["c"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-3)


def test_quality_model(spark):
    out = op9_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum((r.quality == 1) == (r.predicted == 1) for r in out) >= 0.95 * len(out)


def counted(t):
    """The features of a text, one by one."""
    t = t or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    pieces, lines = re.split(r"[\x20\x09-\x0D]+", t), t.split("\n")
    n, c = max(len(words), 1), max(len(t), 1)
    upper, digits = sum(unicodedata.category(x) == "Lu" for x in t), sum(x in "0123456789" for x in t)
    symbols, bangs = sum(x in "#*$%&|<>{}=@_~^" for x in t), sum(x in "!?" for x in t)
    enders = len(re.findall(r"[.!?](?:[ \t\n\x0b\f\r]|$)", t))
    distinct = len(set(pieces))
    return [len(words), len(t) / n, upper / c, digits / c, symbols / n, bangs / n, enders / n, len(words) / len(lines), distinct / n, distinct / n**0.5, 1 - len(set(lines)) / len(lines)]


def test_quality_scores_against_brute_force(spark):
    """Features, rules and their weights, computed text by text, give the scores of the query."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels, learn=~held_out("doc_id", 4))
    assert 0 < len(model.rules) <= 40
    got = {r.doc_id: r.score for r in op9_quality_model(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        f = dict(zip(quality_model.FEATURES, counted(r.text), strict=True))
        z = model.bias + sum(w for rule, w in model.rules if all(f[x] <= cut if side == "<=" else f[x] > cut for x, side, cut in rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), r.doc_id


def test_languages_against_the_plain_network(spark):
    """Predictions of whole texts, window by window and filter by filter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs, ~held_out("doc_id", 4), settings=langid.Settings(epochs=1, per_language=40))
    s, w = net.settings, net.weights
    got = {r.doc_id: r for r in langid.predict(docs.filter("doc_id % 25 = 0"), net).collect()}
    for r in docs.filter("doc_id % 25 = 0").collect():
        if not any(x.isalpha() for x in r.text or ""):
            continue
        t, step, logs, at = r.text.encode(), s.window - max(s.widths) + 1, [], 0
        while True:
            x = np.frombuffer(t[at : at + s.window].ljust(s.window), dtype=np.uint8)
            pooled = []
            for k in s.widths:
                values = np.array([w["e"][x[i : i + k]].ravel() @ w[f"f{k}"] + w[f"b{k}"] for i in range(s.window - k + 1)])
                pooled.append(np.maximum(values.max(axis=0), 0))
            z = np.concatenate(pooled) @ w["o"] + w["c"]
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
            at += step
            if at + max(s.widths) - 1 >= len(t):
                break
        mean = np.mean(logs, axis=0)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[r.doc_id].lang_pred == net.languages[int(p.argmax())] and got[r.doc_id].score == pytest.approx(p.max(), abs=1e-3)


def test_every_language_is_learnt(spark):
    """300 languages: each has its place, and the sample its bound; rows of one id do not come in together."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9, f"l{k:03}") for k in range(300)] + [(7, f"text {k}", "l007") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, F.lit(True), settings=langid.Settings(epochs=1, most_texts=300))
    assert len(net.languages) == 300
    assert langid.predict(docs.limit(5), net).count() == 5


def test_quality_model_odd_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(k, ("word " * 80 if k % 2 else "##$$ " * 80) + str(rng.integers(9)), k % 2) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(1, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, labels, F.lit(True))
    assert model.rules
    out = quality_model.score(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    rows = odd(spark).withColumns({"__features": F.lit(1), "_features": F.lit("mine"), "f": F.lit(2)})
    kept = quality_model.keep(rows, model, 0.0)
    assert kept.columns == rows.columns and kept.filter("_features = 'mine'").count() == len(ODD)
    none = quality_model.train(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in quality_model.score(odd(spark), none).collect()} == {0.5}
    assert quality_model.score(odd(spark).filter("false"), model).count() == 0


@pytest.mark.parametrize("table", [False, True])
def test_mixing_reaches_targets(spark, table):
    """Marginals of the raked masses are the targets, given as weights or as a table."""
    rows = mixing.described(spark.read.parquet(f"{SF}/documents.parquet"))
    cells = written(rows.groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    lang = {"en": 2.0, "de": 1.0, "fr": 1.0, "es": 1.0, "nowhere": 7.0}
    topic = {"code": 0.2}  # the others keep their shares
    own = {d: {r[0]: r[1] for r in rows.groupBy(d).agg(F.sum("tokens")).collect()} for d in mixing.DIMENSIONS}
    total = sum(own["lang"].values())
    given = {"source": 0.5, "lang": lang, "topic": topic}
    if table:
        given["lang"] = spark.createDataFrame([*lang.items(), (None, 3.0)], "lang string, target double")
    raked = {d: {} for d in own}
    for r in mixing.rake(cells, given).collect():
        for d in own:
            raked[d][r[d]] = raked[d].get(r[d], 0) + r.raked
    assert raked["lang"] == pytest.approx({"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, abs=1e-5)
    rest = sum(v for k, v in own["topic"].items() if k != "code") / total
    assert raked["topic"] == pytest.approx({k: (1 - rest if k == "code" else v / total) for k, v in own["topic"].items()}, abs=1e-5)
    roots = {k: (v / total) ** 0.5 for k, v in own["source"].items()}
    assert raked["source"] == pytest.approx({k: v / sum(roots.values()) for k, v in roots.items()}, abs=1e-5)


def test_mixing_keeps_by_rate(spark):
    out = mixing.mixing_rates(spark.read.parquet(f"{SF}/documents.parquet"), MIX).agg(F.max("rate"), F.count("*"), F.sum("rate"), F.count_if("kept")).first()
    assert out[0] == pytest.approx(1) and out[1] == 1000 and abs(out[3] - out[2]) < 70


def test_mixing_says_when_targets_contradict(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="targets don't fit"):
        assert mixing.rake(cells, {"source": {"a": 1.0, "b": 3.0}, "lang": {"en": 1.0, "de": 1.0}}).count() == 2
    out = {r.source: r.raked for r in mixing.rake(cells, {"source": {"a": 0.0, "b": 1.0}}).collect()}
    assert out == {"a": 0.0, "b": pytest.approx(1.0)}


def test_mixing_odd_rows(spark):
    rows = [(k, "some words here", "a" if k % 3 else None, "en") for k in range(30)] + [(None, None, None, None), (5, "", "b", None), (5, "", "b", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, topic string")
    out = mixing.mixing_rates(df, MIX).collect()
    assert len(out) == len(rows) and all(0 < r.rate <= 1 for r in out)
    kept = mixing.sample(df, MIX)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in out)
    by_column = {r.topic for r in mixing.mixing_rates(df, MIX, topic_col="topic").collect()}
    assert by_column == {"x"}
    clash = df.withColumns({"_cell": F.lit(1), "__CELL": F.lit("y"), "_rate": F.lit(None), "tokens": F.lit(3)})
    assert mixing.sample(clash, MIX).columns == clash.columns and mixing.sample(clash, MIX).count() == kept.count()
    assert mixing.mixing_rates(df.filter("false"), MIX).count() == 0 and mixing.sample(df.filter("false"), MIX).count() == 0
