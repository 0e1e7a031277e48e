"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees propose conjunctions of threshold tests (each path from the root is a rule); a logistic model with
an L1 penalty keeps a few of them with weights; the kept rules become one Spark column expression, so scoring runs inside
the JVM without any model object on the executors.

The statistics are Spark column expressions over the whole text. Fitting uses a bounded sample of labelled rows: the
`sample` ids that come first by a hash of the id, from all labelled rows.

Defined cases: a null text counts as empty; an empty text has a score like any other; rows with a null label are not
learnt from; if an id has several labels the smallest counts; with no labels, or only one class, every score is that
class's share (0.5 without labels). Equal texts get equal scores. Further input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import WORD, release, unused


def statistics(text: Column) -> dict[str, Column]:
    """Counts of a text; none grows with anything but the text."""
    t = F.coalesce(text, F.lit(""))
    return {
        "chars": F.length(t),
        "words": F.regexp_count(t, F.lit(WORD)),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "digits": F.regexp_count(t, F.lit("[0-9]")),
        "symbols": F.regexp_count(t, F.lit("[#*$%&|<>{}=@_~^]")),
        "bangs": F.regexp_count(t, F.lit("[!?]")),
        "enders": F.regexp_count(t, F.lit(r"[.!?](?:\s|$)")),
        "lines": F.regexp_count(t, F.lit(r"\n")) + 1,
        "distinct": F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+"))),
        "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))),
    }


def ratios(s: Column) -> dict[str, Column]:
    """The features of the rules, from a struct of statistics()."""
    c = s.getField
    words, chars = F.greatest(c("words"), F.lit(1)), F.greatest(c("chars"), F.lit(1))
    return {
        "words": c("words").cast("double"),
        "word_length": c("chars") / words,
        "upper_share": c("upper") / chars,
        "digit_share": c("digits") / chars,
        "symbol_share": c("symbols") / words,
        "bang_share": c("bangs") / words,
        "ender_share": c("enders") / words,
        "line_words": c("words") / c("lines"),
        "distinct_share": c("distinct") / words,
        "distinct_root": c("distinct") / F.sqrt(words),
        "dup_line_share": 1 - c("distinct_lines") / c("lines"),
    }


FEATURES = ("words", "word_length", "upper_share", "digit_share", "symbol_share", "bang_share", "ender_share", "line_words", "distinct_share", "distinct_root", "dup_line_share")
Rule = tuple[tuple[str, str, float], ...]


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, f: Column) -> Column:
        """Probability of label 1, from a struct of ratios()."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            test = F.lit(True)
            for feature, side, cut in rule:
                test = test & (f.getField(feature) <= cut if side == "<=" else f.getField(feature) > cut)
            z = z + F.when(test, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rng: np.random.Generator, path: Rule, least: int) -> tuple[list[Rule], list[tuple[np.ndarray, float]]]:
    """Paths of a tree on binned features x, and each leaf's rows and value."""
    leaf = [(rows, float(residual[rows].sum() / (hess[rows].sum() + 1)))]
    if depth == 0 or len(rows) < 2 * least:
        return ([path] if path else []), leaf
    g0, h0 = residual[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, -1)
    for f in rng.choice(len(cuts), size=max(1, round(0.7 * len(cuts))), replace=False):
        n = len(cuts[f]) + 1
        if n < 2:
            continue
        b = x[rows, f]
        g, h, c = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (residual[rows], hess[rows], None))
        gain = np.where((c >= least) & (len(rows) - c >= least), g**2 / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0**2 / (h0 + 1), -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), k)
    if best[1] < 0:
        return ([path] if path else []), leaf
    _, f, k = best
    low = x[rows, f] <= k
    rules, leaves = ([path] if path else []), []
    for part, side in ((rows[low], "<="), (rows[~low], ">")):
        r, lv = _tree(x, cuts, residual, hess, part, depth - 1, rng, (*path, (FEATURES[f], side, float(cuts[f][k]))), least)
        rules, leaves = rules + r, leaves + lv
    return rules, leaves


def holds(rule: Rule, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), dtype=bool)
    for feature, side, cut in rule:
        v = values[:, FEATURES.index(feature)]
        out &= v <= cut if side == "<=" else v > cut
    return out


def _lasso(masks: list[np.ndarray], y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Bias and weights of the logistic model with an L1 penalty, by an accelerated proximal gradient."""
    share = float(y.mean())
    # single precision, changed in place: the one large array of a fit
    a = np.empty((len(y), len(masks)), dtype=np.float32)
    for k, m in enumerate(masks):
        a[:, k] = m
    mean = a.mean(axis=0, dtype=float)
    scale = np.sqrt(mean * (1 - mean))
    a -= mean.astype(np.float32)
    a /= scale.astype(np.float32)
    w, b, t = np.zeros(a.shape[1]), np.log(share / (1 - share)), 1.0
    v, c = w.copy(), b
    rate = 4 / (float(np.linalg.eigvalsh((a.T @ a).astype(float)).max()) / len(y) + 1)
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + c))) - y
        new = v - rate * (e.astype(np.float32) @ a) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * e.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    w = w / scale
    return float(b - (w * mean).sum()), w


def fit(values: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 64, penalty: float = 0.004, rounds: int = 400, seed: int = 3) -> RuleModel:
    """values: (rows, FEATURES); labels: 0 or 1. The penalty chooses the rules: all that keep a weight are fitted again under a fourth of it, as a penalty that leaves few rules also shrinks their weights."""
    y = labels.astype(float)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 20:
        p = min(max((y.sum() + 0.5) / (len(y) + 1), 0.001), 0.999)
        return RuleModel(float(np.log(p / (1 - p))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(values.shape[1])]
    x = np.stack([np.searchsorted(cuts[f], values[:, f]) for f in range(values.shape[1])], axis=1)
    z = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        got, leaves = _tree(x, cuts, y - p, p * (1 - p), rows, depth, rng, (), max(5, len(y) // 500))
        rules.update(dict.fromkeys(got))
        for feature_rows, value in leaves:
            z[feature_rows] += 0.3 * value
    kept = [(r, m) for r in rules if 0.002 < (m := holds(r, values)).mean() < 0.998]
    if not kept:
        return RuleModel(float(np.log(share / (1 - share))), [])
    _, w = _lasso([m for _, m in kept], y, penalty, rounds)
    kept = [x for x, weight in zip(kept, w, strict=True) if weight]
    if not kept:
        return RuleModel(float(np.log(share / (1 - share))), [])
    bias, w = _lasso([m for _, m in kept], y, penalty / 4, rounds)
    return RuleModel(bias, [(r, float(x)) for (r, _), x in zip(kept, w, strict=True) if x])


def with_features(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with a struct of the features of each row's whole text."""
    counted = docs.withColumn(into, F.struct(*(c.alias(k) for k, c in statistics(F.col(text_col).cast("string")).items())))
    return counted.withColumn(into, F.struct(*(c.alias(k) for k, c in ratios(F.col(into)).items())))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> RuleModel:
    """A model fitted on at most `sample` labelled ids where learn (a column over doc_id) is true."""
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    # `sample` rows at most, so they may be broadcast
    chosen = F.broadcast(chosen.filter(learn).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    found = with_features(rows, "text", "f").select("doc_id", "y", *(F.col("f").getField(k).alias(k) for k in FEATURES))
    # ids that repeat among docs count once
    found = found.groupBy("doc_id").agg(F.min(F.struct("y", *FEATURES)).alias("r")).select("r.*").toPandas().to_numpy(dtype=float)
    found = found[np.lexsort(found.T[::-1])]
    model = fit(found[:, 1:], (found[:, 0] >= 1).astype(int))
    release()
    return model


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row's whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_features(rows, "text", "f").select("doc_id", model.score(F.col("f")).alias("score"))


def keep(docs: DataFrame, model: RuleModel, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whatever their names, whose score reaches `least`."""
    into, scored, part = unused(docs, "features", "score", "part")
    rows = with_features(docs, text_col, into).withColumns({scored: model.score(F.col(into)), part: F.spark_partition_id()})
    # a filter on the score alone would be moved below the features and compute them anew for each rule; not past this column
    return rows.filter((F.col(scored) >= least) & (F.col(part) >= 0)).drop(into, scored, part)
