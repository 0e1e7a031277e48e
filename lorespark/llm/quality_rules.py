"""Quality rules as weak supervision.

Each rule looks at a few statistics of a text and votes good or bad, or abstains. Expectation-maximisation over the
counts of vote patterns estimates how the rules vote on good and on bad texts, without labels. A text is kept if the
posterior probability that it is good reaches a threshold and the base rules do not fail it.

Only counts of patterns reach the driver: at most 3 to the power of the number of rules, whatever the input.

Defined cases: a null text has no words, lines or symbols; a text without words is base_failed; texts of any length are
counted whole; equal texts get equal verdicts; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import WordHashes, id_and_text, rolling, slices, texts, written

STATISTICS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_letters long, n_short long, n_enders long, n_marks long, n_distinct long"
)
SYMBOLS = b"#*$%&|<>"


def repeated_words(h: np.ndarray, n: int = 3) -> int:
    """Words inside windows of n that are found twice or more."""
    w = rolling(h, n)
    if len(w) < 2:
        return 0
    ordered = np.sort(w)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, np.unique(twice)))
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts named in STATISTICS for each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kinds = np.zeros((256, 5), dtype=bool)  # symbol, first byte of a character, letter, white space, mark
        kinds[list(SYMBOLS), 0] = True
        kinds[:, 1] = True
        kinds[0x80:0xC0, 1] = False
        kinds[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE0)], 2] = True
        kinds[[32, *range(9, 14)], 3] = True
        kinds[list(b"!?#*$%&|<>{}[]=+~^@\\/_"), 4] = True
        for batch in slices(batches):
            out = []
            for t in texts(batch):
                words = t.split()
                n = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
                symbols, first, letters, space, marks = (int(n[kinds[:, k]].sum()) for k in range(5))
                h = hashes(words)
                # upper case in the two-byte Latin range has the second byte 0x80-0x9E after 0xC3
                upper = int(n[65:91].sum())
                if n[0xC3]:
                    b = np.frombuffer(t, dtype=np.uint8)
                    upper += int(((b[:-1] == 0xC3) & (b[1:] < 0x9F)).sum())
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                enders = t.count(b". ") + t.count(b".\n") + t.count(b"? ") + t.count(b"! ") + t.endswith((b".", b"!", b"?"))
                out.append((len(words), first - space, symbols, duplicate_lines(t), repeated_words(h), t.count(b"\n") + 1, upper, letters, int((sizes <= 3).sum()), enders, marks, len(np.unique(h))))
            columns = np.array(out, dtype=np.int64).reshape(-1, 12).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], [x.split()[0] for x in STATISTICS.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, STATISTICS)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))




def rules() -> list[tuple[str, Column]]:
    """Each rule's vote: 1 good, 0 bad, -1 none."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    repeats, dup = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    length, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    upper, short = _share("n_upper", "n_letters"), _share("n_short", "n_words")
    enders, marks, distinct = _share("n_enders", "n_words"), _share("n_marks", "word_chars"), _share("n_distinct", "n_words")
    long_text = F.col("n_words") >= 200
    return [
        ("repeats", vote(repeats > 0.4, repeats < 0.15)),
        ("lines", vote(dup > 0.3, (dup < 0.05) & (F.col("n_lines") > 3))),
        ("word_length", vote((length < 3) | (length > 7), length.between(4, 6.5))),
        ("symbols", vote(symbols > 0.1, symbols < 0.02)),
        ("upper_case", vote(upper > 0.3, upper < 0.1)),
        ("short_words", vote(short < 0.12, short > 0.25)),
        ("sentences", vote(enders < 0.005, enders.between(0.02, 0.3))),
        ("marks", vote(marks > 0.08, marks < 0.01)),
        ("variety", vote((distinct < 0.2) & ~long_text | (distinct < 0.05), distinct.between(0.3, 0.95))),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray]:
    """Share of good texts, and P(vote | bad or good) of each rule, shape (rules, 2, 3) for votes -1, 0, 1.

    Starts from the majority of votes; a small count for each vote keeps probabilities above zero.
    """
    votes = np.array([p for p, _ in patterns], dtype=np.int64).reshape(-1, n_rules)
    weight = np.array([n for _, n in patterns], dtype=float)
    good, bad = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    post = (good + 1) / (good + bad + 2) if len(votes) else np.empty(0)
    post = np.where(good > 2 * bad, np.maximum(post, 0.9), np.minimum(post, 0.3))
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior, table = 0.5, np.full((n_rules, 2, 3), 1 / 3)
    for _ in range(rounds):
        before = prior
        prior = float(((weight * post).sum() + 1) / (weight.sum() + 2))
        for y, p in ((0, 1 - post), (1, post)):
            counts = np.einsum("i,ijv->jv", weight * p, seen) + 0.5
            table[:, y] = counts / counts.sum(axis=1, keepdims=True)
        logs = np.einsum("ijv,jyv->iy", seen, np.log(table)) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if abs(prior - before) < tolerance:
            break
    return prior, table


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """STATISTICS, one vote_<rule> for each rule, p_good (posterior that the text is good), base_failed and kept."""
    votes = rules()
    found = written(statistics(docs, id_col, text_col)).withColumns({f"vote_{name}": vote for name, vote in votes})
    names = [f"vote_{name}" for name, _ in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in found.groupBy(*names).count().collect()]  # at most 3 ** rules rows
    prior, table = fit(patterns, len(votes))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for k, name in enumerate(names):
        part = F.lit(float(np.log(table[k, 1, 0] / table[k, 0, 0])))
        for v in (0, 1):
            part = F.when(F.col(name) == v, float(np.log(table[k, 1, v + 1] / table[k, 0, v + 1]))).otherwise(part)
        odds = odds + part
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = found.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
