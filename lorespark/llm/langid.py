"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths pass over them, each filter's maximum over a fixed-length window goes to a
softmax over languages. The network is trained here, in numpy, on windows of labelled texts. A text of any length is
cut into windows that overlap by the widest filter; its prediction is the mean of the windows' log-probabilities.

A filter of width 2 sees 65,536 different inputs, so its values are tabulated once and looked up; wider filters are sums
of such tables. That is the same arithmetic as the convolution, without multiplying at each position.

Every language that labelled rows have is learnt. Training sees a bounded sample of rows: of each language the first by a
hash of id and text, Settings.per_language of them, or fewer with many languages, so that all languages together have
most_texts (each has one at least). Of a sampled text up to windows_per_text windows, spread over it, are learnt from.
Prediction runs in the tasks, over whole texts; only the sample's windows and the counts by language reach the driver.

Defined cases: null text or one without letters: `und`, score 0; null language: not learnt from; one language learnt:
predicted for every text with letters; none learnt: `und`. Ties between languages go to the first by name. Equal texts
get equal answers. Further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import slices, texts


@dataclass(frozen=True)
class Settings:
    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    per_language: int = 1500
    windows_per_text: int = 4
    most_texts: int = 20_000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


@dataclass
class Network:
    languages: list[str]
    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        w = self.weights = {"e": rng.normal(0, 0.5, (256, s.embedding)).astype(np.float32)}
        for k in s.widths:
            w[f"f{k}"] = rng.normal(0, 1 / np.sqrt(k * s.embedding), (k * s.embedding, s.filters)).astype(np.float32)
            w[f"b{k}"] = np.zeros(s.filters, dtype=np.float32)
        w["o"] = rng.normal(0, 0.2, (len(s.widths) * s.filters, len(self.languages))).astype(np.float32)
        w["c"] = np.zeros(len(self.languages), dtype=np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross-entropy of windows (n, window) with languages (n)."""
        s, w, rng = self.settings, self.weights, np.random.default_rng(self.settings.seed + 1)
        mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), s.batch):
                pick = order[at : at + s.batch]
                x, y = windows[pick], labels[pick]
                n = len(x)
                seen = w["e"][x]
                pooled, kept = [], {}
                for k in s.widths:
                    wide = np.lib.stride_tricks.sliding_window_view(seen, k, axis=1).transpose(0, 1, 3, 2).reshape(n, s.window - k + 1, -1)
                    out = wide @ w[f"f{k}"]
                    best = out.argmax(axis=1)
                    top = np.take_along_axis(out, best[:, None], axis=1)[:, 0] + w[f"b{k}"]
                    kept[k] = wide, best, top > 0
                    pooled.append(np.maximum(top, 0))
                h = np.concatenate(pooled, axis=1)
                z = h @ w["o"] + w["c"]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y] -= 1
                p /= n
                grads = {"o": h.T @ p, "c": p.sum(axis=0), "e": np.zeros_like(w["e"])}
                back = p @ w["o"].T
                for j, k in enumerate(s.widths):
                    wide, best, on = kept[k]
                    d = back[:, j * s.filters : (j + 1) * s.filters] * on
                    rows = np.take_along_axis(wide, best[:, :, None], axis=1)  # (n, filters, k * embedding)
                    grads[f"f{k}"] = np.einsum("nf,nfi->if", d, rows)
                    grads[f"b{k}"] = d.sum(axis=0)
                    into = (d[:, :, None] * w[f"f{k}"].T[None]).reshape(n, s.filters, k, s.embedding)
                    at_bytes = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(k)]
                    np.add.at(grads["e"], at_bytes.ravel(), into.reshape(-1, s.embedding))
                step += 1
                for name, g in grads.items():
                    mean[name] += 0.1 * (g - mean[name])
                    square[name] += 0.001 * (g * g - square[name])
                    w[name] -= s.rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables of two or one bytes whose sum is the filters' value."""
        w, d = self.weights, self.settings.embedding
        out = []
        for k in self.settings.widths:
            one = [w["e"] @ w[f"f{k}"][j * d : (j + 1) * d] for j in range(k)]
            one[0] = one[0] + w[f"b{k}"]
            two = [(one[j][:, None] + one[j + 1][None]).reshape(65536, -1) for j in range(0, k - 1, 2)]
            out.append(two + [one[-1]] * (k % 2))
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """For each window (n, window), of the languages."""
        s, n = self.settings, len(windows)
        columns = np.ascontiguousarray(windows.T).astype(np.int64)
        pairs = columns[:-1] * 256 + columns[1:]
        pooled = []
        for k, parts in zip(s.widths, tables, strict=True):
            best = np.zeros((n, s.filters), dtype=np.float32)
            value, more = np.empty_like(best), np.empty_like(best)
            for at in range(s.window - k + 1):
                parts[0].take(pairs[at], axis=0, out=value, mode="clip")
                for j, part in enumerate(parts[1:], 1):
                    part.take(pairs[at + 2 * j] if len(part) > 256 else columns[at + 2 * j], axis=0, out=more, mode="clip")
                    value += more
                np.maximum(best, value, out=best)
            pooled.append(best)
        z = np.concatenate(pooled, axis=1) @ self.weights["o"] + self.weights["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut(text: bytes, window: int, overlap: int) -> tuple[np.ndarray, int]:
    """All windows of a text; the last is filled with spaces. At least one."""
    step = window - overlap
    n = max(1, -(-(len(text) - overlap) // step))
    size = (n - 1) * step + window
    b = np.frombuffer(text + b" " * (size - len(text)), dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(b, window)[::step], n


def _spread(text: bytes, s: Settings) -> list[bytes]:
    """Up to windows_per_text windows, spread over the text, to learn from."""
    rows, n = cut(text, s.window, max(s.widths) - 1)
    return [rows[k].tobytes() for k in sorted({round(j * (n - 1) / max(1, s.windows_per_text - 1)) for j in range(min(n, s.windows_per_text))})]


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Network:
    """A network trained on a bounded sample of the rows where learn is true and the language is not null."""
    s = settings
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn"))
    rows = rows.filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    network = Network(sorted(r["lang"] for r in counts), s)
    if len(counts) < 2:
        return network
    most = max(1, min(s.per_language, s.most_texts // len(counts)))
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2.0 * most + 30) / r["count"])))))
    place = F.xxhash64(F.coalesce("id", F.lit("")), "text")
    # about twice what is wanted; then exactly that, cut in each task before rows move
    near = rows.withColumn("place", F.pmod(place, F.lit(1 << 30))).filter(F.col("place") < F.element_at(share, F.col("lang")) * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    picked = near.withColumn("nth", nth).filter(F.col("nth") <= most).select("lang", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [(lang, w) for lang, t in zip(batch.column("lang").to_pylist(), texts(batch), strict=True) for w in _spread(t, s)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())], ["lang", "w"])

    # windows_per_text windows at most of most_texts texts, or of one of each language
    found = picked.mapInArrow(windows, "lang string, w binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["w"])))
    at = {lang: k for k, lang in enumerate(network.languages)}
    network.start()
    network.train(np.frombuffer(b"".join(bytes(r["w"]) for r in found), dtype=np.uint8).reshape(-1, s.window), np.array([at[r["lang"]] for r in found]))
    return network


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the probability given to that language) of each row's whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    s = network.settings
    overlap = max(s.widths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network.weights else []
        names = np.array([*network.languages, "und"], dtype=object)
        for batch in slices(batches):
            known = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), dtype=bool)
            pred, score = np.full(len(known), len(names) - 1), np.zeros(len(known))
            at = np.flatnonzero(known)
            if len(names) == 2:
                pred[at], score[at] = 0, 1.0
            elif len(names) > 2 and len(at):
                t = texts(batch)
                pieces = [cut(t[k], s.window, overlap) for k in at]
                rows_at = np.concatenate([[0], np.cumsum([n for _, n in pieces])])
                whole = np.concatenate([w for w, _ in pieces])
                logs = np.concatenate([network.log_probabilities(whole[k : k + 2048], tables) for k in range(0, len(whole), 2048)]).astype(np.float64)
                mean = np.add.reduceat(logs, rows_at[:-1], axis=0) / np.diff(rows_at)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                pred[at], score[at] = p.argmax(axis=1), p.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
