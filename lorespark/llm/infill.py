"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders, and put together in another order.

A unit is a run of ASCII letters, or any other single character. One `fullmatch` of `(unit)*` by the regex library keeps
every repetition of its group, so `ends(1)` gives the number of units and the offset of each border at once; there is no
loop over units. A match needs about 70 bytes a character: a text of more than PIECE characters is matched in pieces that end
behind a character that is no letter, where a unit ends in any case, so units stay the same and memory is bounded.

What is random comes from sha256 of `<seed>:<id>`, read as four 32-bit numbers h1 to h4: cuts come after h1 and h2 modulo
(units + 1) units; h3 modulo 100 decides whether a text is taken at all, h4 modulo 100 between the two orders. Repeated runs
give the same rows whatever the partitions.

Forms: `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is `<S>`suffix`<P>`prefix`<M>`middle, `plain` the text as it is. A
text that has a marker in it stays plain, so the three markers of an output are found by a split, and restored() gives the
text back exactly.

Defined cases: a null text is empty, and empty texts are plain with no units; a null id counts as an empty one; rows with
equal ids get equal numbers, equal rows equal results; an empty table gives no rows; further columns are ignored by
fill_in_middle, and kept by transformed_texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import id_and_text, release, slices

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters that one match covers, but for a longer run of letters.
PIECE = 1 << 20

_UNITS = regex.compile(f"({UNIT})*")
_OTHER = regex.compile("[^A-Za-z]")
_MARK = regex.compile("<[PSM]>")


def borders(text: str) -> np.ndarray:
    """The end of each unit, in code points."""
    if len(text) <= PIECE:
        return np.array(_UNITS.fullmatch(text).ends(1), dtype=np.int64)
    out, at = [], 0
    while at < len(text):
        other = _OTHER.search(text, at + PIECE - 1)
        to = other.end() if other else len(text)
        out.append(np.array(_UNITS.fullmatch(text, at, to).ends(1), dtype=np.int64))
        at = to
    return np.concatenate(out)


def transform(text: str, h: tuple[int, int, int, int], taken: int, swapped: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, length of prefix and of middle, output."""
    ends = borders(text)
    n = len(ends)
    if not n or h[2] % 100 >= taken or _MARK.search(text):
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    before, within, after = text[:a], text[a:b], text[b:]
    if h[3] % 100 < swapped:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{within}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{within}"


def numbers(id_col: str, seed: int = 1) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _run(taken: int, swapped: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = zip(*(batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)), strict=True)
            rows = [transform(t or "", x, taken, swapped) for t, x in zip(batch.column("text").to_pylist(), h, strict=True)]
            n, form, a, b, out = zip(*rows, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        release()

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, taken: int = 90, swapped: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null where plain) and output of each row. taken: percent of the texts that are transformed; swapped: percent of these that are spm."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", "text", *numbers("doc_id", seed))
    return rows.mapInArrow(_run(taken, swapped), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(F.col(output), "<[PSM]>")
    return (
        F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col(output))
    )


def transformed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, taken: int = 90, swapped: int = 20) -> DataFrame:
    """The rows of docs, all columns, with the output in place of the text; a null text stays null."""
    at = [f"c{k}" for k in range(len(docs.columns))]
    held = docs.toDF(*at)
    key, body = at[docs.columns.index(id_col)], at[docs.columns.index(text_col)]
    numbered = held.withColumns({"h": F.array(*numbers(key, seed))})
    others = [c for c in at if c != body]
    schema = T.StructType([*(held.schema[c] for c in others), T.StructField(body, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            hs = batch.column("h").to_pylist()
            out = [None if t is None else transform(t, tuple(x), taken, swapped)[4] for t, x in zip(batch.column(body).to_pylist(), hs, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(out, pa.string())], [*others, body])
        release()

    made = numbered.withColumn(body, F.col(body).cast("string")).mapInArrow(run, schema)
    return made.select(*(F.col(c).alias(name) for c, name in zip(at, docs.columns, strict=True)))
