"""Chunks of documents: fixed token windows, and windows that keep to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import tokens

ISOLATED = ("table_row", "notes", "placeholder", "ocr_text")


def chunk_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """id_col, chunk_idx, start and tokens of overlapping windows. A window begins where the one before did not reach the end."""
    step = max(1, size - overlap)
    rows = docs.select(id_col, tokens(F.col(text_col), lower=False).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - overlap - 1, F.lit(0)), F.lit(step))
    return rows.select(id_col, "all", F.posexplode(starts).alias("chunk_idx", "start")).select(id_col, "chunk_idx", "start", F.slice("all", F.col("start") + 1, size).alias("tokens"))


def segments_to_body(segments: DataFrame) -> DataFrame:
    """relpath and body: segments (relpath, seg_idx, kind, text) with an empty line between, but for neighbouring rows of a kind."""
    before = F.lag("kind").over(Window.partitionBy("relpath").orderBy("seg_idx"))
    close = F.col("kind").isin("table_row", "ocr_text") & (before == F.col("kind"))
    glue = F.when(before.isNull(), "").when(close, "\n").otherwise("\n\n")
    parts = segments.filter("text != ''").withColumn("part", F.concat(glue, F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "part")))
    return parts.groupBy("relpath").agg(F.array_join(F.transform(ordered, lambda x: x.getField("part")), "").alias("body"))


def segment_spans(segments: DataFrame) -> DataFrame:
    """segments with start and end of each text in the body that segments_to_body makes; for texts that normalizing leaves as they are."""
    order = Window.partitionBy("relpath").orderBy("seg_idx")
    before = F.lag("kind").over(order)
    glue = F.when(before.isNull(), 0).when(F.col("kind").isin("table_row", "ocr_text") & (before == F.col("kind")), 1).otherwise(2)
    rows = segments.filter("text != ''").withColumn("glue", glue)
    end = F.sum(F.col("glue") + F.length("text")).over(order).cast("int")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("text")).drop("glue")


def _packed(parts: Column, size: int) -> Column:
    """Texts of the pieces that parts (kind, n, text) make in order: a part that does not fit begins a new piece."""
    none = F.array().cast("array<struct<kind:string,n:int,text:string>>")
    start = F.struct(F.lit(0).alias("used"), none.alias("open"), F.array().cast("array<array<struct<kind:string,n:int,text:string>>>").alias("full"))

    def place(state: Column, part: Column) -> Column:
        used, open_, full = (state.getField(c) for c in ("used", "open", "full"))
        fits = (F.size(open_) == 0) | (used + part.getField("n") <= size)
        return F.struct(
            F.when(fits, used + part.getField("n")).otherwise(part.getField("n")).alias("used"),
            F.when(fits, F.array_append(open_, part)).otherwise(F.array(part)).alias("open"),
            F.when(fits, full).otherwise(F.array_append(full, open_)).alias("full"),
        )

    return F.aggregate(parts, start, place, lambda state: F.array_append(state.getField("full"), state.getField("open")))


def segment_chunks(segments: DataFrame, size: int = 512) -> DataFrame:
    """relpath, chunk_idx, text, section_type, header and heading of the chunks of segments (relpath, seg_idx, kind, text).

    Every chunk opens with its context: the sheet's or slide's header, or the first heading where there is none, and the
    latest heading. Headings and ISOLATED kinds are chunks of their own; neighbouring other segments share one up to `size`
    tokens, and are never cut. header: text of the sheet's or slide's header, which names it; heading: of the latest heading.

    Context comes from windows over the document; a run of neighbours is one array, packed in order.
    """
    order = Window.partitionBy("relpath").orderBy("seg_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_header, is_heading = F.col("kind").isin("sheet_header", "slide_header"), F.col("kind") == "heading"
    single = is_header | is_heading | F.col("kind").isin(*ISOLATED)
    rows = segments.select("relpath", "seg_idx", "kind", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"part": F.sum(is_header.cast("int")).over(order), "header": F.last(F.when(is_header, F.col("text")), True).over(order)})
    within = Window.partitionBy("relpath", "part").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(is_heading, F.col("text"))
    top = F.when(F.col("part") > 0, F.col("header")).otherwise(F.first(heading, True).over(within))
    low = F.when((F.col("part") > 0) | (F.count(heading).over(within) > 1), F.last(heading, True).over(within))
    begins = single | F.coalesce(F.lag(single).over(order), F.lit(True))
    rows = rows.withColumns({"context": F.array(top, low), "heading": F.when(is_heading, F.col("text")).otherwise(F.last(heading, True).over(within)), "single": single, "run": F.sum(begins.cast("int")).over(order)}).filter(~is_header)
    part = F.struct("seg_idx", F.struct("kind", F.greatest(F.size(tokens(F.col("text"), lower=False)), F.lit(1)).alias("n"), "text").alias("p"))
    runs = rows.groupBy("relpath", "run").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.getField("p")).alias("parts"), F.min_by(F.struct("context", "header", "heading"), "seg_idx").alias("at"))
    pieces = runs.select("relpath", "run", "at.context", "at.header", "at.heading", F.posexplode(_packed(F.col("parts"), size)).alias("nth", "piece"))
    lines = F.filter(F.concat("context", F.transform("piece", lambda x: x.getField("text"))), lambda x: x != "")
    whole = pieces.select("relpath", "run", "nth", F.regexp_replace(F.array_join(lines, "\n\n"), "^\\s+|\\s+$", "").alias("text"), F.col("piece")[0].getField("kind").alias("section_type"), "header", "heading").filter("text != ''")
    place = F.row_number().over(Window.partitionBy("relpath").orderBy("run", "nth")) - 1
    return whole.select("relpath", place.alias("chunk_idx"), "text", "section_type", "header", "heading")


def joined(tokens: Column) -> Column:
    """Tokens put together again: a blank stands between a token of ASCII letters or digits and an ASCII token behind it, unless that closes, joins or shortens what it follows."""
    glued = F.transform(
        tokens,
        lambda t, k: F.when(
            (k > 0) & F.get(tokens, k - 1).rlike("^[A-Za-z0-9]") & t.rlike("^[\\x00-\\x7F&&[^.,!?;:)\\]}/%_'-]]"),
            F.concat(F.lit(" "), t),
        ).otherwise(t),
    )
    return F.array_join(glued, "")
