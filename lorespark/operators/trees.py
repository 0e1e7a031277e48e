"""Section trees: headings to nodes with spans, paths, sections of offsets by a sweep, coverage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import TOKEN

#: A heading's line.
HEADING = "^(#{1,6})[^\\S\\n]+(\\S.*?)[^\\S\\n]*$"


def markdown_headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """relpath, idx, level, title, start, length (of the text) of each line `# title`, one to six signs. A text is cut before its headings, and each part's offset is a running sum over the parts."""
    parts = docs.select(F.col(id_col).alias("relpath"), F.length(text_col).alias("length"), F.posexplode(F.split(text_col, "(?md)(?=^#{1,6}[^\\S\\n]+\\S)")).alias("nth", "part"))
    before = F.sum(F.length("part")).over(Window.partitionBy("relpath").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    line = F.substring_index("part", "\n", 1)
    rows = parts.withColumns({"start": F.coalesce(before, F.lit(0)).cast("int"), "line": line}).filter(line.rlike(HEADING))
    idx = F.row_number().over(Window.partitionBy("relpath").orderBy("start"))
    return rows.select("relpath", idx.alias("idx"), F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"), "start", "length")


#: Levels of headings go from 1 to this.
DEEPEST = 9


def nest(headings: DataFrame) -> DataFrame:
    """Tree nodes of headings (relpath, idx, level, title, start, length), for levels from 1 to DEEPEST.

    A heading's parent is the nearest one before it of a lower level, and it ends where the next of its level or a lower one
    starts. Both, and the chain of ancestors, come from windows over the document, with one column for each level.
    """
    order = Window.partitionBy("relpath").orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, from the end on: a frame that grows takes linear time, one that shrinks does not
    after = Window.partitionBy("relpath").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    at_level = lambda columns: F.array(*columns)[F.col("level") - 1]
    levels = range(1, DEEPEST + 1)
    above = [F.max(F.when(F.col("level") < n, F.col("idx"))).over(before) for n in levels]
    ends = [F.min(F.when(F.col("level") <= n, F.col("start"))).over(after) for n in levels]
    rows = headings.withColumns({"parent": at_level(above), "end": F.coalesce(at_level(ends), "length")})
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("relpath", "parent").orderBy("idx")))
    # the last heading of each level; it is an ancestor if it comes after those of all lower levels
    last = [F.last(F.when(F.col("level") == n, F.struct("idx", "nth", "title")), True).over(before) for n in levels]
    rows = rows.withColumns({f"last{n}": c for n, c in zip(levels, last, strict=True)})
    latest, chain = F.lit(0), []
    for n in levels:
        own = F.col(f"last{n}")
        chain.append(F.when((F.col("level") > n) & (own.getField("idx") > latest), own))
        latest = F.greatest(latest, own.getField("idx"))
    rows = rows.withColumn("chain", F.filter(F.array(*chain), lambda x: x.isNotNull()))
    joined = lambda field, sep: F.array_join(F.transform("chain", lambda x: x.getField(field).cast("string")), sep)
    inner = F.size("chain") > 0
    parent = F.when(inner, F.concat(F.lit("n"), joined("nth", ".")))
    return rows.select(
        "relpath", F.concat(F.coalesce(F.concat(parent, F.lit(".")), F.lit("n")), F.col("nth").cast("string")).alias("node_id"), parent.alias("parent_id"), F.col("idx").alias("preorder"),
        F.size("chain").alias("depth"), "level", "title", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"),
        F.when(inner, F.concat_ws(" > ", joined("title", " > "), "title")).otherwise(F.col("title")).alias("section_path"),
    )


def single_root(docs: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """One node that spans everything, for formats without sections."""
    return docs.select(
        F.col(id_col).alias("relpath"), F.lit("n1").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("preorder"), F.lit(0).alias("depth"), F.lit(1).alias("level"),
        F.col(title_col).alias("title"), F.lit(0).alias("start_offset"), F.length(text_col).alias("end_offset"), F.col(title_col).alias("section_path"),
    )


def _clean(title: Column) -> Column:
    """A heading's text without its signs."""
    return F.trim(F.regexp_replace(title, "^#+\\s*", ""))


def segment_headings(spans: DataFrame) -> DataFrame:
    """Headings for nest(), from the segments that are headings (relpath, seg_idx, kind, text, metadata, start, end); a paragraph that looks like one is none."""
    whole = F.max("end").over(Window.partitionBy("relpath"))
    rows = spans.withColumn("length", whole).filter("kind = 'heading'")
    idx = F.row_number().over(Window.partitionBy("relpath").orderBy("seg_idx"))
    level = F.coalesce(F.try_element_at("metadata", F.lit("level")).cast("int"), F.length(F.regexp_extract("text", "^(#+)", 1)))
    return rows.select("relpath", idx.alias("idx"), F.least(F.greatest(level, F.lit(1)), F.lit(DEEPEST)).alias("level"), _clean(F.col("text")).alias("title"), "start", "length")


def header_tree(spans: DataFrame) -> DataFrame:
    """Tree nodes of slides and sheets: each header's run of segments is a section, and a slide's headings are its children, each as long as its own text."""
    is_header = F.col("kind").isin("slide_header", "sheet_header")
    order = Window.partitionBy("relpath").orderBy("seg_idx")
    rows = spans.withColumn("k", F.sum(is_header.cast("int")).over(order)).filter("k > 0")
    run, inside = Window.partitionBy("relpath", "k"), Window.partitionBy("relpath", "k").orderBy("seg_idx")
    is_child = (F.col("kind") == "heading") & (F.col("top_kind") == "slide_header")
    sheet = F.when(F.col("kind") == "sheet_header", F.try_element_at("metadata", F.lit("sheet_name")))
    rows = rows.withColumns({"section_end": F.max("end").over(run), "top_kind": F.first("kind").over(inside), "named": F.coalesce(sheet, _clean(F.col("text")))})
    rows = rows.withColumns({"top": F.first("named").over(inside), "j": F.sum(is_child.cast("int")).over(inside)}).filter(is_header | is_child)
    rows = rows.withColumn("preorder", F.row_number().over(order))
    parent = F.concat(F.lit("n"), F.col("k").cast("string"))
    return rows.select(
        "relpath", F.when(is_header, parent).otherwise(F.concat(parent, F.lit("."), F.col("j").cast("string"))).alias("node_id"), F.when(~is_header, parent).alias("parent_id"), "preorder",
        F.when(is_header, 0).otherwise(1).alias("depth"), F.when(is_header, 1).otherwise(2).alias("level"), F.col("named").alias("title"), F.col("start").alias("start_offset"),
        F.when(is_header, F.col("section_end")).otherwise(F.col("end")).alias("end_offset"), F.when(is_header, F.col("named")).otherwise(F.concat("top", F.lit(" > "), "named")).alias("section_path"),
    )


def sections_at(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """relpath, offset and the deepest node that holds it (of several the first). Starts of sections and offsets of a document pass once, in order; what is held meanwhile are the sections that are open."""
    none = lambda kind: F.lit(None).cast(kind)
    begin = nodes.select("relpath", F.col("start_offset").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("end_offset").cast("long").alias("end"), "depth", "preorder", "node_id", "section_path")
    ask = offsets.select("relpath", F.col("offset").cast("long").alias("at"), F.lit(1).alias("kind"), none("long").alias("end"), none("int").alias("depth"), none("int").alias("preorder"), none("string").alias("node_id"), none("string").alias("section_path")).distinct()
    order = ["relpath", "at", "kind"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, opened = None, []
        for b in batches:
            out = []
            for relpath, at, kind, end, depth, preorder, node, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if relpath != document:
                    document, opened = relpath, []
                if kind == 0:
                    opened.append((end, depth, -preorder, node, path))
                else:
                    opened = [x for x in opened if x[0] > at]
                    if opened:
                        best = max(opened, key=lambda x: x[1:3])
                        out.append((relpath, at, best[3], best[4]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["relpath", "offset", "node_id", "section_path"])

    both = begin.unionByName(ask).repartition("relpath").sortWithinPartitions(*order)
    return both.mapInArrow(sweep, "relpath string, offset int, node_id string, section_path string")


def own_ranges(nodes: DataFrame) -> DataFrame:
    """relpath, node_id, start, end of what each node holds outside its children."""
    child = nodes.filter("parent_id is not null").select("relpath", F.col("parent_id").alias("node_id"), F.col("start_offset").alias("a"), F.col("end_offset").alias("b"))
    edge = nodes.select("relpath", "node_id", F.col("end_offset").alias("a"), F.col("end_offset").alias("b"))
    start = nodes.select("relpath", "node_id", F.col("start_offset").alias("begin"))
    w = Window.partitionBy("relpath", "node_id").orderBy("a", "b")
    cuts = child.union(edge).join(start, ["relpath", "node_id"])
    cuts = cuts.withColumn("start", F.greatest(F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("begin")), F.col("begin")))
    return cuts.select("relpath", "node_id", "start", F.col("a").alias("end")).filter("start < end")


def coverage(spans: DataFrame, id_col: str, length: Column) -> DataFrame:
    """id_col and covered: whether the spans (start, end) leave no gap from 0 to length."""
    w = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = spans.withColumns({"gap": F.col("start") > reach, "need": length})
    return rows.groupBy(id_col).agg(((F.max(F.col("gap").cast("int")) == 0) & (F.max("end") >= F.max("need"))).alias("covered"))


def enrich(nodes: DataFrame) -> DataFrame:
    """Nodes with a summary; the root of a tree of one node becomes three equal sections."""
    n = F.count("*").over(Window.partitionBy("relpath"))
    rows = nodes.withColumn("n", n).withColumn("part", F.explode(F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(-1)))))
    size = F.col("end_offset") - F.col("start_offset")
    cut = lambda k: F.col("start_offset") + F.floor(size * k / 3).cast("int")
    whole = F.col("part") < 0
    return rows.select(
        "relpath",
        F.when(whole, F.col("node_id")).otherwise(F.concat(F.lit("n"), (F.col("part") + 1).cast("string"))).alias("node_id"),
        F.when(whole, F.col("title")).otherwise(F.concat("title", F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit(")"))).alias("title"),
        F.when(whole, F.col("start_offset")).otherwise(cut(F.col("part"))).alias("start_offset"),
        F.when(whole, F.col("end_offset")).otherwise(cut(F.col("part") + 1)).alias("end_offset"),
    ).withColumn("summary", F.concat(F.lit("Summary of: "), "title"))


def chunk_offsets(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """relpath, chunk_idx, offset: where in the body (relpath, body) the token stands that each chunk (relpath, chunk_idx, start) begins with; -1 beyond the last token. A body is read once."""
    token = re.compile(TOKEN.replace("\\x{4e00}", "一").replace("\\x{9fff}", "鿿"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for relpath, body, starts in pdf.itertuples(index=False):
                places = [m.start() for m in token.finditer(body or "")]
                out += [(relpath, s["chunk_idx"], places[s["start"]] if s["start"] < len(places) else -1) for s in starts]
            yield pd.DataFrame(out, columns=["relpath", "chunk_idx", "offset"])

    starts = chunks.groupBy("relpath").agg(F.collect_list(F.struct(F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("start").cast("int").alias("start"))).alias("starts"))
    return bodies.select("relpath", "body").join(starts, "relpath").mapInPandas(find, "relpath string, chunk_idx int, offset int")


def flatten_trees(trees: DataFrame) -> DataFrame:
    """relpath, node_id, depth, title of trees kept as JSON of any depth (relpath, json)."""
    import json

    def walk(node: dict, depth: int) -> Iterator[tuple[str, int, str]]:
        yield node.get("node_id", ""), depth, node.get("title", "")
        for child in node.get("children", ()):
            yield from walk(child, depth + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, *x) for r, j in zip(pdf["relpath"], pdf["json"], strict=True) for root in json.loads(j).get("root_nodes", ()) for x in walk(root, 0)]
            yield pd.DataFrame(rows, columns=["relpath", "node_id", "depth", "title"])

    return trees.select("relpath", "json").mapInPandas(run, "relpath string, node_id string, depth int, title string")
