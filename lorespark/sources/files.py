"""Files as tables: discovery, format checks, digests, limits, and parsers for text, markdown and Office files."""

from __future__ import annotations

import io
import re
import signal
import threading
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.text import front_matter, table_row, without_front_matter
from lorespark.operators.tables import written

# Formats by suffix, what their files begin with, limits in MB, and the main part of Office files.
FORMATS = ("txt", "md", "pdf", "docx", "xlsx", "pptx", "png", "jpg", "jpeg")
MAGIC = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304"}
OLE = "D0CF11E0A1B11AE1"
LIMIT_MB = {"png": 20, "jpg": 20, "jpeg": 20}
DEFAULT_LIMIT_MB = 200
MAIN_PART = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
SEGMENT = "relpath string, seg_idx int, kind string, text string, metadata map<string,string>"


#: Changed files that are named one by one to Spark's reader; more are found by a scan of the whole folder.
MOST_NAMED = 10_000


def discover(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """relpath, path, modificationTime, length and content of all files under a folder, or of some of them. Content is only read where a plan uses it. Spark lists no empty files."""
    return relative(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root if paths is None else paths), root)


def relative(files: DataFrame, root: str) -> DataFrame:
    """Files of Spark's reader with the path below the root."""
    top = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace("path", f"^.*?{re.escape(top)}/", "")
    return files.select(F.when(F.col("path").endswith(top), F.regexp_extract("path", "[^/]+$", 0)).otherwise(rel).alias("relpath"), "path", "modificationTime", "length", "content")


def rescan(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Files as checked() has them, where only changed ones are read. known: relpath, length, modificationTime and sha256 of files whose digest is known; a file of the same length and time has it still, and no content here."""
    listed = discover(spark, root).select("relpath", "path", "modificationTime", "length")
    same = written(listed.join(known, ["relpath", "length", "modificationTime"]))
    changed = listed.join(same.select("relpath"), "relpath", "left_anti").select("relpath", "path")
    few = [r["path"] for r in changed.select("path").limit(MOST_NAMED + 1).collect()]
    if len(few) > MOST_NAMED:
        read = discover(spark, root).join(changed.select("relpath"), "relpath", "left_semi")
    else:
        read = discover(spark, root, [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in few]) if few else discover(spark, root).limit(0)
    none = same.withColumns({"content": F.lit(None).cast("binary"), "format": format_of(F.col("path")), "issue": F.lit(None).cast("string")})
    read = checked(read)
    return read.unionByName(none.select(read.columns))


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return F.when(suffix.isin(*FORMATS), suffix)


def checked(files: DataFrame) -> DataFrame:
    """files with format, sha256 and issue: unsupported, oversized, empty, encrypted (an old container), corrupt (not what the suffix says) or null."""
    f, head = format_of(F.col("path")), F.hex(F.substring("content", 1, 8))
    limit = F.lit(DEFAULT_LIMIT_MB)
    for k, mb in LIMIT_MB.items():
        limit = F.when(f == k, mb).otherwise(limit)
    right = F.lit(True)
    for k, magic in MAGIC.items():
        right = F.when(f == k, head.startswith(magic)).otherwise(right)
    office = f.isin(*MAIN_PART)
    issue = (
        F.when(f.isNull(), "unsupported")
        .when(F.col("length") > limit * 1024 * 1024, "oversized")
        .when(F.col("length") == 0, "empty")
        .when(office & (head == OLE), "encrypted")
        .when(~right, "corrupt")
    )
    return files.withColumns({"format": f, "issue": issue, "sha256": F.when(issue.isNull() | (issue != "oversized"), F.sha2("content", 256))})


def title_of(relpath: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_extract(relpath, "[^/]+$", 0), "\\.[^.]+$", ""), "-_", "  ")


def read_text(files: DataFrame) -> DataFrame:
    """relpath, title and body of txt and md files; bad bytes are replaced, front matter goes, a first heading is the title."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    md = F.col("format") == "md"
    body = F.when(md, F.regexp_replace(text, "^---\\n[\\s\\S]*?\\n---\\n\\s*", "")).otherwise(text)
    heading = F.regexp_extract(body, "(?m)^#{1,6}\\s+(.+?)\\s*$", 1)
    title = F.when(md & (heading != ""), heading).otherwise(title_of(F.col("relpath")))
    return files.filter("format in ('txt', 'md') and issue is null").select("relpath", "format", title.alias("title"), body.alias("body"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _words(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t").strip()


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"


def docx_segments(z: zipfile.ZipFile) -> Iterator[tuple[str, str, dict[str, str]]]:
    body = next(x for x in ElementTree.fromstring(z.read(MAIN_PART["docx"])) if _local(x.tag) == "body")
    for block in body:
        if _local(block.tag) == "tbl":
            rows = [[_words(c) for c in r if _local(c.tag) == "tc"] for r in block if _local(r.tag) == "tr"]
            for n, cells in enumerate(rows[1:] or rows):
                head = rows[0] if len(rows) > 1 else []
                yield "table_row", (_row(head) + "\n" if head else "") + _row(cells), {"row": str(n)}
        elif _local(block.tag) == "p":
            style = next((v for x in block.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.match(r"Heading\s?(\d)", style)
            text = _words(block)
            if any(_local(x.tag) in ("drawing", "pict") for x in block.iter()):
                yield "placeholder", "[image: ]", {}
            if text and level:
                yield "heading", "#" * min(int(level[1]), 6) + " " + text, {"level": level[1]}
            elif text:
                yield "paragraph", ("- " if style.startswith("List") else "") + text, {}


def xlsx_segments(z: zipfile.ZipFile) -> Iterator[tuple[str, str, dict[str, str]]]:
    names = z.namelist()
    shared = [_words(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    sheets = [x.attrib.get("name", "") for x in ElementTree.fromstring(z.read(MAIN_PART["xlsx"])).iter() if _local(x.tag) == "sheet"]

    def value(cell: ElementTree.Element) -> str:
        v = next((x.text or "" for x in cell if _local(x.tag) == "v"), None)
        if v is None:
            formula = next((x.text or "" for x in cell if _local(x.tag) == "f"), None)
            return f"={formula}" if formula is not None else _words(cell)
        return shared[int(v)] if cell.attrib.get("t") == "s" else v

    for n, sheet in enumerate(sheets, 1):
        yield "sheet_header", f"## {sheet}", {"sheet_name": sheet}
        part = f"xl/worksheets/sheet{n}.xml"
        head: list[str] = []
        for r in (x for x in ElementTree.fromstring(z.read(part)).iter() if _local(x.tag) == "row") if part in names else ():
            cells = [value(c) for c in r if _local(c.tag) == "c"]
            if not any(cells):
                continue
            if not head:
                head = [c or f"col_{k}" for k, c in enumerate(cells, 1)]
            else:
                yield "table_row", _row(head) + "\n" + _row(cells), {"sheet_name": sheet}


def pptx_segments(z: zipfile.ZipFile, notes: bool = True) -> Iterator[tuple[str, str, dict[str, str]]]:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for k, name in enumerate(slides, 1):
        at = {"slide_index": str(k)}
        yield "slide_header", f"## Slide {k}", at
        for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) in ("sp", "graphicFrame", "pic")):
            if _local(shape.tag) == "pic":
                yield "placeholder", "[image: ]", at
                continue
            for r in (x for x in shape.iter() if _local(x.tag) == "tr"):
                yield "table_row", _row([_words(c) for c in r if _local(c.tag) == "tc"]), at
            title = any(_local(x.tag) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
            if _local(shape.tag) == "sp" and (text := "\n".join(t for p in shape.iter() if _local(p.tag) == "p" and (t := _words(p)))):
                yield ("heading", f"### {text}", at) if title else ("paragraph", text, at)
        note = f"ppt/notesSlides/notesSlide{k}.xml"
        if notes and note in z.namelist() and (text := _words(ElementTree.fromstring(z.read(note)))):
            yield "notes", text, at


READERS = {"docx": docx_segments, "xlsx": xlsx_segments, "pptx": pptx_segments}


class limited:  # noqa: N801
    """Raises TimeoutError in its block after so many seconds, where signals can be used."""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds if threading.current_thread() is threading.main_thread() else 0.0

    def __enter__(self) -> None:
        if self.seconds:
            self.before = signal.signal(signal.SIGALRM, self._over)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)

    def _over(self, *_: object) -> None:
        raise TimeoutError(f"parsing took more than {self.seconds:g} s")

    def __exit__(self, *_: object) -> None:
        if self.seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)


def read_office(files: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Segments of docx, xlsx and pptx files, each parsed by itself; a file that can't be read, or not in so many seconds, has one segment of kind `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for relpath, kind, content in pdf.itertuples(index=False):
                try:
                    with limited(seconds), zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [*READERS[kind](z)]
                except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                    found = [("error", f"{type(e).__name__}: {e}"[:200], {})]
                out += [(relpath, n, k, t, m) for n, (k, t, m) in enumerate(found)]
            yield pd.DataFrame(out, columns=["relpath", "seg_idx", "kind", "text", "metadata"])

    return files.filter("format in ('docx', 'xlsx', 'pptx') and issue is null").select("relpath", "format", "content").mapInPandas(run, SEGMENT)


def read_pdf(*_: object) -> DataFrame:
    raise NotImplementedError("reading PDF files needs a PDF library, which is not installed; pdf_sections works on spans")


def read_images(*_: object) -> DataFrame:
    raise NotImplementedError("reading images needs an OCR program, which is not installed; ocr_lines works on its words")


def pdf_sections(spans: DataFrame) -> DataFrame:
    """relpath, section, level, title, text from spans (relpath, idx, size, text) by font size: a span half as large again as the usual size begins a section."""
    from lorespark.operators.catalog import heading_level, mode_smallest

    clean = spans.withColumn("text", F.trim("text")).filter("length(text) > 1 and not text rlike '^[0-9]+$'").withColumn("size", F.round("size", 1))
    base = mode_smallest(clean, ["relpath"], "size").withColumnRenamed("size", "base")
    rows = clean.join(base, "relpath").withColumn("level", heading_level(F.col("size"), F.col("base")))
    w = Window.partitionBy("relpath").orderBy("idx")
    rows = rows.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("idx", "text")))), lambda x: x.getField("text")), " ")
    return rows.groupBy("relpath", "section").agg(F.min_by("level", "idx").alias("level"), F.min_by("text", "idx").alias("title"), body.alias("text"))


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """slug, metadata (map) and body of wiki pages kept as markdown with front matter."""
    pages = spark.read.text(f"{path}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)\\.md$", 1).alias("slug"), "value")
    return pages.select("slug", front_matter(F.col("value")).alias("metadata"), without_front_matter(F.col("value")).alias("body"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """slug of each link of the wiki's index, repeats kept."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("\\(pages/(.+?)\\.md\\)"), F.lit(1))).alias("slug"))


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, the fields of schema, and corrupt (the text of files that can't be parsed)."""
    rows = spark.read.schema(f"{schema}, corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return rows.withColumn("path", F.input_file_name())


__all__ = ["checked", "discover", "pdf_sections", "read_artifacts", "read_images", "read_index", "read_office", "read_pdf", "read_text", "read_wiki", "table_row", "title_of"]
