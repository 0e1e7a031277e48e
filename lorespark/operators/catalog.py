"""Catalogue, workspaces, extraction and synthesis artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import classify, concept, first_line, slug

LABELS = ("dependency", "risk", "project", "general")
RELATIONS = ("impacts", "depends_on", "references", "belongs_to", "causes", "contradicts", "succeeds", "owns")


def issues(entries: DataFrame, raw: DataFrame, pages: DataFrame) -> DataFrame:
    """entries with an array of what is wrong, and a status. entries: relpath, format, wiki_pages; raw: relpath; pages: slug."""
    here = raw.select("relpath", F.lit(True).alias("__raw"))
    lost = entries.select("relpath", F.explode("wiki_pages").alias("slug")).join(pages.select("slug"), "slug", "left_anti").groupBy("relpath").agg(F.lit(True).alias("__lost"))
    out = entries.join(here, "relpath", "left").join(lost, "relpath", "left")
    found = F.array_compact(F.array(F.when(F.col("__raw").isNull(), "raw_source_missing"), F.when(F.col("__lost"), "wiki_page_missing")))
    return out.withColumn("issues", found).withColumn("status", F.when(F.size("issues") > 0, "degraded").otherwise("ok")).drop("__raw", "__lost")


def page(entries: DataFrame, offset: int = 0, limit: int = 50, format_: str | None = None, text: str | None = None) -> DataFrame:
    """One page of the catalogue, by relpath."""
    out = entries
    if format_ is not None:
        out = out.filter(F.col("format") == format_)
    if text is not None:
        out = out.filter(F.lower("relpath").contains(text.lower()))
    return out.orderBy("relpath").offset(offset).limit(limit)


def workspace_status(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """workspace_id, sources, formats (map), last_ingest and duplicate. entries: workspace_id, format, ingested_at; registry: workspace_id, root."""
    formats = entries.groupBy("workspace_id", "format").agg(F.count("*").alias("n"), F.max("ingested_at").alias("last"))
    per = formats.groupBy("workspace_id").agg(F.sum("n").alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n")))).alias("formats"), F.max("last").alias("last_ingest"))
    same = F.count("*").over(Window.partitionBy("root")) > 1
    return registry.withColumn("duplicate", same).join(per, "workspace_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The deterministic extractor: label, confidence, summary, concept of each text."""
    t = F.col(text_col)
    first = first_line(t)
    return docs.select(id_col, classify(t).alias("label"), F.lit(0.9).alias("confidence"), F.when(first == "", F.concat(F.col(id_col).cast("string"), F.lit(" extraction candidate"))).otherwise(first).alias("summary"), concept(t).alias("concept"))


def extraction_errors(x: DataFrame) -> DataFrame:
    """x with the errors of each extraction: label (string), confidence (double), entities (array of id), relations (array of source, target, type)."""
    ends = F.flatten(F.transform("relations", lambda r: F.array(r.getField("source"), r.getField("target"))))
    ids = F.transform("entities", lambda e: e.getField("id"))
    return x.withColumn(
        "errors",
        F.array_compact(F.array(
            F.when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label"),
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
            F.when(F.exists("relations", lambda r: ~r.getField("type").isin(*RELATIONS)), "relation_type"),
            F.when(F.exists("relations", lambda r: r.getField("source") == r.getField("target")), "self_relation"),
            F.when(F.size(F.array_except(ends, ids)) > 0, "unknown_entity"),
        )),
    )


def synthesize(artifacts: DataFrame) -> DataFrame:
    """A wiki candidate of each extraction artifact (artifact_id, relpath, entities, facts, summary): its title is the first entity that is no file, its body at most eight facts."""
    title = F.coalesce(F.get(F.filter("entities", lambda e: ~e.rlike("\\.[a-z]{2,4}$")), F.lit(0)), F.col("relpath"))
    body = F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("summary"), F.lit("\n\n"), F.array_join(F.transform(F.slice("facts", 1, 8), lambda f: F.concat(F.lit("- "), f)), "\n"))
    out = artifacts.select("artifact_id", "relpath", title.alias("title"), "summary", body.alias("body"))
    return out.withColumn("target_slug", slug(F.col("title"))).withColumn("candidate_id", F.substring(F.sha2(F.concat_ws("|", "artifact_id", "target_slug", "body"), 256), 1, 24))


def apply_operation(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate_id and operation: create, update, already_applied, or conflict with a page of other origin or another source."""
    p = pages.select(F.col("slug").alias("target_slug"), F.col("origin"), F.col("source_relpath"), F.col("body").alias("page_body"))
    operation = (
        F.when(F.col("origin").isNull(), "create")
        .when((F.col("origin") != "llm_wiki") | ~F.col("source_relpath").eqNullSafe(F.col("relpath")), "conflict")
        .when(F.col("body") == F.col("page_body"), "already_applied")
        .otherwise("update")
    )
    return candidates.join(p, "target_slug", "left").select("candidate_id", "target_slug", operation.alias("operation"))


def mode_smallest(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equal ones the smallest."""
    return rows.groupBy(*by, value).count().groupBy(*by).agg(F.max_by(value, F.struct("count", -F.col(value))).alias(value))


def heading_level(size: Column, base: Column) -> Column:
    """1 from half as large again as the base, 2 from three tenths, else none."""
    return F.when(size >= base * 1.5, 1).when(size >= base * 1.3, 2)


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words (image, block, par, line, left, top, width, height, conf, text): text from left to right, box and mean confidence."""
    g = words.groupBy("image", "block", "par", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w.getField("text")), " ")
    return g.agg(text.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.round(F.avg("conf") / 100, 4).alias("confidence"))
