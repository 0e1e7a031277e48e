"""Findings over what an engine keeps beside its store: artifacts, candidates, and runs of refresh and graph analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import front_matter
from lorespark.operators import catalog, lint, refresh
from lorespark.operators.tables import names, union_all, unreadable
from lorespark.sources.sinks import VersionedTable

#: Tables of a run of graph analytics.
PARTS = ("nodes", "edges", "communities")
KINDS = ("ingest", "prune", "report_issue", "graphify_build")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or none of its rows if it is not there."""
    return spark.read.schema(schema).parquet(path) if names(spark, path) else spark.createDataFrame([], schema)


def artifact_findings(spark: SparkSession, root: str) -> DataFrame:
    """Stored extractions that cannot be read, or that say what an extraction cannot."""
    path = f"{root}/artifacts"
    broken = unreadable(spark, [path] if names(spark, path) else [])
    parts = [lint.check_unreadable(broken, "llm_artifact_corrupt")]
    if broken.isEmpty():
        rows = _table(spark, path, "artifact_id string, idempotency_key string, label string, confidence double").filter("idempotency_key like 'extract:%'")
        rows = rows.withColumns({"entities": F.expr("cast(array() as array<struct<id: string>>)"), "relations": F.expr("cast(array() as array<struct<source: string, target: string, type: string>>)")})
        checked = catalog.extraction_errors(rows).select(F.col("artifact_id").alias("path"), F.lit(None).cast("string").alias("corrupt"), "errors")
        parts.append(lint.check_artifacts(checked, "llm_artifact"))
    return union_all(parts)


def synthesis_findings(spark: SparkSession, candidates: VersionedTable, pages: DataFrame) -> DataFrame:
    """Candidates that cannot be read or lack a field, and pages that do not tell the candidate that they are made of."""
    there = candidates.exists()
    broken = unreadable(spark, [candidates.folder()] if there else [])
    parts = [lint.check_unreadable(broken, "wiki_candidate_artifact_corrupt")]
    if broken.isEmpty():
        fields = ("artifact_id", "candidate_id", "target_slug", "title", "body", "relpath", "sha256", "parser_fingerprint")
        rows = candidates.read() if there else spark.createDataFrame([], ", ".join(f"{f} string" for f in fields))
        lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f"no {f}")) for f in fields)))
        checked = rows.select(F.col("candidate_id").alias("path"), F.lit(None).cast("string").alias("corrupt"), lacks.alias("errors"))
        parts += [lint.check_artifacts(checked, "wiki_candidate_artifact"), lint.check_synthesis(pages.withColumn("metadata", front_matter(F.col("text"))), rows)]
    return union_all(parts)


def graph_run_findings(spark: SparkSession, root: str, kept: VersionedTable) -> DataFrame:
    """Runs of graph analytics without all of their tables or without an entry, tables that cannot be read, and graphs that are not whole."""
    top = f"{root}/graphify"
    # a few names for each kept run
    found = {run: [part for part in PARTS if "_SUCCESS" in names(spark, f"{top}/{run}/{part}")] for run in names(spark, top) if run != "runs"}
    told = kept.read().select("run_id", "nodes", "edges", "at") if kept.exists() else spark.createDataFrame([], "run_id string, nodes long, edges long, at timestamp")
    files = spark.createDataFrame([*found.items()], "run_id string, files array<string>")
    runs = files.join(told.select("run_id", F.lit("complete").alias("status")), "run_id", "left")
    newest = told.orderBy(F.desc("at"), "run_id").limit(1).select("run_id")
    # a run's entry comes last: tables without one are of a run that did not end
    open_ = runs.withColumn("files", F.when(F.col("status").isNull(), F.array().cast("array<string>")).otherwise(F.col("files")))
    at = {part: [f"{top}/{run}/{part}" for run, has in found.items() if part in has] for part in PARTS}
    broken = [unreadable(spark, folders) for folders in at.values()]
    bad = {r["path"].split("/")[-2] for rows in broken for r in rows.collect()}  # at most the tables of kept runs
    whole = [run for run, has in found.items() if len(has) == len(PARTS) and run not in bad]
    parts = [lint.check_runs(open_, newest, "graphify", PARTS), *(lint.check_unreadable(rows, "graphify_corrupt_upstream_artifact") for rows in broken)]
    if whole:
        of_run = F.regexp_extract(F.input_file_name(), "/graphify/([^/]+)/[^/]+/[^/]*$", 1).alias("run_id")
        nodes, edges = (spark.read.parquet(*(f"{top}/{run}/{part}" for run in whole)).select(of_run, *columns) for part, columns in (("nodes", ("id",)), ("edges", ("id", "src", "dst"))))
        own = told.join(spark.createDataFrame([(run,) for run in whole], "run_id string"), "run_id", "left_semi")
        parts.append(lint.check_run_graphs(own, nodes, edges))
    return union_all(parts)


def watch_findings(spark: SparkSession, root: str) -> DataFrame:
    """Refreshes that failed in part or did not come to their end, whose plan is missing, that say what no refresh does, and tables that cannot be read."""
    at = {kind: f"{root}/watch/{kind}" for kind in ("plans", "runs")}
    broken = [unreadable(spark, [path] if names(spark, path) else []) for path in at.values()]
    parts = [lint.check_unreadable(rows, "watch_artifact_corrupt") for rows in broken]
    if all(rows.isEmpty() for rows in broken):
        plans = _table(spark, at["plans"], "run_id string, action_id string, kind string")
        runs = _table(spark, at["runs"], "run_id string, action_id string, kind string, outcome string, at timestamp")
        ends = runs.groupBy("run_id").agg(F.max("at").alias("at"), F.max((F.col("outcome") == "failed").cast("int")).alias("failed"), F.count("*").alias("n"))
        planned = plans.groupBy("run_id").agg(F.count("*").alias("planned")).join(ends, "run_id", "left")
        status = F.when((F.coalesce("n", F.lit(0)) < F.col("planned")) | (F.col("failed") == 1), "partial").otherwise("complete")
        newest = ends.orderBy(F.desc("at"), "run_id").limit(1).select("run_id")
        wrong = F.array_compact(F.array(
            F.when(F.col("action_id").isNull(), "no action_id"),
            F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
            F.when(~F.coalesce(F.col("outcome").isin(*refresh.OUTCOMES), F.lit(False)), "outcome"),
        ))
        # as many kinds of errors as there are, whatever a run's number of actions
        errors = runs.select("run_id", F.explode(wrong).alias("error")).groupBy("run_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))
        checked = errors.select(F.col("run_id").alias("path"), F.lit(None).cast("string").alias("corrupt"), "errors")
        none = F.lit(None).cast("array<string>")
        parts += [lint.check_runs(planned.select("run_id", status.alias("status"), none.alias("files")), newest, "watch"), lint.check_artifacts(checked, "watch_artifact")]
    return union_all(parts)
