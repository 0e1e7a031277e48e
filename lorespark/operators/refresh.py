"""Incremental refresh: source states, ingest status, lineage, plans and their execution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import fingerprint_compatible

BUILD = "graphify:build"
OUTCOMES = ("planned", "skipped", "completed", "failed")
INGESTED = ("created", "updated", "skipped", "failed", "pruned")
STATES = ("unchanged", "new", "stale", "missing", "unsupported", "corrupt")


def states(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """relpath, state and both digests. files: relpath, sha256, parser_fingerprint, issue (unsupported, corrupt or null); manifest: relpath, sha256, parser_fingerprint."""
    f = files.select("relpath", "sha256", "parser_fingerprint", "issue", F.lit(True).alias("here"))
    m = manifest.select("relpath", F.col("sha256").alias("known_sha256"), F.col("parser_fingerprint").alias("known_fingerprint"), F.lit(True).alias("known"))
    changed = ~F.col("sha256").eqNullSafe(F.col("known_sha256")) | ~F.col("parser_fingerprint").eqNullSafe(F.col("known_fingerprint"))
    state = F.when(F.col("here").isNull(), "missing").when(F.col("issue").isNotNull(), F.col("issue")).when(F.col("known").isNull(), "new").when(changed, "stale").otherwise("unchanged")
    return f.join(m, "relpath", "full_outer").select("relpath", state.alias("state"), "sha256", "known_sha256")


def state_counts(found: DataFrame) -> DataFrame:
    """state and n for each of STATES, none left out."""
    return counts(found, "state", STATES)


def ingest_status(files: DataFrame, manifest: DataFrame, prune: bool = False) -> DataFrame:
    """relpath and status: created, updated, skipped (same digest and a parser that fits), failed, and with prune, pruned."""
    m = manifest.select("relpath", F.col("sha256").alias("known_sha256"), F.col("parser_fingerprint").alias("known_fingerprint"), F.lit(True).alias("known"))
    same = (F.col("sha256") == F.col("known_sha256")) & fingerprint_compatible(F.col("known_fingerprint"), F.col("parser_fingerprint"))
    status = F.when(F.col("issue").isNotNull(), "failed").when(F.col("known").isNull(), "created").when(same, "skipped").otherwise("updated")
    out = files.join(m, "relpath", "left").select("relpath", status.alias("status"))
    if prune:
        out = out.union(manifest.join(files, "relpath", "left_anti").select("relpath", F.lit("pruned").alias("status")))
    return out


def plan(found: DataFrame, prune: bool = False, build: bool = True) -> DataFrame:
    """action_id, kind, status and n_depends: what a refresh has to do, and after how many other actions; see dependencies()."""
    kind = F.when(F.col("state").isin("new", "stale"), "ingest").when(F.col("state").isin("unsupported", "corrupt"), "report_issue")
    if prune:
        kind = kind.when(F.col("state") == "missing", "prune")
    verb = F.when(F.col("kind") == "report_issue", "issue").otherwise(F.col("kind"))
    steps = found.withColumn("kind", kind).filter("kind is not null")
    steps = steps.select(F.concat(verb, F.lit(":"), "relpath").alias("action_id"), "kind", F.when(F.col("kind") == "report_issue", "skipped").otherwise("planned").alias("status"), F.lit(0).cast("long").alias("n_depends"))
    if not build:
        return steps
    some = steps.agg(F.count("*").alias("n"), F.count(F.when(F.col("kind").isin("ingest", "prune"), 1)).alias("n_depends"))
    last = some.filter("n > 0").select(F.lit(BUILD).alias("action_id"), F.lit("graphify_build").alias("kind"), F.lit("planned").alias("status"), "n_depends")
    return steps.unionByName(last)


def dependencies(steps: DataFrame) -> DataFrame:
    """action_id and depends_on, a row for each: the graph build comes after all ingests and prunes."""
    return steps.filter("kind in ('ingest', 'prune')").select(F.lit(BUILD).alias("action_id"), F.col("action_id").alias("depends_on"))


def counts(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """column and n for each of values, none left out."""
    all_ = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return all_.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def lineage(found: DataFrame, artifacts: DataFrame) -> DataFrame:
    """artifact_id, kind and reason of artifacts (artifact_id, kind, relpath) whose source changed or is gone."""
    changed = found.filter("state in ('stale', 'missing')").select("relpath", F.concat(F.lit("source_"), "state").alias("reason"))
    stale = artifacts.join(changed, "relpath").select("artifact_id", "kind", "reason")
    unknown = artifacts.join(found.select("relpath"), "relpath", "left_anti").select("artifact_id", "kind", F.lit("source_unknown").alias("reason"))
    return stale.union(unknown)


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """One digest of a table, whatever the order of its rows: partial sums of row digests, not the rows, meet."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), F.sum(h).alias("a"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("b"))
    return sums.select(F.sha2(F.concat_ws("|", "n", "a", "b"), 256)).first()[0]


def execute(steps: DataFrame, handlers: dict[tuple[str, ...], Callable[[DataFrame], DataFrame | None]], mode: str = "dry-run") -> DataFrame:
    """steps with the outcome of each and the error, if any. A handler has the kinds of actions that it runs in one call, in the handlers' order. It gives the outcome of each action (action_id, outcome) as it was, or nothing where all that it did not raise for is completed. What a handler raises fails its actions, and those of later handlers are skipped."""
    parts, failed = [steps.filter("status != 'planned'").select("action_id", F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("error"))], False
    for kinds, handler in handlers.items():
        part = steps.filter(F.col("kind").isin(*kinds) & (F.col("status") == "planned"))
        if part.isEmpty():
            continue
        outcome, error, told = "completed", None, None
        if mode != "execute" or failed:
            outcome = "skipped"
        else:
            try:
                told = handler(part)
            except Exception as e:  # noqa: BLE001  the state is the report
                outcome, error, failed = "failed", str(e)[:200], True
        rows = part.select("action_id", F.lit(outcome).alias("outcome"), F.lit(error).cast("string").alias("error"))
        if told is not None:
            # an action that the handler says nothing of did not happen
            own = told.select("action_id", F.col("outcome").alias("told"))
            rows = rows.join(own, "action_id", "left").select("action_id", F.coalesce("told", F.lit("skipped")).alias("outcome"), F.when(F.col("told") == "failed", "not parsed").alias("error"))
        parts.append(rows)
    return steps.join(reduce(DataFrame.unionByName, parts), "action_id", "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resolve_artifacts(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """The newest artifact of each source that fits its present digest and parser. artifacts: artifact_id, relpath, sha256, parser_fingerprint, created_at."""
    fit = artifacts.join(sources.select("relpath", "sha256", "parser_fingerprint"), ["relpath", "sha256", "parser_fingerprint"])
    return fit.groupBy("relpath").agg(F.max_by("artifact_id", F.struct("created_at", "artifact_id")).alias("artifact_id"))


def not_done(requests: DataFrame, artifacts: DataFrame, key: str = "idempotency_key", again: Column | None = None) -> DataFrame:
    """Requests without an artifact of the same key, or that ask for a new run."""
    open_ = requests.join(artifacts.select(key).distinct(), key, "left_anti")
    return open_ if again is None else open_.union(requests.filter(again)).distinct()
