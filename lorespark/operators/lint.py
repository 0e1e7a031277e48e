"""Consistency checks as anti-joins; each gives findings (category, severity, target, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.tables import union_all
from lorespark.operators.trees import coverage

# Severities in order, and each category's severity.
SEVERITIES = ("info", "warning", "error")
SEVERITY = {
    "orphan_page": "warning", "dead_link": "warning", "duplicate_slug": "warning", "dangling_manifest_entry": "error", "manifest_wiki_mismatch": "error",
    "orphan_raw_source": "warning", "wiki_source_mismatch": "error", "manifest_vector_mismatch": "error", "orphan_vector_chunk": "warning", "graph_drift": "error",
    "fingerprint_drift": "info", "llm_artifact_corrupt": "error", "llm_artifact_invalid": "error", "wiki_candidate_artifact_corrupt": "error", "wiki_candidate_artifact_invalid": "error",
    "wiki_synthesis_frontmatter_invalid": "error", "graphify_partial_run": "error", "graphify_latest_mismatch": "error", "graphify_corrupt_upstream_artifact": "warning", "graphify_invalid_graph": "warning",
    "watch_partial_run": "error", "watch_latest_mismatch": "error", "watch_artifact_corrupt": "error", "watch_artifact_invalid": "error", "workspace_registry_corrupt": "error", "workspace_registry_invalid": "error",
    "workspace_root_missing": "warning", "workspace_duplicate_root": "warning", "tree_missing": "warning", "tree_orphan": "warning", "tree_corrupt": "error",
    "tree_offset_mismatch": "info", "tree_node_chunk_gap": "info", "wiki_synthesis_partial_apply": "error",
}
GRAPHIFY_FILES = ("graph.json", "communities.json", "audit.json", "manifest.json", "graph.html", "GRAPH_REPORT.md")
SYNTHESIS_KEYS = ("generated_at", "extraction_artifact_id", "wiki_candidate_artifact_id", "source_fingerprint", "parser_fingerprint", "prompt_version", "provider_id", "model_id")
FIXES = ("rebuild_index", "prune_vectors", "prune_graph_nodes", "prune_graph_edges")


def finding(rows: DataFrame, category: str, target: Column, message: Column | str) -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(category).alias("category"), F.lit(SEVERITY[category]).alias("severity"), target.cast("string").alias("target"), said.alias("message"))


def without(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """rows whose key is not among the others' keys."""
    return rows.join(others.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().filter("count > 1")


def check_wiki(pages: DataFrame, index: DataFrame) -> DataFrame:
    """pages: slug; index: slug, repeats kept."""
    return union_all([
        finding(without(pages, "slug", index, "slug"), "orphan_page", F.col("slug"), "page is not in the index"),
        finding(without(index, "slug", pages, "slug"), "dead_link", F.col("slug"), "the index names a page that is missing"),
        finding(repeated(index, "slug"), "duplicate_slug", F.col("slug"), F.concat(F.lit("in the index "), F.col("count").cast("string"), F.lit(" times"))),
        finding(repeated(pages, "slug"), "duplicate_slug", F.col("slug"), F.concat(F.lit("on "), F.col("count").cast("string"), F.lit(" pages"))),
    ])


def check_sources(manifest: DataFrame, raw: DataFrame, pages: DataFrame) -> DataFrame:
    """manifest: relpath, wiki_pages; raw: relpath; pages: slug, origin, source_relpath."""
    named = manifest.select("relpath", F.explode("wiki_pages").alias("slug"))
    return union_all([
        finding(without(manifest, "relpath", raw, "relpath"), "dangling_manifest_entry", F.col("relpath"), "the raw source is missing"),
        finding(without(named, "slug", pages, "slug"), "manifest_wiki_mismatch", F.col("relpath"), F.concat(F.lit("page is missing: "), "slug")),
        finding(without(raw, "relpath", manifest, "relpath"), "orphan_raw_source", F.col("relpath"), "not in the manifest"),
        finding(without(pages.filter("origin = 'ingest'"), "source_relpath", manifest, "relpath"), "wiki_source_mismatch", F.col("slug"), F.concat(F.lit("source is not in the manifest: "), "source_relpath")),
    ])


def check_vectors(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """manifest: relpath, vector_ids; chunks: chunk_id."""
    ids = manifest.select("relpath", F.explode("vector_ids").alias("chunk_id"))
    return union_all([
        finding(without(ids, "chunk_id", chunks, "chunk_id"), "manifest_vector_mismatch", F.col("relpath"), F.concat(F.lit("chunk is missing: "), "chunk_id")),
        finding(without(chunks, "chunk_id", ids, "chunk_id"), "orphan_vector_chunk", F.col("chunk_id"), "no manifest entry has it"),
    ])


def check_graph(manifest: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """manifest: relpath, graph_nodes, graph_edges; nodes: id, source_relpaths; edges: id, src, dst, source_relpath."""
    want_n, want_e = (manifest.select("relpath", F.explode(c).alias("id")) for c in ("graph_nodes", "graph_edges"))
    owned = nodes.select("id", F.explode("source_relpaths").alias("relpath")).join(manifest.select("relpath"), "relpath", "left_semi")
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array("src", "dst")).alias("id"))
    return union_all([
        finding(without(want_n, "id", nodes, "id"), "graph_drift", F.col("id"), F.concat(F.lit("missing_node of "), "relpath")),
        finding(without(want_e, "id", edges, "id"), "graph_drift", F.col("id"), F.concat(F.lit("missing_edge of "), "relpath")),
        finding(without(nodes, "id", owned, "id"), "graph_drift", F.col("id"), "orphan_node"),
        finding(without(edges, "source_relpath", manifest, "relpath"), "graph_drift", F.col("id"), "orphan_edge: its source is not in the manifest"),
        finding(without(edges, "id", want_e, "id"), "graph_drift", F.col("id"), "orphan_edge: no manifest entry has it"),
        finding(without(ends, "id", nodes, "id"), "graph_drift", F.col("edge"), F.concat(F.lit("dangling_edge to "), "id")),
    ])


def check_fingerprints(manifest: DataFrame, current: Column) -> DataFrame:
    drift = (F.coalesce("parser_fingerprint", F.lit("*")) != "*") & (F.col("parser_fingerprint") != current)
    return finding(manifest.filter(drift), "fingerprint_drift", F.col("relpath"), F.concat(F.lit("stored "), "parser_fingerprint"))


def check_artifacts(artifacts: DataFrame, kind: str) -> DataFrame:
    """artifacts: path, corrupt (the raw text where it could not be parsed), errors (array). kind: llm_artifact, wiki_candidate_artifact or watch_artifact."""
    bad = artifacts.filter("corrupt is null and size(errors) > 0")
    return union_all([
        finding(artifacts.filter("corrupt is not null"), f"{kind}_corrupt", F.col("path"), "cannot be parsed"),
        finding(bad, f"{kind}_invalid", F.col("path"), F.array_join("errors", "; ")),
    ])


def check_synthesis(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages made of candidates, by what their front matter says. pages: slug, origin, metadata (map); candidates: candidate_id."""
    made = pages.filter("origin = 'llm_wiki'")
    lacks = F.filter(F.array(*map(F.lit, SYNTHESIS_KEYS)), lambda k: F.coalesce(F.try_element_at("metadata", k), F.lit("")) == "")
    named = made.withColumn("candidate_id", F.try_element_at("metadata", F.lit("wiki_candidate_artifact_id"))).filter("candidate_id != ''")
    return union_all([
        finding(made.withColumn("lacks", lacks).filter("size(lacks) > 0"), "wiki_synthesis_frontmatter_invalid", F.col("slug"), F.concat(F.lit("lacks "), F.array_join("lacks", ", "))),
        finding(without(named, "candidate_id", candidates, "candidate_id"), "wiki_synthesis_frontmatter_invalid", F.col("slug"), F.concat(F.lit("candidate is missing: "), "candidate_id")),
    ])


def check_runs(runs: DataFrame, latest: DataFrame, kind: str, needs: tuple[str, ...] = GRAPHIFY_FILES) -> DataFrame:
    """runs: run_id, status, files (array); latest: run_id. kind: graphify or watch. needs: the files that a graphify run has."""
    lacks = F.array_except(F.array(*map(F.lit, needs)), F.coalesce("files", F.array().cast("array<string>")))
    partial = runs.filter(F.size(lacks) > 0) if kind == "graphify" else runs.filter("status = 'partial'")
    return union_all([
        finding(partial, f"{kind}_partial_run", F.col("run_id"), "run is not complete"),
        finding(without(latest, "run_id", runs, "run_id"), f"{kind}_latest_mismatch", F.col("run_id"), "latest names a run that is missing"),
    ])


def check_run_graphs(runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Runs whose graph is not whole, or not the one that the run tells the size of. runs: run_id, nodes, edges (numbers); nodes: run_id, id; edges: run_id, id, src, dst."""
    ids = nodes.select("run_id", F.col("id").alias("end"))
    ends = edges.select("run_id", F.explode(F.array("src", "dst")).alias("end"))
    loose = ends.join(ids, ["run_id", "end"], "left_anti").groupBy("run_id").agg(F.count("*").alias("n"))
    told = runs
    for name, rows in (("nodes", nodes), ("edges", edges)):
        told = told.join(rows.groupBy("run_id").agg(F.count("*").alias(f"n_{name}")), "run_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return union_all([
        finding(loose, "graphify_invalid_graph", F.col("run_id"), F.concat(F.lit("ends without a node: "), F.col("n").cast("string"))),
        finding(told.filter("n_nodes != nodes or n_edges != edges"), "graphify_invalid_graph", F.col("run_id"), "other numbers of nodes or edges than the run tells"),
    ])


def check_unreadable(errors: DataFrame, category: str) -> DataFrame:
    """errors: path, error."""
    return finding(errors, category, F.col("path"), F.concat(F.lit("cannot be read: "), "error"))


def check_registry(registry: DataFrame) -> DataFrame:
    """Entries of a registry (workspace_id, root) without an id or a root, and ids that are there twice."""
    blank = F.coalesce(F.trim("workspace_id"), F.lit("")) == ""
    rootless = F.coalesce(F.trim("root"), F.lit("")) == ""
    return union_all([
        finding(registry.filter(blank | rootless), "workspace_registry_invalid", F.coalesce("workspace_id", "root", F.lit("")), "an entry needs an id and a root"),
        finding(repeated(registry.filter(~blank), "workspace_id"), "workspace_registry_invalid", F.col("workspace_id"), "its id is there more than once"),
    ])


def check_workspaces(registry: DataFrame, roots: DataFrame) -> DataFrame:
    """registry: workspace_id, root; roots: root that exists."""
    shared = registry.join(repeated(registry, "root"), "root", "left_semi")
    return union_all([
        finding(without(registry, "root", roots, "root"), "workspace_root_missing", F.col("workspace_id"), F.col("root")),
        finding(shared, "workspace_duplicate_root", F.col("workspace_id"), F.col("root")),
    ])


def check_trees(manifest: DataFrame, trees: DataFrame, nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """manifest: relpath, page_tree; trees: relpath, corrupt; nodes: relpath, node_id, end_offset; bodies: relpath, length."""
    return union_all([
        finding(without(manifest.filter("page_tree is not null"), "relpath", trees, "relpath"), "tree_missing", F.col("relpath"), "no tree"),
        finding(without(trees, "relpath", manifest, "relpath"), "tree_orphan", F.col("relpath"), "not in the manifest"),
        finding(trees.filter("corrupt is not null"), "tree_corrupt", F.col("relpath"), "cannot be parsed"),
        finding(nodes.join(bodies, "relpath").filter("end_offset > length"), "tree_offset_mismatch", F.col("relpath"), F.concat(F.lit("ends after the text: "), "node_id")),
    ])


def check_chunk_sections(chunks: DataFrame, nodes: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """chunks: chunk_id, relpath, tree_node_id, offset; nodes: relpath, node_id, start_offset, end_offset. Only documents with a tree count; with bodies (relpath, length), only those whose sections leave no gap."""
    whole = nodes.select("relpath").distinct()
    if bodies is not None:
        spans = nodes.select("relpath", F.col("start_offset").alias("start"), F.col("end_offset").alias("end")).join(bodies.select("relpath", "length"), "relpath")
        whole = coverage(spans, "relpath", F.col("length")).filter("covered")
    rows = chunks.join(whole, "relpath", "left_semi")
    known = nodes.select("relpath", F.col("node_id").alias("tree_node_id"), "start_offset", "end_offset", F.lit(True).alias("known"))
    rows = rows.join(known, ["relpath", "tree_node_id"], "left")
    reason = F.when(F.col("tree_node_id").isNull(), "missing_tree_node_id").when(F.col("known").isNull(), "unknown_tree_node_id").when((F.col("offset") < F.col("start_offset")) | (F.col("offset") >= F.col("end_offset")), "offset_gap")
    return finding(rows.withColumn("reason", reason).filter("reason is not null"), "tree_node_chunk_gap", F.col("chunk_id"), F.col("reason"))


def check_leases(leases: DataFrame, now: Column) -> DataFrame:
    """resource_key and expires_at of active leases that have run out."""
    return leases.filter((F.col("status") == "active") & (F.col("expires_at") <= now)).select("resource_key", "agent_id", "expires_at")


def check_references(handoffs: DataFrame, things: DataFrame) -> DataFrame:
    """handoff_id, type, value of references to things (type, value) that do not exist. handoffs: handoff_id, references (array of type and value)."""
    return handoffs.select("handoff_id", F.explode("references").alias("r")).select("handoff_id", "r.type", "r.value").join(things, ["type", "value"], "left_anti")


def counts(findings: DataFrame) -> DataFrame:
    """Counts by severity and by category, in one pass: kind, name, n."""
    sets = findings.groupingSets([[F.col("severity")], [F.col("category")]], F.col("severity"), F.col("category")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("category").isNull(), "severity").otherwise("category")
    return sets.select(kind.alias("kind"), F.coalesce("category", "severity").alias("name"), "n")


def exceeds(findings: DataFrame, threshold: str = "error") -> bool:
    """Whether a finding is as severe as the threshold."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return not findings.filter(rank >= SEVERITIES.index(threshold) + 1).isEmpty()


def skip_reason(category: Column) -> Column:
    """Why a finding is not mended."""
    unknown = category.isin("manifest_wiki_mismatch", "wiki_source_mismatch", "dangling_manifest_entry", "manifest_vector_mismatch")
    return F.when(unknown, "manifest_truth_unknown").when(category == "fingerprint_drift", "requires_manual").otherwise("unsupported")


def fix_plan(findings: DataFrame, reasons: bool = False) -> DataFrame:
    """action and target of each finding: the fix that is allowed, or skip; with reasons, why it is skipped."""
    action = (
        F.when(F.col("category").isin("orphan_page", "dead_link", "duplicate_slug"), "rebuild_index")
        .when(F.col("category") == "orphan_vector_chunk", "prune_vectors")
        .when((F.col("category") == "graph_drift") & F.col("message").startswith("orphan_node"), "prune_graph_nodes")
        .when((F.col("category") == "graph_drift") & F.col("message").rlike("^(orphan|dangling)_edge"), "prune_graph_edges")
        .otherwise("skip")
    )
    why = [F.when(action == "skip", skip_reason(F.col("category"))).alias("reason")] if reasons else []
    return findings.select(action.alias("action"), "target", *why)


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).filter("__n = 1").drop("__n")
