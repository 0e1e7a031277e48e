"""Queries of upkeep: lint, incremental refresh, catalogue and workspaces, over tables with holes made on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import catalog, lint, refresh
from lorespark.operators.tables import union_all
from lorespark.plans.registry import query, table


def rel(prefix: str = "doc/"):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files; each 13th can't be read, each 17th has another format."""
    k = F.col("doc_id")
    issue = F.when(k % 13 == 0, "corrupt").when(k % 17 == 0, "unsupported")
    return table(spark, d, "documents").select(rel().alias("relpath"), F.sha2("text", 256).alias("sha256"), F.lit("txt:v1:").alias("parser_fingerprint"), issue.alias("issue"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier run knew: without each 7th document, each 11th with another digest, each 5th with another parser or none, and some that are gone."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    sha = F.when(k % 11 == 0, F.sha2(F.concat(F.lit("old"), "text"), 256)).otherwise(F.sha2("text", 256))
    parser = F.when(k % 10 == 0, "*").when(k % 5 == 0, "txt:v0:").otherwise("txt:v1:")
    known = docs.filter(k % 7 != 0).select(rel().alias("relpath"), sha.alias("sha256"), parser.alias("parser_fingerprint"))
    gone = docs.filter(k % 19 == 0).select(rel("gone/").alias("relpath"), F.sha2("text", 256).alias("sha256"), F.lit("txt:v1:").alias("parser_fingerprint"))
    return known.union(gone)


STATE_SQL = """(select relpath, case when here is null then 'missing' when k % 13 = 0 then 'corrupt' when k % 17 = 0 then 'unsupported' when k % 7 = 0 then 'new' when k % 11 = 0 or k % 5 = 0 then 'stale' else 'unchanged' end state
  from (select 'doc/' || doc_id relpath, doc_id k, 1 here from documents union all select 'gone/' || doc_id, doc_id, null from documents where doc_id % 19 = 0))"""


@query(f"select relpath, state from {STATE_SQL}")
def watch_states(spark: SparkSession, d: str) -> DataFrame:
    return refresh.states(files(spark, d), manifest(spark, d)).select("relpath", "state")


@query(f"select s state, (select count(*) from {STATE_SQL} t where t.state = s) n from unnest(['unchanged', 'new', 'stale', 'missing', 'unsupported', 'corrupt']) u(s)")
def watch_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return refresh.state_counts(refresh.states(files(spark, d), manifest(spark, d)))


@query(f"""with a as (select case state when 'missing' then 'prune:' when 'corrupt' then 'issue:' when 'unsupported' then 'issue:' else 'ingest:' end || relpath action_id, case state when 'missing' then 'prune' when 'corrupt' then 'report_issue' when 'unsupported' then 'report_issue' else 'ingest' end kind,
  case when state in ('corrupt', 'unsupported') then 'skipped' else 'planned' end status, 0::bigint n_depends from {STATE_SQL} where state <> 'unchanged') select * from a union all select 'graphify:build', 'graphify_build', 'planned', (select count(*) from a where kind in ('ingest', 'prune'))""")
def watch_plan_actions(spark: SparkSession, d: str) -> DataFrame:
    steps = refresh.plan(refresh.states(files(spark, d), manifest(spark, d)), prune=True)
    return steps.select("action_id", "kind", "status", "n_depends")


@query(f"""select 'graphify:build' action_id, case state when 'missing' then 'prune:' else 'ingest:' end || relpath depends_on from {STATE_SQL} where state in ('missing', 'new', 'stale')""")
def watch_plan_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return refresh.dependencies(refresh.plan(refresh.states(files(spark, d), manifest(spark, d)), prune=True))


@query(f"""with a as (select case when state in ('corrupt', 'unsupported') then 'skipped' else 'planned' end status from {STATE_SQL} where state <> 'unchanged' union all select 'planned')
  select s status, count(a.status) n from (select unnest(['planned', 'skipped', 'completed', 'failed']) s) left join a on a.status = s group by 1""")
def watch_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return refresh.counts(refresh.plan(refresh.states(files(spark, d), manifest(spark, d)), prune=True), "status", refresh.OUTCOMES)


INGEST_SQL = """select relpath, status from (select 'doc/' || doc_id relpath, case when doc_id % 13 = 0 or doc_id % 17 = 0 then 'failed' when doc_id % 7 = 0 then 'created' when doc_id % 11 = 0 then 'updated' when doc_id % 10 = 0 then 'skipped' when doc_id % 5 = 0 then 'updated' else 'skipped' end status from documents
  union all select 'gone/' || doc_id, 'pruned' from documents where doc_id % 19 = 0)"""


@query(f"""select s status, count(a.status) n from (select unnest(['created', 'updated', 'skipped', 'failed', 'pruned']) s) left join ({INGEST_SQL}) a on a.status = s group by 1""")
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return refresh.counts(refresh.ingest_status(files(spark, d), manifest(spark, d), prune=True), "status", refresh.INGESTED)


@query("""select relpath, status from (select 'doc/' || doc_id relpath, case when doc_id % 13 = 0 or doc_id % 17 = 0 then 'failed' when doc_id % 7 = 0 then 'created' when doc_id % 11 = 0 then 'updated' when doc_id % 10 = 0 then 'skipped' when doc_id % 5 = 0 then 'updated' else 'skipped' end status from documents
  union all select 'gone/' || doc_id, 'pruned' from documents where doc_id % 19 = 0)""")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    return refresh.ingest_status(files(spark, d), manifest(spark, d), prune=True)


@query(f"""with a as (select 'a' || doc_id artifact_id, 'doc/' || doc_id relpath from documents where doc_id % 3 = 0 union all select 'b' || doc_id, 'gone/' || doc_id from documents where doc_id % 38 = 0 union all select 'c' || doc_id, 'never/' || doc_id from documents where doc_id % 50 = 0)
  select artifact_id, 'llm' kind, case when s.relpath is null then 'source_unknown' else 'source_' || state end reason from a left join {STATE_SQL} s using (relpath) where s.relpath is null or state in ('stale', 'missing')""")
def lineage_stale(spark: SparkSession, d: str) -> DataFrame:
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    parts = [docs.filter(c).select(F.concat(F.lit(p), k.cast("string")).alias("artifact_id"), F.lit("llm").alias("kind"), rel(f).alias("relpath")) for c, p, f in ((k % 3 == 0, "a", "doc/"), (k % 38 == 0, "b", "gone/"), (k % 50 == 0, "c", "never/"))]
    return refresh.lineage(refresh.states(files(spark, d), manifest(spark, d)), parts[0].union(parts[1]).union(parts[2]))


@query("""select relpath, artifact_id from (select *, row_number() over (partition by relpath order by created_at desc, artifact_id desc) rn from (select o_custkey relpath, o_orderkey artifact_id, o_orderdate created_at from orders where o_orderkey % 4 = o_custkey % 4)) where rn = 1""")
def resolve_artifacts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("relpath"), (F.col("o_orderkey") % 4).alias("sha256"), F.lit("p").alias("parser_fingerprint"), F.col("o_orderkey").alias("artifact_id"), F.col("o_orderdate").alias("created_at"))
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("relpath"), (F.col("c_custkey") % 4).alias("sha256"), F.lit("p").alias("parser_fingerprint"))
    return refresh.resolve_artifacts(o, now)


@query("""select c_custkey k, case when c_custkey % 3 = 0 then 'new' else 'old' end as value from customer""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("value"))
    return refresh.upsert(old, old.filter("k % 3 = 0").withColumn("value", F.lit("new")), "k")


def wiki(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    pages = docs.filter(k % 7 != 0).select(rel("p").alias("slug"), F.when(k % 4 == 0, "llm_wiki").otherwise("ingest").alias("origin"), F.when(k % 29 == 0, "nowhere").otherwise(rel()).alias("source_relpath"))
    index = docs.filter(k % 5 != 0).select(rel("p").alias("slug")).union(docs.filter(k % 31 == 0).select(rel("p").alias("slug")))
    return pages, index


WIKI_SQL = """p as (select 'p' || doc_id slug, doc_id k from documents where doc_id % 7 <> 0), i as (select 'p' || doc_id slug from documents where doc_id % 5 <> 0 union all select 'p' || doc_id from documents where doc_id % 31 = 0)"""


@query(f"""with {WIKI_SQL} select 'orphan_page' category, slug target from p where slug not in (select slug from i) union all select 'dead_link', slug from i where slug not in (select slug from p) union all select 'duplicate_slug', slug from i group by slug having count(*) > 1""")
def lint_orphans(spark: SparkSession, d: str) -> DataFrame:
    return lint.check_wiki(*wiki(spark, d)).select("category", "target")


def entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").filter(k % 3 != 0).select(rel().alias("relpath"), F.array(rel("p")).alias("wiki_pages"), F.array(rel("v"), rel("w")).alias("vector_ids"), F.array(rel("n")).alias("graph_nodes"), F.array(rel("e")).alias("graph_edges"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 11 != 0").select(rel().alias("relpath"))


@query("""select 'dangling_manifest_entry' category, 'doc/' || doc_id target from documents where doc_id % 3 <> 0 and doc_id % 11 = 0 union all select 'manifest_wiki_mismatch', 'doc/' || doc_id from documents where doc_id % 3 <> 0 and doc_id % 7 = 0
  union all select 'orphan_raw_source', 'doc/' || doc_id from documents where doc_id % 11 <> 0 and doc_id % 3 = 0 union all select 'wiki_source_mismatch', 'p' || doc_id from documents where doc_id % 7 <> 0 and doc_id % 4 <> 0 and (doc_id % 3 = 0 or doc_id % 29 = 0)""")
def lint_dangling(spark: SparkSession, d: str) -> DataFrame:
    return lint.check_sources(entries(spark, d), raw(spark, d), wiki(spark, d)[0]).select("category", "target")


@query("""select 'manifest_vector_mismatch' category, 'doc/' || doc_id target from documents where doc_id % 3 <> 0 and doc_id % 2 = 0 union all select 'orphan_vector_chunk', 'w' || doc_id from documents where doc_id % 2 = 1 and doc_id % 3 = 0 union all select 'orphan_vector_chunk', 'v' || doc_id from documents where doc_id % 3 = 0""")
def lint_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select(rel("v").alias("chunk_id")).union(docs.filter("doc_id % 2 = 1").select(rel("w").alias("chunk_id")))
    return lint.check_vectors(entries(spark, d), chunks).select("category", "target")


@query("""select 'missing_node' what, 'n' || doc_id target from documents where doc_id % 3 <> 0 and doc_id % 9 = 2 union all select 'missing_edge', 'e' || doc_id from documents where doc_id % 3 <> 0 and doc_id % 8 = 1
  union all select 'orphan_node', 'n' || doc_id from documents where doc_id % 3 = 0 and doc_id % 9 <> 2 union all select 'orphan_edge', 'e' || doc_id from documents, unnest([1, 2]) where doc_id % 3 = 0 and doc_id % 8 <> 1
  union all select 'dangling_edge', 'e' || doc_id from documents, unnest([1, 2]) where doc_id % 8 <> 1 and doc_id % 9 = 2""")
def lint_graph_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    nodes = docs.filter("doc_id % 9 != 2").select(rel("n").alias("id"), F.array(rel()).alias("source_relpaths"))
    edges = docs.filter("doc_id % 8 != 1").select(rel("e").alias("id"), rel("n").alias("src"), rel("n").alias("dst"), rel().alias("source_relpath"))
    return lint.check_graph(entries(spark, d), nodes, edges).select(F.regexp_extract("message", "^[a-z_]+", 0).alias("what"), "target")


@query("""select 'doc/' || doc_id target from documents where doc_id % 7 <> 0 and doc_id % 10 <> 0 and doc_id % 5 = 0""")
def lint_drift(spark: SparkSession, d: str) -> DataFrame:
    return lint.check_fingerprints(manifest(spark, d), F.lit("txt:v1:")).select("target")


@query("""select 'trees' kind, category, target from (select 'tree_missing' category, 'doc/' || doc_id target from documents where doc_id % 3 <> 0 and doc_id % 6 = 1 union all select 'tree_orphan', 'doc/' || doc_id from documents where doc_id % 3 = 0 and doc_id % 6 <> 1
  union all select 'tree_corrupt', 'doc/' || doc_id from documents where doc_id % 6 <> 1 and doc_id % 23 = 0 union all select 'tree_offset_mismatch', 'doc/' || doc_id from documents where n_chars < 500)
  union all select 'chunks', 'missing_tree_node_id', 'v' || doc_id from documents where doc_id % 4 = 0 union all select 'chunks', 'unknown_tree_node_id', 'v' || doc_id from documents where doc_id % 4 = 1 union all select 'chunks', 'offset_gap', 'v' || doc_id from documents where doc_id % 4 = 2""")
def lint_trees(spark: SparkSession, d: str) -> DataFrame:
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    trees = docs.filter(k % 6 != 1).select(rel().alias("relpath"), F.when(k % 23 == 0, "{").alias("corrupt"))
    nodes = docs.select(rel().alias("relpath"), F.lit("n1").alias("node_id"), F.lit(0).alias("start_offset"), F.lit(500).alias("end_offset"))
    bodies = docs.select(rel().alias("relpath"), F.col("n_chars").alias("length"))
    a = lint.check_trees(entries(spark, d).withColumn("page_tree", F.col("relpath")), trees, nodes, bodies).select(F.lit("trees").alias("kind"), "category", "target")
    at = F.when(k % 4 == 1, "n9").when(k % 4 != 0, "n1")
    chunks = docs.select(rel("v").alias("chunk_id"), rel().alias("relpath"), at.alias("tree_node_id"), F.when(k % 4 == 2, 700).otherwise(10).alias("offset"))
    return a.union(lint.check_chunk_sections(chunks, nodes).select(F.lit("chunks"), F.col("message"), "target"))


@query(f"""with {WIKI_SQL}, f as (select 'orphan_page' category, 'warning' severity from p where slug not in (select slug from i) union all select 'dead_link', 'warning' from i where slug not in (select slug from p) union all select 'duplicate_slug', 'warning' from (select slug from i group by slug having count(*) > 1)
  union all select 'fingerprint_drift', 'info' from documents where doc_id % 7 <> 0 and doc_id % 10 <> 0 and doc_id % 5 = 0) select 'severity' kind, severity as name, count(*) n from f group by 2 union all select 'category', category, count(*) from f group by 2""")
def lint_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    found = union_all([lint.check_wiki(*wiki(spark, d)), lint.check_fingerprints(manifest(spark, d), F.lit("txt:v1:"))])
    return lint.counts(found)


@query(f"""with {WIKI_SQL}, f as (select slug from p where slug not in (select slug from i) union all select slug from i where slug not in (select slug from p) union all select slug from i group by slug having count(*) > 1) select 'rebuild_index' as action, count(*) n, count(distinct slug) n_targets from f
  union all select 'skip', count(*), count(*) from documents where doc_id % 7 <> 0 and doc_id % 10 <> 0 and doc_id % 5 = 0""")
def lint_fix_plan(spark: SparkSession, d: str) -> DataFrame:
    found = union_all([lint.check_wiki(*wiki(spark, d)), lint.check_fingerprints(manifest(spark, d), F.lit("txt:v1:"))])
    return lint.fix_plan(found).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))


@query("""select o_orderkey id, list_filter([case when o_orderstatus not in ('F', 'O') then 'label' end, case when o_totalprice > 100000 then 'confidence' end, case when o_orderkey % 5 = 0 then 'relation_type' end, case when o_orderkey % 3 = 0 then 'self_relation' end, case when o_orderkey % 4 = 0 then 'unknown_entity' end], lambda x: x is not null) errors from orders""")
def extraction_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus").isin("F", "O"), "risk").otherwise("none")
    relation = F.struct(F.lit("a").alias("source"), F.when(k % 3 == 0, "a").otherwise("b").alias("target"), F.when(k % 5 == 0, "likes").otherwise("owns").alias("type"))
    more = F.struct(F.lit("a").alias("source"), F.when(k % 4 == 0, "zz").otherwise("b").alias("target"), F.lit("owns").alias("type"))
    x = table(spark, d, "orders").select(k.alias("id"), label.alias("label"), F.when(F.col("o_totalprice") > 100000, 2.0).otherwise(0.5).alias("confidence"), F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("b").alias("id"))).alias("entities"), F.array(relation, more).alias("relations"))
    return catalog.extraction_errors(x).select("id", "errors")


@query("""select c_custkey k, case c_custkey % 4 when 0 then 'create' when 1 then 'conflict' when 2 then 'already_applied' else 'update' end as operation from customer""")
def synthesis_operations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    artifacts = table(spark, d, "customer").select(k.cast("string").alias("artifact_id"), F.concat(F.lit("r"), k.cast("string")).alias("relpath"), F.array(F.lit("file.txt"), F.concat(F.lit("Entity "), k.cast("string"))).alias("entities"), F.array(F.lit("fact")).alias("facts"), F.lit("sum").alias("summary"))
    made = catalog.synthesize(artifacts)
    key = F.col("artifact_id").cast("int")
    pages = made.filter(key % 4 != 0).select(F.col("target_slug").alias("slug"), F.when(key % 4 == 1, "ingest").otherwise("llm_wiki").alias("origin"), F.col("relpath").alias("source_relpath"), F.when(key % 4 == 2, F.col("body")).otherwise("other").alias("body"))
    return catalog.apply_operation(made, pages).join(made.select("candidate_id", F.col("artifact_id").cast("long").alias("k")), "candidate_id").select("k", "operation")


@query("""with e as (select c_nationkey ws, c_mktsegment f, count(*) n, max(c_custkey) m from customer group by 1, 2) select ws::varchar workspace_id, coalesce(sum(n), 0)::bigint sources, string_agg(f || '=' || n, ',' order by f) formats, max(m) last_ingest, count(*) over (partition by ws % 20) > 1 duplicate from e group by ws""")
def workspace_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("workspace_id"), F.col("c_mktsegment").alias("format"), F.col("c_custkey").alias("ingested_at"))
    reg = e.select("workspace_id").distinct().withColumn("root", F.concat(F.lit("/r/"), (F.col("workspace_id").cast("int") % 20).cast("string")))
    out = catalog.workspace_status(e, reg)
    text = F.array_join(F.transform(F.map_entries("formats"), lambda x: F.concat(x.getField("key"), F.lit("="), x.getField("value").cast("string"))), ",")
    return out.select("workspace_id", "sources", text.alias("formats"), F.col("last_ingest"), "duplicate")


@query("""select 'doc/' || doc_id relpath, list_filter([case when doc_id % 11 = 0 then 'raw_source_missing' end, case when doc_id % 7 = 0 then 'wiki_page_missing' end], lambda x: x is not null) issues, case when doc_id % 11 = 0 or doc_id % 7 = 0 then 'degraded' else 'ok' end status from documents where doc_id % 3 <> 0""")
def catalog_issues(spark: SparkSession, d: str) -> DataFrame:
    return catalog.issues(entries(spark, d).select("relpath", "wiki_pages"), raw(spark, d), wiki(spark, d)[0]).select("relpath", "issues", "status")


@query("""select k, case when k % 2 = 0 then 'graphify_partial_run' else 'graphify_latest_mismatch' end category from (select c_custkey k from customer where c_custkey % 6 in (0, 1))""")
def lint_runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    base = table(spark, d, "customer")
    full = F.array(*map(F.lit, lint.GRAPHIFY_FILES))
    runs = base.filter(k % 2 == 0).select(k.cast("string").alias("run_id"), F.lit("done").alias("status"), F.when(k % 6 == 0, F.array(F.lit("graph.json"))).otherwise(full).alias("files"))
    latest = base.filter(k % 6 == 1).select(k.cast("string").alias("run_id"))
    return lint.check_runs(runs, latest, "graphify").select(F.col("target").cast("long").alias("k"), "category")
