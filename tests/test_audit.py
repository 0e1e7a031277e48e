"""Lint over runs, artifacts, candidates and registries; the log; the manifest made anew; front matter; rankings."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark import audit
from lorespark.engine import Engine
from lorespark.functions import text as T
from lorespark.operators import lint, retrieval
from lorespark.services import Workspaces
from lorespark.sources import files, sinks


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("audit")
    root = top / "in"
    root.mkdir()
    (root / "a.md").write_text("# Alpha plan\n\nAlpha depends on Beta.\n")
    (root / "b.txt").write_text("Gamma impacts Delta.\n")
    engine = Engine(spark, str(top / "kb"))
    assert engine.refresh(str(root), mode="execute").filter("outcome = 'completed'").count() == 3
    engine.synthesize()
    engine.apply()
    return engine, root


def found(engine):
    return {(r.category, r.target) for r in engine.lint().collect()}


def kept(engine):
    """Findings over what is kept beside the store."""
    parts = [audit.artifact_findings(engine.spark, engine.root), audit.synthesis_findings(engine.spark, engine.candidates, engine.wiki_pages), audit.graph_run_findings(engine.spark, engine.root, engine.graph_runs), audit.watch_findings(engine.spark, engine.root)]
    return {(r.category, r.target) for part in parts for r in part.collect()}


def spoil(folder):
    """Rubbish in place of one file of a table; what puts it back."""
    file = next(p for p in sorted(Path(folder).rglob("*.parquet")))
    good, check = file.read_bytes(), file.with_name(f".{file.name}.crc")
    file.write_bytes(b"rubbish")
    check.unlink(missing_ok=True)
    return lambda: file.write_bytes(good)


def test_nothing_to_find(kb):
    engine, _ = kb
    assert found(engine) == set()
    told = {(r.event, r.status, r.target) for r in engine.log().collect()}
    assert told == {("ingest", "created", "a.md"), ("ingest", "created", "b.txt")}


def test_front_matter_of_made_pages(kb):
    engine, _ = kb
    pages = engine.wiki_pages.filter("origin = 'llm_wiki'").select("slug", "body", T.front_matter(F.col("text")).alias("m"), T.without_front_matter(F.col("text")).alias("rest")).collect()
    known = {r.candidate_id: r for r in engine.candidates.read().collect()}
    assert pages and all(p.m["slug"] == p.slug and p.rest == p.body and known[p.m["wiki_candidate_artifact_id"]].artifact_id == p.m["extraction_artifact_id"] for p in pages)


def test_runs_and_artifacts(spark, kb):
    engine, _ = kb
    run = engine.graph_runs.read().first().run_id
    back = spoil(f"{engine.root}/graphify/{run}/edges")
    assert {c for c, _ in kept(engine)} == {"graphify_corrupt_upstream_artifact"}
    back()
    # a run that did not end, one whose graph is not whole, and a newest entry without tables
    spark.createDataFrame([("x",)], "id string").write.parquet(f"{engine.root}/graphify/open/nodes")
    for part in ("nodes", "edges", "communities"):
        rows = spark.read.parquet(f"{engine.root}/graphify/{run}/{part}")
        (rows.limit(1) if part == "nodes" else rows).write.parquet(f"{engine.root}/graphify/loose/{part}")
    own = engine.graph_runs.read().drop("at")
    engine.graph_runs.upsert(own.withColumn("run_id", F.lit("loose")).withColumn("at", F.current_timestamp()), "run_id")
    engine.graph_runs.upsert(own.withColumn("run_id", F.lit("lost")).withColumn("at", F.current_timestamp() + F.expr("interval 1 day")), "run_id")
    assert kept(engine) == {("graphify_partial_run", "open"), ("graphify_invalid_graph", "loose"), ("graphify_latest_mismatch", "lost")}
    for name in ("loose", "lost"):
        engine.graph_runs.delete(spark.createDataFrame([(name,)], "run_id string"), "run_id")
    for name in ("loose", "open"):
        Path(engine.root, "graphify", name).rename(Path(engine.root, f"away-{name}"))
    # refreshes: one that stopped half way, one that tells an outcome that there is not, one without a plan that is the newest
    plans, runs = (f"{engine.root}/watch/{k}" for k in ("plans", "runs"))
    one, two = spark.read.parquet(plans).limit(1), spark.read.parquet(runs).limit(1)
    one.withColumn("run_id", F.lit("half")).write.mode("append").parquet(plans)
    one.withColumn("run_id", F.lit("odd")).write.mode("append").parquet(plans)
    two.withColumns({"run_id": F.lit("odd"), "outcome": F.lit("maybe")}).write.mode("append").parquet(runs)
    two.withColumns({"run_id": F.lit("bare"), "at": F.current_timestamp() + F.expr("interval 1 day")}).write.mode("append").parquet(runs)
    assert kept(engine) == {("watch_partial_run", "half"), ("watch_artifact_invalid", "odd"), ("watch_latest_mismatch", "bare")}
    back = spoil(runs)
    assert {c for c, _ in kept(engine)} == {"watch_artifact_corrupt"}
    back()
    # extractions
    path = f"{engine.root}/artifacts"
    spark.read.parquet(path).limit(1).withColumns({"artifact_id": F.lit("bad"), "label": F.lit("nonsense")}).write.mode("append").parquet(path)
    assert ("llm_artifact_invalid", "bad") in kept(engine)
    back = spoil(path)
    assert "llm_artifact_corrupt" in {c for c, _ in kept(engine)}
    back()
    # candidates
    gone = engine.candidates.read().orderBy("target_slug").limit(1).select("candidate_id").collect()
    was, schema = engine.candidates.read().collect(), engine.candidates.read().schema
    engine.candidates.delete(spark.createDataFrame(gone, "candidate_id string"), "candidate_id")
    assert "wiki_synthesis_frontmatter_invalid" in {c for c, _ in kept(engine)}
    engine.candidates.write(spark.createDataFrame(was, schema).withColumn("title", F.when(F.col("candidate_id") != gone[0].candidate_id, F.col("title")).otherwise("")))
    assert ("wiki_candidate_artifact_invalid", gone[0].candidate_id) in kept(engine)
    back = spoil(engine.candidates.folder())
    assert "wiki_candidate_artifact_corrupt" in {c for c, _ in kept(engine)}
    back()


def test_manifest_made_anew(spark, kb):
    engine, _ = kb
    rows = {t: engine.store.read(t, "b.txt") for t in engine.store.tables}
    want = rows["sources"].first().asDict()
    wrong = rows["sources"].withColumns({"wiki_pages": F.array(F.lit("no-such-page")), "vector_ids": F.array().cast("array<string>"), "page_tree": F.lit(None).cast("long")})
    engine.store.commit(rows | {"sources": wrong.select(rows["sources"].columns)}, spark.createDataFrame([("b.txt",)], "relpath string"))
    assert {"manifest_wiki_mismatch", "orphan_vector_chunk"} <= {c for c, _ in found(engine)}
    assert [r.relpath for r in engine.rebuild_manifest().collect()] == ["b.txt"] and engine.rebuild_manifest().count() == 0
    assert engine.store.read("sources", "b.txt").first().asDict() == want


def test_fixes_are_logged(spark, kb, monkeypatch):
    engine, root = kb
    rows = {t: engine.store.read(t, "a.md") for t in engine.store.tables}
    rows["wiki_index"] = spark.createDataFrame([("gone", "t", "s", "a.md")], "slug string, title string, summary string, source_relpath string")
    engine.store.commit(rows)
    (root / "b.txt").unlink()
    with monkeypatch.context() as m:
        m.setattr(engine, "rebuild_index", lambda: 1 / 0)
        out = {(r.action, r.reason, r.outcome) for r in engine.fix(apply=True).collect()}
    assert {("rebuild_index", None, "apply_failed"), ("skip", "manifest_truth_unknown", "skipped")} <= out
    assert {r.outcome for r in engine.fix(apply=True).filter("action = 'rebuild_index'").collect()} == {"success"}
    told = {(r.target, r.action, r.outcome) for r in engine.log().filter("event = 'lint'").collect()}
    assert {("gone", "rebuild_index", "apply_failed"), ("gone", "rebuild_index", "success")} <= told
    assert lint.check_wiki(engine.wiki_pages, engine.wiki_index).count() == 0


def test_reranked_answers(spark, kb):
    engine, _ = kb
    seen = []

    def last_first(rows):
        seen.extend(rows.collect())
        return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("index").cast("int")), asc=False).alias("indices"))

    plain = engine.query("what does Alpha depend on").first()
    ranked = engine.query("what does Alpha depend on", reranker=last_first).first()
    order = sorted(seen, key=lambda r: r["index"])
    assert len(order) > 1 and plain.answer == order[0].text and ranked.answer == order[-1].text and ranked.confidence == order[-1].score
    # a ranking that names what is not there counts as none
    odd = lambda rows: rows.select("query_id", F.array(F.lit(0), F.lit(99)).alias("indices")).distinct()
    assert engine.query("what does Alpha depend on", reranker=odd).first().answer == plain.answer


def test_rankings_that_fit(spark):
    first = spark.createDataFrame([(q, i) for q in (1, 2, 3, 4) for i in range(3)], "query_id long, index int")
    ranking = spark.createDataFrame([(1, [2, 0]), (2, [1, 1]), (3, [0, 3]), (4, [0]), (4, [1]), (5, [0])], "query_id long, indices array<int>")
    assert [(r.query_id, r.indices) for r in retrieval.valid_ranking(ranking, first).collect()] == [(1, [2, 0])]


def test_registry(spark, tmp_path):
    w = Workspaces(spark, str(tmp_path / "registry"))
    assert w.lint().count() == 0
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("Alpha depends on Beta.\n")
    w.register("one", str(tmp_path / "kb1"))
    w.use("one").ingest(str(root))
    assert w.lint().count() == 0
    w.register("two", str(tmp_path / "kb1"))
    w.register("three", str(tmp_path / "kb3"))
    w.register("four", "")
    out = {(r.category, r.target) for r in w.lint().collect()}
    assert out == {("workspace_duplicate_root", "one"), ("workspace_duplicate_root", "two"), ("workspace_root_missing", "three"), ("workspace_registry_invalid", "four")}
    spoil(w.table.folder())
    assert {r.category for r in w.lint().collect()} == {"workspace_registry_corrupt"}


def test_front_matter(spark, tmp_path):
    def of(text):
        return spark.createDataFrame([(text,)], "t string").select(T.front_matter(F.col("t")).alias("m"), T.without_front_matter(F.col("t")).alias("b")).first()

    page = of("---\ntitle: \"A \\\"b\\\": c\\\\d 漢\"\nn: 5, 6\nn: 7\nplain: x: y\nnone\n---\n\nbody\n---\n")
    assert page.m == {"title": 'A "b": c\\d 漢', "n": "5, 6", "plain": "x: y"} and page.b == "body\n---\n"
    assert of("no head").m == {} and of("no head").b == "no head" and of("").m == {} and of(None).m is None
    rows = spark.createDataFrame([("s", 'He said "no": \\ it', "sum", "the body", "a/b.txt", "ingest", {"k": 'v "w"'})], "slug string, title string, summary string, body string, relpath string, origin string, metadata map<string,string>")
    text = sinks.page_text(rows).first().text
    (tmp_path / "s.md").write_text(text, encoding="utf-8")
    back = files.read_wiki(spark, str(tmp_path)).first()
    assert back.slug == "s" and back.body == "the body" and back.metadata == {"slug": "s", "title": 'He said "no": \\ it', "summary": "sum", "source": "a/b.txt", "origin": "ingest", "k": 'v "w"'}
    assert json.loads(text.split("title: ")[1].split("\n")[0]) == 'He said "no": \\ it'
