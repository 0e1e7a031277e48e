import zipfile

import pytest
from pyspark.sql import functions as F

from lorespark.engine import Engine
from lorespark.sources import files, sinks
from lorespark.streaming import ledger as stream

W = 'xmlns:w="w"'


def office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "project-atlas.txt").write_text("Project Atlas depends on Server Nine.\nIt has a summary of risk.\n")
    (root / "sub/notes.md").write_text("---\nx: y\n---\n\n# Title here\n\nintro\n\n## Part\n\nAtlas impacts Sales.\n")
    (root / "bad.pdf").write_bytes(b"not a pdf")
    (root / "empty.txt").write_bytes(b"")
    (root / "skip.csv").write_text("a,b")
    (root / "latin.txt").write_bytes(b"caf\xe9 au lait")
    office(root / "a.docx", {"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v|1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    office(root / "b.xlsx", {"xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c/></row><row><c><v>5</v></c><c><f>A1+1</f></c></row></sheetData></worksheet>'})
    office(root / "c.pptx", {"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<s xmlns:a="a"><sp><nvPr><ph type="title"/></nvPr><a:p><a:t>Deck</a:t></a:p></sp><sp><a:p><a:t>Point</a:t></a:p></sp></s>', "ppt/notesSlides/notesSlide1.xml": "<n><t>Say it</t></n>"})
    (root / "broken.docx").write_bytes(b"PK\x03\x04rubbish")
    return root


def test_scan_and_parse(spark, folder):
    found = files.checked(files.discover(spark, str(folder)))
    issue = {r.relpath: r.issue for r in found.select("relpath", "issue").collect()}
    assert issue["bad.pdf"] == "corrupt" and issue["skip.csv"] == "unsupported" and issue["sub/notes.md"] is None
    text = {r.relpath: r for r in files.read_text(found).collect()}
    assert text["sub/notes.md"].title == "Title here" and text["project-atlas.txt"].title == "project atlas" and "caf" in text["latin.txt"].body
    seg = {}
    for r in files.read_office(found).orderBy("relpath", "seg_idx").collect():
        seg.setdefault(r.relpath, []).append((r.kind, r.text))
    assert seg["a.docx"] == [("heading", "# Head"), ("paragraph", "Body text"), ("table_row", "| k |\n| v\\|1 |")]
    assert seg["b.xlsx"] == [("sheet_header", "## One"), ("table_row", "| name | col_2 |\n| 5 | =A1+1 |")]
    assert seg["c.pptx"] == [("slide_header", "## Slide 1"), ("heading", "### Deck"), ("paragraph", "Point"), ("notes", "Say it")]
    assert seg["broken.docx"][0][0] == "error"


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "kb"))
    first = {r.relpath: r.status for r in engine.ingest(str(folder)).collect()}
    assert first["project-atlas.txt"] == "created" and first["bad.pdf"] == "failed"
    out = engine.query("what does Project Atlas depend on").first()
    assert "Server Nine" in out.answer or "Atlas" in out.answer
    assert engine.query("zzzz qqqq").first().confidence == 0
    assert first["broken.docx"] == "failed" and [r.category for r in engine.lint().collect()] == ["orphan_raw_source"]  # broken.docx
    # sections by format: slides and sheets, headings, one section for plain text
    tree = {}
    for r in engine.tree_nodes.orderBy("relpath", "preorder").collect():
        tree.setdefault(r.relpath, []).append((r.node_id, r.section_path))
    assert tree["sub/notes.md"] == [("n1", "Title here"), ("n1.1", "Title here > Part")] and tree["project-atlas.txt"] == [("n1", "project atlas")]
    assert tree["b.xlsx"] == [("n1", "One")] and tree["c.pptx"] == [("n1", "Slide 1"), ("n1.1", "Slide 1 > Deck")] and tree["a.docx"] == [("n1", "Head")]
    assert engine.chunks.filter("tree_node_id is null").count() == 0
    assert {(r.header, r.section_path) for r in engine.chunks.filter("relpath = 'b.xlsx'").collect()} == {("## One", "One")}
    inside = engine.graph_edges.filter("relation = 'belongs_to' and source_relpath = 'sub/notes.md'").collect()
    assert [r.evidence for r in inside] == ["Section: Title here > Part"]
    assert engine.query("Atlas impacts Sales").first().section_path in ("", "Title here > Part")
    (folder / "project-atlas.txt").write_text("Project Atlas depends on Server Ten.\n")
    (folder / "latin.txt").unlink()
    plan = {r.action_id: r.status for r in engine.refresh(str(folder), prune=True).collect()}
    assert plan["ingest:project-atlas.txt"] == "planned" and plan["prune:latin.txt"] == "planned" and "graphify:build" in plan
    again = {r.relpath: r.status for r in engine.ingest(str(folder), prune=True).collect()}
    assert again["project-atlas.txt"] == "updated" and again["sub/notes.md"] == "skipped" and again["latin.txt"] == "pruned"
    assert engine.chunks.filter("relpath = 'latin.txt'").count() == 0
    assert engine.chunks.filter("relpath = 'project-atlas.txt' and text like '%Ten%'").count() == 1
    nodes, edges, parts = engine.graph_analytics()
    assert "graph" in sinks.graph_html(nodes, edges) and "# Graph report" in sinks.graph_report(edges, parts, engine.lint())
    assert engine.catalog().count() == engine.sources.count()


def test_failed_updates_and_true_outcomes(spark, tmp_path, monkeypatch):
    """A file that cannot be parsed any more keeps its document; a refresh tells what ran."""
    root = tmp_path / "in"
    root.mkdir()
    good = {"word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Alpha depends on Beta.</w:t></w:r></w:p><w:p><w:r><w:t># no heading</w:t></w:r></w:p></w:body></w:document>'}
    office(root / "a.docx", good)
    (root / "b.txt").write_text("專案依賴伺服器。It doesn't matter (much), 50% off - a/b.\n")
    engine = Engine(spark, str(tmp_path / "kb"))
    engine.ingest(str(root))
    assert engine.chunks.filter("relpath = 'b.txt'").first().text == "專案依賴伺服器。It doesn't matter (much),50%off-a/b."
    assert [r.title for r in engine.tree_nodes.filter("relpath = 'a.docx'").collect()] == ["a"]  # a paragraph is no heading
    (root / "a.docx").write_bytes(b"PK\x03\x04rubbish")
    (root / "c.txt").write_text("Gamma depends on Delta.\n")
    assert {r.relpath: r.status for r in engine.ingest(str(root)).collect()} == {"a.docx": "failed", "b.txt": "skipped", "c.txt": "created"}
    assert {r.relpath for r in engine.sources.collect()} == {"a.docx", "b.txt", "c.txt"} and engine.wiki_pages.filter("source_relpath = 'a.docx'").count() == 1
    (root / "b.txt").write_text("Beta depends on Zeta.\n")
    out = {r.action_id: r.outcome for r in engine.refresh(str(root), mode="execute").collect()}
    assert out == {"ingest:a.docx": "failed", "ingest:b.txt": "completed", "graphify:build": "completed"}
    # a graph build that raises: what was ingested stays so
    (root / "b.txt").write_text("Beta depends on Theta.\n")
    monkeypatch.setattr(engine, "graph_analytics", lambda keep: 1 / 0)
    rows = {r.action_id: (r.outcome, r.error) for r in engine.refresh(str(root), mode="execute").collect()}
    assert rows["ingest:b.txt"] == ("completed", None) and rows["graphify:build"] == ("failed", "division by zero")
    # an ingest that raises: nothing happened
    (root / "b.txt").write_text("Beta depends on Kappa.\n")
    monkeypatch.setattr(engine, "ingest", lambda *_: 1 / 0)
    rows = {r.action_id: r.outcome for r in engine.refresh(str(root), mode="execute").collect()}
    assert rows == {"ingest:a.docx": "failed", "ingest:b.txt": "failed", "graphify:build": "skipped"}
    # an empty file has no document
    monkeypatch.undo()
    (root / "c.txt").write_text(" \n")
    assert {r.relpath: r.status for r in engine.ingest(str(root)).collect()}["c.txt"] == "skipped" and engine.sources.filter("relpath = 'c.txt'").count() == 0


TABLES = {"docs": "relpath", "parts": "doc"}


def rows_of(spark, ids, text):
    docs = spark.createDataFrame([(i, text) for i in ids], "relpath string, text string").coalesce(1)
    return {"docs": docs, "parts": docs.filter("relpath < 'm'").select(F.col("relpath").alias("doc"), F.length("text").alias("n"))}


def test_store_over_many_commits(spark, tmp_path):
    """Commits against a plain dictionary, with compaction on the way; bounded reads, snapshots, pins, digests."""
    import random

    rng = random.Random(5)
    store = sinks.Store(spark, str(tmp_path / "s"), TABLES, most_deltas=6, range_docs=8)
    want, pinned, seen = {}, None, None
    names = [f"{c}{k}" for c in "azmq" for k in range(10)]
    for k in range(26):
        ids = rng.sample(names, 3)
        gone = [x for x in rng.sample(names, 2) if x not in ids]
        store.commit(rows_of(spark, ids, f"t{k}"), spark.createDataFrame([(x,) for x in gone], "relpath string").coalesce(1))
        want |= dict.fromkeys(ids, f"t{k}")
        for x in gone:
            want.pop(x, None)
        if k == 8:
            pinned, seen = store.pinned(), dict(want)
            at = pinned.__enter__()
    assert {r.relpath: r.text for r in store.read("docs").collect()} == want
    assert {r.doc: r.n for r in store.read("parts").collect()} == {x: len(t) for x, t in want.items() if x < "m"}
    assert {r.relpath for r in store.live().collect()} == set(want) and store.verify() == []
    ranges, deltas = store.state()
    assert len(deltas) < 6 and 3 < len(ranges) <= 12 and len(store.folders("docs")) <= len(ranges) + len(deltas)
    one = next(iter(want))
    assert len(store.state(relpath=one)[0]) == 1 and [r.text for r in store.read("docs", one).collect()] == [want[one]]
    # ranges without changed documents are not written again
    store.compact()
    before = {(r["folder"], r["part"]) for r in store.state()[0]}
    store.commit(rows_of(spark, [min(want)], "new"))
    store.compact()
    after = {(r["folder"], r["part"]) for r in store.state()[0]}
    assert len(before & after) >= len(before) - 2 and {r.relpath: r.text for r in store.read("docs").collect()} == want | {min(want): "new"}
    # the pinned snapshot stays until its reader is done
    store.expire()
    assert {r.relpath: r.text for r in store.read("docs", at=at).collect()} == seen
    pinned.__exit__(None, None, None)
    store.expire()
    assert store.vacuum(min_age=0) > 0 and len(store.commits()) == 1
    with pytest.raises(ValueError):
        store.read("docs", at=at)
    assert {r.relpath: r.text for r in store.read("docs").collect()} == want | {min(want): "new"} and store.verify() == []


def test_racing_writers(spark, tmp_path):
    """Of writers from one state one wins, in the store and in a table of versions; a crash before the last step changes nothing."""
    from concurrent.futures import ThreadPoolExecutor

    store = sinks.Store(spark, str(tmp_path / "s"), TABLES)
    store.commit(rows_of(spark, ["a"], "t"))

    def write(k):
        try:
            return store.commit(rows_of(spark, [f"b{k}"], "t"), after=1)
        except sinks.Conflict:
            return "late"

    with ThreadPoolExecutor(4) as pool:
        assert sorted(map(str, pool.map(write, range(4)))) == ["True", "late", "late", "late"]
    assert store.live().count() == 2
    table = sinks.VersionedTable(spark, str(tmp_path / "v"))
    with ThreadPoolExecutor(4) as pool:  # each adds its row to what the ones before it made
        list(pool.map(lambda k: table.upsert(spark.createDataFrame([(k, "x")], "k int, v string"), "k"), range(4)))
    assert {r.k for r in table.read().collect()} == {0, 1, 2, 3} and table.version() == 4

    def crash(*_):
        raise OSError

    publish, store._publish = store._publish, crash
    for step in (lambda: store.commit(rows_of(spark, ["c"], "t")), store.compact):
        with pytest.raises(OSError):
            step()
    store._publish = publish
    assert store.live().count() == 2 and store.latest() == 2
    # a batch of a stream counts once, whatever came between
    assert store.commit(rows_of(spark, ["d"], "t"), stream=("files", 0)) and not store.commit(rows_of(spark, ["d"], "other"), stream=("files", 0))
    store.compact()
    assert not store.commit(rows_of(spark, ["d"], "other"), stream=("files", 0)) and store.commit(rows_of(spark, ["d"], "next"), stream=("files", 1))
    assert [r.text for r in store.read("docs", "d").collect()] == ["next"]


def test_store_of_an_engine(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("# Same title\n\nAlpha depends on Beta.\n")
    engine = Engine(spark, str(tmp_path / "kb"))
    engine.ingest(str(root))
    (root / "b.md").write_text("# Same title\n\nGamma depends on Delta.\n")
    engine.ingest(str(root))
    assert {r.source_relpath: r.slug for r in engine.wiki_pages.collect()} == {"a.md": "same-title", "b.md": "same-title-2"}
    # an update keeps its slug, and only its own rows are written
    (root / "a.md").write_text("# Same title\n\nAlpha depends on Epsilon.\n")
    assert {r.relpath: r.status for r in engine.ingest(str(root)).collect()} == {"a.md": "updated", "b.md": "skipped"}
    assert {r.source_relpath: r.slug for r in engine.wiki_pages.collect()} == {"a.md": "same-title", "b.md": "same-title-2"}
    last = engine.store.commits()[-1][1]["batch"]
    assert [r.relpath for r in spark.read.parquet(f"{engine.root}/store/sources/{last}").collect()] == ["a.md"]
    assert {r.dst for r in engine.graph_edges.filter("relation = 'depends_on'").collect()} == {"concept:epsilon", "concept:delta"}
    # a writer that comes too late
    with pytest.raises(sinks.Conflict):
        engine.store.commit({t: engine.store.read(t).limit(0) for t in engine.store.tables}, after=1)
    assert engine.store.vacuum() == 0 and engine.store.vacuum(min_age=0) > 0 and engine.sources.count() == 2
    # findings, and what mends them
    rows = {t: engine.store.read(t, "a.md") for t in engine.store.tables}
    rows["wiki_index"] = spark.createDataFrame([("gone", "t", "s", "a.md")], rows["wiki_index"].schema)
    engine.store.commit(rows)
    assert {r.category for r in engine.lint().collect()} == {"orphan_page", "dead_link"}
    (root / "b.md").unlink()
    assert {r.category for r in engine.lint().collect()} == {"orphan_page", "dead_link", "dangling_manifest_entry"}
    assert {r.action for r in engine.fix(apply=True).collect()} == {"rebuild_index", "skip"}
    assert {r.category for r in engine.lint().collect()} == {"dangling_manifest_entry"}
    # a refresh that runs
    out = {r.action_id: r.outcome for r in engine.refresh(str(root), prune=True, mode="execute").collect()}
    assert out == {"prune:b.md": "completed", "graphify:build": "completed"} and engine.sources.count() == 1 and engine.lint().count() == 0
    assert engine.graph_run()[0].count() == engine.graph_runs.read().first().nodes > 0
    assert [(r.completed, r.failed, r.status) for r in engine.watch_status().collect()] == [(2, 0, "complete")]
    # pages made of extractions: once for each text, kept when the source changes, not against other pages
    first = {r.slug: r.artifact_id for r in engine.extract().collect()}
    assert {r.slug: r.artifact_id for r in engine.extract().collect()} == first and engine.extract(again=True).count() == len(first)
    engine.synthesize()
    done = {r.target_slug: r.operation for r in engine.apply().collect()}
    assert set(done.values()) == {"create"} and engine.wiki_pages.filter("origin = 'llm_wiki'").count() == len(done)
    assert {r.operation for r in engine.apply().collect()} == {"already_applied"} and engine.lint().count() == 0
    (root / "a.md").write_text("# Same title\n\nAlpha depends on Omega.\n")
    engine.ingest(str(root))
    assert engine.wiki_pages.filter("origin = 'llm_wiki'").count() == len(done) and {r.operation for r in engine.apply().collect()} == {"stale"}
    assert [r.slug for r in engine.wiki_pages.filter("origin = 'ingest'").collect()] == ["same-title"]
    assert engine.lint().count() == 0
    # answers that become pages
    answered = engine.query("what does Alpha depend on", writeback="yes").first()
    assert answered.writeback == "forced" and engine.wiki_pages.filter("origin = 'writeback'").count() == 1
    assert engine.lint().count() == 0 and engine._manifest().count() == 1


def test_tasks_that_take_too_long():
    import time

    with pytest.raises(TimeoutError), files.limited(0.05):
        time.sleep(1)
    with files.limited(5):
        pass


def test_versions(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    t.upsert(spark.createDataFrame([(2, "c")], "k int, v string"), "k")
    (tmp_path / "t/data/unfinished").mkdir()  # a version that was not finished
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c")]
    t.delete(spark.createDataFrame([(1,)], "k int"), "k")
    assert [tuple(r) for r in t.read().collect()] == [(2, "c")]


def run(query_df, name, mode, path):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    src = tmp_path / "events"
    rows = spark.createDataFrame([(k, f"r{k % 2}", f"a{k % 3}", "claim", 60) for k in range(12)], "k long, resource_key string, agent_id string, op string, ttl_seconds int").withColumn("ts", F.timestamp_seconds(F.col("k") * 20))
    rows.coalesce(1).write.parquet(str(src))
    events = stream.read_events(spark, str(src), rows.schema.simpleString()[7:-1].replace(":", " "))
    leases = run(stream.leases(events), "leases", "append", str(tmp_path / "c1"))
    from lorespark.operators import ledger

    assert sorted(map(tuple, leases.collect())) == sorted(map(tuple, ledger.fold_leases(rows).collect()))
    windows = run(stream.counts_by_window(events, "ts", "agent_id", "1 minute"), "windows", "complete", str(tmp_path / "c2"))
    assert windows.groupBy().sum("n").first()[0] == 12
    sessions = run(stream.sessions(events, "ts", "agent_id", 100), "sessions", "complete", str(tmp_path / "c3"))
    assert sessions.count() == 3


def test_rules_and_settings(tmp_path):
    from lorespark.sources import config

    p = tmp_path / "config/routing_rules.yaml"
    p.parent.mkdir()
    p.write_text("version: 1\ndefault_route: graph\nrules:\n  - {id: b, priority: 2, target_route: wiki, keywords: {en: [x]}}\n  - {id: a, priority: 1, target_route: vector, secondary: wiki, keywords: {zh: [總結]}}\n")
    rules, default = config.load_rules(root=str(tmp_path))
    assert [r[0] for r in rules] == ["a", "b"] and default == "graph"
    assert config.load_rules()[1] == "vector"
    p.write_text("rules:\n  - {id: b, priority: 2, target_route: nowhere, keywords: {en: [x]}}\n")
    with pytest.raises(ValueError):
        config.load_rules(str(p))
    (tmp_path / "e").write_text("# x\nexport A='1'\nB=2\n")
    (tmp_path / "s.json").write_text('{"a": {"b": [true, "x"]}}')
    assert config.setting("A", (), {"A": "9"}, str(tmp_path / "e")) == "9"
    assert config.setting("A", (), {}, str(tmp_path / "e")) == "1"
    assert config.setting("C", ("a", "b"), {}, str(tmp_path / "e"), str(tmp_path / "s.json")) == "1+x"
    assert config.bounded(None, 5, 1, 9) == 5
    with pytest.raises(ValueError):
        config.bounded("10", 5, 1, 9)
