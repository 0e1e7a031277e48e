import random
import time

from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import chunks, components, graph, ledger, retrieval, trees


def value(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column.alias("y")).first().y


def test_text(spark):
    x = F.col("x")
    assert value(spark, T.normalize_text(x), " a \t b\r\n\n\n\nc  ") == "a b\n\nc"
    assert value(spark, T.lexical_terms(x), "Atlas 專案風險 a atlas") == ["atlas", "專案", "案風", "風險"]
    assert value(spark, T.graph_terms(x), "專案風險x ab") == ["專案", "風險", "ab"]
    assert value(spark, T.clean_label(x), "- 1. Note: because  the  Plan.") == "the Plan"
    assert value(spark, T.split_targets(x), "A1, B10 and C2和D") == ["A1", "B10", "C2", "D"]
    assert value(spark, T.slug(x), "Hello, World!") == "hello-world"
    assert len(value(spark, T.slug(x), "ab " * 60)) <= 96
    assert value(spark, T.slug(x), "專案") != ""
    assert value(spark, T.entity_type(x), "Project Atlas") == "Project"
    assert value(spark, T.shell_export(x), "it's") == "export KS_ROOT='it'\"'\"'s'"
    assert value(spark, T.summary(x), " 1a \n\n b1 ") == "1a b1"
    assert value(spark, T.valid_relpath(x), "a/../b") is False


def test_relations(spark):
    rows = [("d", "However Plan A depends on Server B and Cache C. Next. 專案甲 影響 專案乙。X is followed by Y\nMr. Bean owns Teddy")]
    df = spark.createDataFrame(rows, "relpath string, body string")
    found = {(r.relation, r.source, r.target) for r in graph.relations(graph.sentences(df, "relpath", "body"), "relpath").collect()}
    assert {("depends_on", "However Plan A", "Server B"), ("depends_on", "However Plan A", "Cache C"), ("impacts", "專案甲", "專案乙"), ("succeeds", "Y", "X"), ("owns", "Mr. Bean", "Teddy")} <= found
    nodes, edges = graph.document_graph(df.withColumn("title", F.lit("t")), "relpath", "title", "body")
    assert nodes.filter("type = 'Document'").count() >= 1
    assert edges.filter("relation = 'references'").count() == 9


def test_relations_equal_every_pattern_tried(spark):
    """Triggers and places where labels begin change no row: held against all patterns, tried on each sentence as they stand."""
    rng = random.Random(5)
    words = ["甲", "乙", "專案", "導致", "使得", "使", "與", "和", "矛盾", "衝突", "，", ",", "；", "之後", "接續", "影響", "會影響", "依賴", "參考", "隸屬於", "屬於", "負責", " causes ", " cause ", "However ", " but ", " contradicts ", " conflicts with ", " succeeds ", " followed by ", " is followed by ", " precedes ", " affects ", " Impacts ", " depends on ", " DEPENDS ON ", " references ", " belongs to ", " owns ", " owns", "A", "b c", " ", ". ", "\u2028", "\r", "!"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    found = spark.createDataFrame([(str(k), 0, x) for k, x in enumerate(texts)], "id string, pos int, sentence string")
    s = F.col("sentence")
    kept = found
    for n, (_, p, _) in enumerate(graph.PATTERNS):
        kept = kept.withColumns({f"l{n}": F.regexp_extract(s, f"(?i){p}", 1), f"r{n}": F.regexp_extract(s, f"(?i){p}", 2)})
    n = len(graph.PATTERNS)
    kept = kept.select("id", "pos", "sentence", F.array(*(f"l{k}" for k in range(n))).alias("l"), F.array(*(f"r{k}" for k in range(n))).alias("r"))
    kept = kept.withColumn("l", F.transform("l", graph.clean_label)).withColumn("nth", F.array_position(F.transform("l", lambda x: x != ""), True)).filter("nth > 0")
    kept = kept.withColumns({"relation": F.element_at(F.array(*(F.lit(r) for r, _, _ in graph.PATTERNS)), F.col("nth").cast("int")), "left": F.element_at("l", F.col("nth").cast("int")), "right": F.element_at("r", F.col("nth").cast("int")), "reverse": F.element_at(F.array(*(F.lit(r) for _, _, r in graph.PATTERNS)), F.col("nth").cast("int"))})
    kept = kept.withColumn("other", F.explode(F.transform(graph.split_targets(F.col("right")), graph.clean_label))).filter("other != ''")
    want = sorted((r.id, r.relation, r.other if r.reverse else r.left, r.left if r.reverse else r.other) for r in kept.collect())
    have = sorted((r.id, r.relation, r.source, r.target) for r in graph.relations(found, "id").collect())
    assert have == want and len({x[1] for x in have}) == 8


def test_long_sentences_without_relations_are_fast(spark):
    """Work grows with a sentence's length, not with its square."""
    text = "x y " * 250_000 + "專案甲依賴專案乙"
    df = spark.createDataFrame([("d", 0, "a b " * 250_000), ("e", 0, text)], "id string, pos int, sentence string")
    begin = time.monotonic()
    assert [(r.id, r.target) for r in graph.relations(df, "id").collect()] == [("e", "專案乙")] and time.monotonic() - begin < 60


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (5, 5), (None, 3)], "src long, dst long")
    out = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert set(out.values()) == {0, 1000} and len(out) == 303
    assert components.connected_components(edges.filter("false")).count() == 0


def test_leases():
    lease, out = None, []
    for agent, op, at in [("a", "claim", 0), ("b", "claim", 5), ("a", "renew", 6), ("b", "release", 7), ("a", "release", 8), ("b", "claim", 9), ("a", "claim", 30), ("b", "renew", 31)]:
        lease, outcome = ledger.step(lease, agent, op, at, 10)
        out.append(outcome)
    assert out == ["claimed", "conflict", "renewed", "not_owner", "released", "claimed", "claimed", "not_owner"]
    assert ledger.step(None, "a", "claim", 0, 0)[1] == "invalid_ttl"


def test_one_winner(spark):
    rows = [("r", f"a{k:03}", "claim", k) for k in range(100)]
    df = spark.createDataFrame(rows, "resource_key string, agent_id string, op string, k int").select("resource_key", "agent_id", "op", F.timestamp_seconds(F.lit(1000)).alias("ts"), F.lit(60).alias("ttl_seconds"))
    out = ledger.fold_leases(df).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in out} == {"claimed": 1, "conflict": 99}


def test_rerank_and_trees(spark):
    c = spark.createDataFrame([(1, 0, "wiki", 1.0), (1, 0, "vector", 0.9), (1, 1, "vector", 0.8)], "query_id long, idx int, route string, score double")
    fused = retrieval.fuse(c)
    assert [r.route for r in fused.orderBy("position").collect()] == ["wiki", "vector", "vector"]
    turned = retrieval.rerank(fused, spark.createDataFrame([(1, [2, 0])], "query_id long, indices array<int>"))
    assert [r.score for r in turned.orderBy("position").collect()] == [0.8, 1.0, 0.9]
    empty = spark.createDataFrame([("a", "no headings")], "relpath string, body string")
    assert trees.markdown_headings(empty, "relpath", "body").count() == 0
    flat = trees.flatten_trees(spark.createDataFrame([("a", '{"root_nodes": [{"node_id": "n1", "title": "T", "children": [{"node_id": "n1.1", "title": "U"}]}]}')], "relpath string, json string"))
    assert [(r.node_id, r.depth) for r in flat.orderBy("node_id").collect()] == [("n1", 0), ("n1.1", 1)]


def test_segment_chunks(spark):
    rows = [("f", 0, "sheet_header", "## S"), ("f", 1, "table_row", "| a |"), ("f", 2, "paragraph", "one two"), ("f", 3, "paragraph", "three"), ("f", 4, "heading", "# H"), ("f", 5, "paragraph", "four")]
    df = spark.createDataFrame(rows, "relpath string, seg_idx int, kind string, text string")
    assert [r.text for r in chunks.segment_chunks(df, 3).orderBy("chunk_idx").collect()] == ["## S\n\n| a |", "## S\n\none two\n\nthree", "## S\n\n# H", "## S\n\n# H\n\nfour"]


def test_segment_chunks_without_header(spark):
    """The first heading takes the header's place; blank texts add nothing; long runs are packed in order."""
    rows = [(0, "paragraph", "a"), (1, "heading", "# One"), (2, "paragraph", ""), (3, "heading", "# Two"), (4, "paragraph", "b c d"), (5, "paragraph", "e"), (6, "paragraph", "f g"), (7, "heading", "# Three"), (8, "notes", "n"), (9, "slide_header", "## S"), (10, "ocr_text", "o")]
    df = spark.createDataFrame([("f", *r) for r in rows], "relpath string, seg_idx int, kind string, text string")
    got = [(r.text, r.section_type, r.header, r.heading) for r in chunks.segment_chunks(df, 4).orderBy("chunk_idx").collect()]
    assert got == [
        ("a", "paragraph", None, None), ("# One", "heading", None, "# One"), ("# One", "paragraph", None, "# One"), ("# One\n\n# Two", "heading", None, "# Two"),
        ("# One\n\n# Two\n\nb c d\n\ne", "paragraph", None, "# Two"), ("# One\n\n# Two\n\nf g", "paragraph", None, "# Two"), ("# One\n\n# Two\n\n# Three", "heading", None, "# Three"),
        ("# One\n\n# Three\n\nn", "notes", None, "# Three"), ("## S\n\no", "ocr_text", "## S", None),
    ]


def test_nested_headings(spark):
    levels = [2, 3, 3, 1, 4, 2, 6, 2, 9, 1]
    df = spark.createDataFrame([("f", i + 1, v, f"t{i}", 10 * i, 100) for i, v in enumerate(levels)], "relpath string, idx int, level int, title string, start int, length int")
    out = {r.preorder: r for r in trees.nest(df).collect()}
    parents, kids = [], {}
    for i, v in enumerate(levels):
        up = next((j for j in range(i - 1, -1, -1) if levels[j] < v), None)
        kids.setdefault(up, []).append(i)
        parents.append(up)
    name = lambda i: f"n{kids[None].index(i) + 1}" if parents[i] is None else f"{name(parents[i])}.{kids[parents[i]].index(i) + 1}"
    path = lambda i: [*(path(parents[i]) if parents[i] is not None else []), f"t{i}"]
    for i, v in enumerate(levels):
        r = out[i + 1]
        end = next((10 * j for j in range(i + 1, len(levels)) if levels[j] <= v), 100)
        assert (r.node_id, r.parent_id, r.depth, r.section_path, r.end_offset) == (name(i), None if parents[i] is None else name(parents[i]), len(path(i)) - 1, " > ".join(path(i)), end)


def test_chunk_offsets(spark):
    body = "Alpha beta, gamma  delta.\nEps 漢字 end"
    df = spark.createDataFrame([("f", body)], "relpath string, body string")
    cut = chunks.chunk_windows(df, "relpath", "body", 3, 1)
    for r in cut.join(trees.chunk_offsets(cut, df), ["relpath", "chunk_idx"]).collect():
        assert body[r.offset :].startswith(r.tokens[0])


def test_shared_targets_become_concepts(spark):
    rows = [("d", "Plan A depends on Anna Bell. Plan B depends on Anna Bell. Plan C depends on Carl Dorn."), ("e", "Plan A depends on Anna Bell.")]
    df = spark.createDataFrame(rows, "relpath string, body string").withColumn("title", F.lit("t"))
    nodes, edges = graph.document_graph(df, "relpath", "title", "body")
    ends = {(r.source_relpath, r.dst) for r in edges.filter("relation = 'depends_on'").collect()}
    assert ends == {("d", "concept:anna-bell"), ("d", "person:carl-dorn"), ("e", "person:anna-bell")}
    assert {(r.source_relpath, r.type) for r in nodes.filter("label = 'Anna Bell'").collect()} == {("d", "Concept"), ("e", "Person")}


def test_many_queries_meet_shards(spark, monkeypatch):
    from lorespark.functions import vectors

    rng = __import__("random").Random(5)
    base = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(200)], "id long, v array<double>")
    few = vectors.nearest(base, "id", "v", base.withColumnsRenamed({"id": "q", "v": "w"}), "q", "w", 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "SHARD", 50)
    many = vectors.nearest(base, "id", "v", base.withColumnsRenamed({"id": "q", "v": "w"}), "q", "w", 3).orderBy("query_id", "rank").collect()
    assert many == few and len(few) == 600


def test_questions_in_blocks(spark, monkeypatch):
    from lorespark.operators import retrieval

    monkeypatch.setattr(retrieval, "MOST_QUESTIONS", 40)
    asked = spark.createDataFrame([(k, f"word{k} thing") for k in range(100)], "query_id long, question string")
    pages = spark.createDataFrame([(f"s{k:03}", "thing", "", f"word{k}") for k in range(100)], "slug string, title string, summary string, body string")
    out = {r.query_id: r.slug for r in retrieval.in_blocks(asked, lambda q: retrieval.wiki_search(q, pages)).collect()}
    assert len(out) == 100 and out[7] == "s007"


def test_long_chains_are_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(500)], "src long, dst long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}


def test_leases_against_a_plain_fold(spark):
    """Outcomes of random events, resource by resource, in whatever partitions they come."""
    import random
    from datetime import datetime, timezone

    r = random.Random(8)
    rows = sorted({(f"r{r.randrange(3)}", r.randrange(4000), f"a{r.randrange(3)}", r.choice(["claim", "renew", "release"])) for _ in range(600)})
    ttl = lambda k: (0, 50, 300)[k % 3]
    df = spark.createDataFrame([(res, agent, op, datetime.fromtimestamp(ts, timezone.utc), ttl(ts)) for res, ts, agent, op in rows], "resource_key string, agent_id string, op string, ts timestamp, ttl_seconds int")
    want, state = [], {}
    for res, ts, agent, op in rows:
        owner, until = state.get(res, (None, 0))
        if until <= ts:
            owner = None
        if ttl(ts) == 0:
            outcome = "invalid_ttl"
        elif op == "claim":
            outcome = "claimed" if owner is None else "renewed" if owner == agent else "conflict"
        elif owner is None:
            outcome = "no_lease"
        elif owner != agent:
            outcome = "not_owner"
        else:
            outcome = "renewed" if op == "renew" else "released"
        if outcome in ("claimed", "renewed"):
            owner, until = agent, ts + ttl(ts)
        elif outcome == "released":
            owner = None
        state[res] = owner, until
        want.append((res, ts, agent, op, outcome, owner))
    got = sorted((x.resource_key, int(x.ts.timestamp()), x.agent_id, x.op, x.outcome, x.owner) for x in ledger.fold_leases(df.repartition(5)).collect())
    assert got == sorted(want)
