"""Queries and operators without SQL, held against plain Python."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lorespark.operators import components, refresh, trees
from lorespark.operators import retrieval as R
from lorespark.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_lease_fold(spark):
    """One lease a resource: who holds it, until when."""
    events = [(f"r{e['event_id'] % 97}", e["ts"], f"a{e['user_id'] % 5}", ("claim", "claim", "claim", "renew", "release")[e["event_id"] % 5], 3600 * (1 + e["event_id"] % 30)) for e in rows("events")]
    held, want = {}, []
    for key, ts, agent, op, ttl in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3])):
        at = int(ts.timestamp())
        owner, until = held.get(key, (None, 0))
        if owner and until <= at:
            owner = None
        if ttl > 86_400:
            outcome = "invalid_ttl"
        elif op == "claim":
            outcome = "claimed" if owner is None else "renewed" if owner == agent else "conflict"
        else:
            outcome = "no_lease" if owner is None else "not_owner" if owner != agent else {"renew": "renewed", "release": "released"}[op]
        if outcome in ("claimed", "renewed"):
            owner, until = agent, at + ttl
        elif outcome == "released":
            owner = None
        held[key] = owner, until
        want.append((key, agent, op, outcome, owner))
    got = [(r.resource_key, r.agent_id, r.op, r.outcome, r.owner) for r in catalogue.queries()["lease_fold"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[3] for w in want} >= {"claimed", "conflict"}


def test_segment_chunks(spark):
    """Headings and table rows by themselves, neighbouring paragraphs packed to 32 tokens, under the first and the latest heading."""
    import re

    token = re.compile("[A-Za-z0-9]+|[一-鿿]|[^\\s]")
    documents = defaultdict(list)
    for p in rows("part"):
        documents[p["p_brand"]].append((p["p_partkey"], ("heading", "table_row")[p["p_partkey"] % 5] if p["p_partkey"] % 5 < 2 else "paragraph", p["p_name"]))
    want = []
    for brand, segments in documents.items():
        pieces, run, used, headings = [], [], 0, []
        for _, kind, text in [*sorted(segments), (None, "end", "")]:
            above = headings[:1] + headings[-1:] * (len(headings) > 1)
            n = max(1, len(token.findall(text)))
            if run and (kind != "paragraph" or used + n > 32):
                pieces.append((above, "paragraph", run))
                run, used = [], 0
            if kind == "paragraph":
                run, used = [*run, text], used + n
            elif kind != "end":
                pieces.append((above, kind, [text]))
            headings += [text] * (kind == "heading")
        want += [(brand, k, "\n\n".join([*c, *t]).strip(), kind) for k, (c, kind, t) in enumerate(pieces)]
    got = [(r.relpath, r.chunk_idx, r.text, r.section_type) for r in catalogue.queries()["segment_chunks"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_all_routes(spark):
    """Keywords first, then the similarity of hashed tokens to a rule's words."""
    import hashlib
    import math
    import re

    token = re.compile("[A-Za-z0-9]+|[一-鿿]|[^\\s]")

    def vector(text):
        v = defaultdict(float)
        for t in token.findall(text.lower()):
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 128] += 1
        return v

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(k, 0) for k, x in a.items()) / size if size else 0.0

    want = {}
    for b in rows("benchmark"):
        q = ("summary of ", "why ", "")[b["item_id"] % 3] + b["text"]
        scored = []
        for rule, priority, route, _, zh, en in R.RULES:
            hits = sum(k in q for k in zh) + sum(k in q.lower() for k in en)
            scored.append((hits > 0, 0.0 if hits else round(cosine(vector(q), vector(" ".join([*zh, *en]))), 4), -priority, rule, route, hits))
        hit, score, _, rule, route, hits = max(scored)
        want[b["item_id"]] = (rule, route, hits) if hit or score > 0 else ("default", "vector", hits)
    got = {r.query_id: (r.rule_id, r.route, r.hits) for r in catalogue.queries()["route_all_questions"](spark, SF).collect()}
    assert got == want


def test_community_report(spark):
    from lorespark.plans.graphs import graph_layers

    nodes, edges, _ = graph_layers(spark, SF)
    nodes, edges = [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()]
    parent = {n["id"]: n["id"] for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = sorted((root(e["src"]), root(e["dst"])))
        parent[b] = a
    groups = defaultdict(list)
    for n in nodes:
        groups[root(n["id"])].append(n)
    want = []
    for c, members in groups.items():
        label = min(members, key=lambda n: ((0 if n["kind"] == "wiki_page" else 1 if n["kind"] != "source" else 2), n["id"]))["label"]
        own = sorted(e["id"] for e in edges if root(e["src"]) == c)
        want.append((c, len(members), len(own), label, own[:10]))
    got = [(r.component, r.n_nodes, r.n_edges, r.label, r.first_edges) for r in catalogue.queries()["community_report"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_sections_of_offsets(spark):
    """Spans of any shape, nested or not: the deepest that holds an offset, of several the first."""
    rng = random.Random(2)
    nodes, offsets = [], []
    for d in range(12):
        for k in range(rng.randrange(0, 25)):
            a = rng.randrange(100)
            nodes.append((f"d{d}", f"n{k}", rng.randrange(4), k, f"p{k}", a, a + rng.randrange(40)))
        offsets += [(f"d{d}", o) for o in rng.sample(range(140), 30)]
    n = spark.createDataFrame(nodes, "relpath string, node_id string, depth int, preorder int, section_path string, start_offset int, end_offset int")
    o = spark.createDataFrame(offsets, "relpath string, offset int")
    want = []
    for d, at in offsets:
        held = [x for x in nodes if x[0] == d and x[5] <= at < x[6]]
        if held:
            best = max(held, key=lambda x: (x[2], -x[3]))
            want.append((d, at, best[1], best[4]))
    assert sorted(map(tuple, trees.sections_at(o, n).collect())) == sorted(want)


def test_many_headings_of_one_document(spark):
    body = "\n".join(f"{'#' * (1 + k % 3)} h{k}\ntext #{k}\n#no heading" for k in range(12_000))
    df = spark.createDataFrame([("a", body), ("b", "# x"), ("c", "no\n####### seven\n #y"), ("d", "")], "relpath string, body string")
    out = trees.markdown_headings(df, "relpath", "body").filter("relpath = 'a'").orderBy("start").collect()
    assert len(out) == 12_000 and all(body[r.start :].startswith("#" * r.level + " " + r.title) and r.idx == k + 1 for k, r in enumerate(out))
    assert [(r.relpath, r.title) for r in trees.markdown_headings(df, "relpath", "body").filter("relpath != 'a'").collect()] == [("b", "x")]
    nodes = trees.nest(trees.markdown_headings(df, "relpath", "body").filter("relpath = 'a'"))
    offsets = spark.range(0, len(body), 5).select(F.lit("a").alias("relpath"), F.col("id").cast("int").alias("offset"))
    assert trees.sections_at(offsets, nodes).count() == offsets.count()


def test_numbers(spark):
    df = spark.createDataFrame([(k * 7919 % 10_007,) for k in range(3000)], "k long").repartition(5)
    out = components.numbered(df, "k").orderBy("k").collect()
    assert [r.number for r in out] == list(range(1, 3001))


def test_components_in_rounds_and_in_one_task(spark):
    """Whatever is left to one task, components are the same; names are numbers or strings."""
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 600)]
    df = spark.createDataFrame(edges, "src long, dst long")
    rounds = sorted(map(tuple, components.connected_components(df).collect()))
    for together in (10**6, 40):
        assert sorted(map(tuple, components.connected_components(df, together=together).collect())) == rounds
    text = df.select(*(F.lpad(F.col(c).cast("string"), 5, "0").alias(c) for c in ("src", "dst")))
    assert sorted((int(r[0]), int(r[1])) for r in components.connected_components(text, together=10**6).collect()) == rounds


def test_components_after_changes(spark):
    """Labels brought up to date equal labels made anew, after random insertions and removals."""
    rng = random.Random(4)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(45)}
    frame = lambda es: spark.createDataFrame(sorted(es), "src long, dst long")
    member = components.connected_components(frame(edges))
    for k in range(4):
        gone = set(rng.sample(sorted(edges), 5))
        new = {(rng.randrange(75), rng.randrange(75)) for _ in range(2 + 3 * k)} - edges
        edges = (edges - gone) | new
        member = components.updated(member, frame(edges), frame(new), frame(gone))
        want = components.connected_components(frame(edges))
        assert sorted(map(tuple, member.collect())) == sorted(map(tuple, want.collect()))
    assert components.updated(member, frame(edges), frame([]), frame([])).count() == member.count()


def test_dependencies(spark):
    found = spark.createDataFrame([("a", "new"), ("b", "missing"), ("c", "corrupt"), ("d", "unchanged")], "relpath string, state string")
    steps = refresh.plan(found, prune=True)
    assert sorted(map(tuple, refresh.dependencies(steps).collect())) == [(refresh.BUILD, "ingest:a"), (refresh.BUILD, "prune:b")]
    assert {r.action_id: r.n_depends for r in steps.collect()} == {"ingest:a": 0, "prune:b": 0, "issue:c": 0, refresh.BUILD: 2}


def test_fused_answers(spark):
    """Reciprocal ranks of all collectors' candidates, added up by hand: the flagship query's rows."""
    from lorespark.functions import vectors as V
    from lorespark.plans import retrieval as Q

    asked, wiki = Q.questions(spark, SF), Q.pages(spark, SF)
    routed = R.route(asked, R.rule_table(spark))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    relpath = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), relpath.alias("relpath"), "text")
    nodes = wiki.select(F.col("source_relpath").alias("relpath"), F.lit(1).alias("preorder"), "title", "summary")
    parts = [R.wiki_candidates(asked, wiki, routed), R.vector_candidates(asked, chunks, V.embedded(chunks, "chunk_id", "text")), R.tree_candidates(asked, nodes)]
    found = defaultdict(lambda: defaultdict(list))
    for p in parts:
        for r in p.collect():
            found[r.query_id][r.route].append((-r.score, r.idx, r.text, r.relpath))
    routes = {r.query_id: r.route for r in routed.collect()}
    want = {}
    for q in rows("benchmark"):
        best = []
        for route, cs in found[q["item_id"]].items():
            for rank, (score, idx, text, path) in enumerate(sorted(cs, key=lambda c: c[:2]), 1):
                best.append((-1 / (60 + rank), score, R.ROUTES.index(route), idx, route, text, path))
        if best:
            _, score, _, _, route, text, path = min(best)
            want[q["item_id"]] = (text, route, -score, path, " ".join(text.split())[:240])
        else:
            want[q["item_id"]] = ("no relevant knowledge found", routes[q["item_id"]], 0.0, "", "")
    got = {r.query_id: (r.answer, r.route, r.confidence, r.source, r.quote) for r in catalogue.queries()["q_fused_retrieval"](spark, SF).collect()}
    assert got == want and len({w[1] for w in want.values()}) > 1


def test_graph_answer_texts(spark):
    """The three best edges of each question as sentences, from the scores of all edges."""
    from lorespark.plans.graphs import graph_questions, star_graph

    nodes, edges = star_graph(spark, SF)
    asked, words = graph_questions(spark, SF), R.keyword_table(spark)
    by_id, labels = {r.id: r for r in edges.collect()}, {r.id: r.label for r in nodes.collect()}
    scores = defaultdict(list)
    for r in R.graph_scores(asked, nodes, edges, words).collect():
        scores[r.query_id].append((r.score, r.id))
    want = {}
    for q in asked.collect():
        low = q.question.lower()
        relations = {r for r, ks in R.RELATION_WORDS if any(k in low for k in ks)}
        own = [(s, i) for s, i in scores[q.query_id] if by_id[i].relation in relations] or scores[q.query_id]
        best = sorted(own, key=lambda x: (-x[0], x[1]))[:3]
        if not best:
            continue
        sentences = {}
        for _, i in best:
            e = by_id[i]
            ts = sentences.setdefault((e.relation, labels[e.src]), [])
            if labels[e.dst] not in ts:
                ts.append(labels[e.dst])
        text = "；".join(R.SENTENCES[r].format(s, "、".join(ts)) for (r, s), ts in sentences.items())
        evidence = by_id[best[0][1]].evidence
        if any(w in low for w in R.EXPLAIN_WORDS) and evidence:
            text += f"（依據：{evidence[:100]}）"
        want[q.query_id] = (text, round(min(0.99, 0.55 + min(best[0][0], 6.0) * 0.06 + (len(best) - 1) * 0.05), 4), len(best))
    got = {r.query_id: (r.answer, r.confidence, r.n_edges) for r in catalogue.queries()["graph_answer_texts"](spark, SF).collect()}
    assert got == want and len(want) > 5
