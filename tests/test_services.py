from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lorespark.services import Artifacts, Coordination, Workspaces


def test_one_claim_wins(spark, tmp_path):
    c = Coordination(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        out = list(pool.map(lambda k: c.claim(f"agent{k}", "page/a", 60, now=1000), range(24)))
    assert sorted(out) == ["claimed"] + ["conflict"] * 23
    winner = f"agent{out.index('claimed')}"
    assert c.claim(winner, "page/a", 60, now=1010) == "renewed" and c.renew("other", "page/a", now=1011) == "not_owner"
    assert c.claim("late", "page/a", 60, now=1071) == "claimed" and c.release("late", "page/a", now=1080) == "released"
    assert c.claim("x", "page/b", 0) == "invalid_ttl" and c.renew("x", "page/b") == "no_lease"
    assert [r.outcome for r in c.leases().orderBy("ts").collect()] == ["claimed", "renewed", "claimed", "released"]
    c.hand_off("a", "b", "page/a", "done")
    assert c.handoffs(agent="b").count() == 1 and c.handoffs(resource="page/z").count() == 0


def test_claims_read_few_events(spark, tmp_path, monkeypatch):
    """After a snapshot only the events behind it are read, and outcomes stay those of the fold over all."""
    from lorespark import services

    monkeypatch.setattr(services, "SNAPSHOT_EVERY", 4)
    c, read = Coordination(spark, str(tmp_path)), []
    lines = c._lines
    monkeypatch.setattr(c, "_lines", lambda folder, known, start: (lambda out: read.append(len(out[1])) or out)(lines(folder, known, start)))
    out = []
    for k in range(22):
        agent = f"a{k % 3 // 2}"
        out.append((k, agent, c.claim(agent, "r", 20, now=1000 + 9 * k) if k % 5 else c.release(agent, "r", now=1000 + 9 * k)))
    assert max(read) < 4 and {x[2] for x in out} >= {"claimed", "renewed", "conflict"}
    changed = [x[2] for x in out if x[2] in ("claimed", "renewed", "released")]
    assert [r.outcome for r in c.leases().orderBy("ts").collect()] == changed


def test_sessions(spark, tmp_path):
    c = Coordination(spark, str(tmp_path))
    assert c.sessions(1000).count() == 0
    one = c.start_session("a", now=1000)
    assert c.start_session("a", now=1010) == one and c.heartbeat("a", now=1020) == one
    two = c.start_session("b", now=1020)
    assert c.close_session("b", now=1020) == two and {r.session_id: r.status for r in c.sessions(1030).collect()} == {one: "active", two: "closed"}
    assert {r.session_id: r.status for r in c.sessions(4000).collect()} == {one: "stale", two: "closed"}
    c.claim("a", "page/x", 60, now=1000)
    c.claim("a", "page/y", 60, now=1000)
    c.release("a", "page/y", now=1010)
    assert {tuple(r) for r in c.lint(now=4000).collect()} == {("stale_lease", "page/x"), ("stale_session", one)}
    assert c.lint(now=1030).count() == 0 and c.start_session("b", now=1040) != two
    try:
        c.heartbeat("nobody")
    except KeyError:
        pass
    else:
        raise AssertionError


def test_workspaces(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("Alpha depends on Beta.\n")
    w = Workspaces(spark, str(tmp_path / "registry"))
    assert w.roots() == {}
    w.register("one", str(tmp_path / "kb1"))
    w.register("two", str(tmp_path / "kb1"))
    w.register("three", str(tmp_path / "kb3"))
    w.use("one").ingest(str(root))
    assert "Alpha" in w.query("one", "what does Alpha depend on").first().answer
    out = {r.workspace_id: (r.sources, r.duplicate) for r in w.status().collect()}
    assert out == {"one": (1, True), "two": (1, True), "three": (0, False)}
    w.remove("two")
    assert set(w.roots()) == {"one", "three"}


def test_artifacts_are_made_once(spark, tmp_path):
    a, asked = Artifacts(spark, str(tmp_path)), []
    requests = spark.createDataFrame([("k1", False), ("k2", False)], "idempotency_key string, force boolean")

    def make(todo):
        asked.append({r.idempotency_key for r in todo.collect()})
        return todo.select("idempotency_key", F.lit(len(asked)).alias("run"))

    first = {r.idempotency_key: r.artifact_id for r in a.store_or_reuse(requests, make).collect()}
    again = {r.idempotency_key: r.artifact_id for r in a.store_or_reuse(requests, make).collect()}
    forced = {r.idempotency_key: r.run for r in a.store_or_reuse(requests.withColumn("force", F.col("idempotency_key") == "k2"), make, F.col("force")).collect()}
    assert asked == [{"k1", "k2"}, set(), {"k2"}] and first == again and len(first["k1"]) == 24 and forced == {"k1": 1, "k2": 3}
