import os
import random

import pytest
from pyspark.sql import functions as F

from lorespark.engine import Engine
from lorespark.operators.ledger import step
from lorespark.sources import files
from lorespark.streaming import ledger as stream


def folded(events, until):
    """Outcomes of events in order, and leases that ran out, up to a time."""
    out, leases = [], {}
    for at, key, agent, op, ttl in sorted(events):
        lease = leases.get(key)
        if lease and lease[1] <= at:
            out.append((key, lease[1], lease[0], "timer", "expired"))
            lease = None
        lease, outcome = step(lease, agent, op, at, ttl)
        out.append((key, at, agent, op, outcome))
        leases[key] = lease
    out += [(key, x[1], x[0], "timer", "expired") for key, x in leases.items() if x and x[1] <= until]
    return sorted(out)


def test_timed_leases(spark, tmp_path):
    """Events in files of any order within the lateness give the rows of a fold in order; state is empty in the end."""
    rng = random.Random(3)
    events = sorted({(1000 + 7 * k, f"r{rng.randrange(4)}", f"a{rng.randrange(3)}", rng.choice(["claim", "claim", "renew", "release"]), rng.choice([20, 60, 200])) for k in range(90)})
    # an event of its own resource moves the watermark on: all before it is told
    last = (1000 + 7 * 90 + 2000, "zz", "a0", "release", 20)
    parts = [events[k : k + 15] for k in range(0, 90, 15)]
    for p in parts:
        rng.shuffle(p)
    parts = [parts[1], parts[0], *parts[2:], [last], [(last[0] + 1, "zz", "a0", "release", 20)]]
    src, schema = str(tmp_path / "in"), "at long, resource_key string, agent_id string, op string, ttl_seconds int"
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(src)
        for name in os.listdir(src):  # files in the order of their writing
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{src}/{name}", f"{src}/b{k:02d}.parquet")
                os.utime(f"{src}/b{k:02d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        for name in os.listdir(src):
            if name.endswith(".crc"):
                os.remove(f"{src}/{name}")
    read = stream.read_events(spark, src, "resource_key string, agent_id string, op string, ttl_seconds int, ts timestamp", max_files=1)
    out = stream.timed_leases(read, "5 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = sorted((r.resource_key, int(r.ts.timestamp()), r.agent_id, r.op, r.outcome) for r in spark.table("timed").collect() if r.resource_key != "zz")
    assert got == folded(events, last[0] - 300) and sum(r[4] == "expired" for r in got) > 3
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # zz's own events, which no later one lets pass


def test_scan_reads_only_what_changed(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for k in range(3):
        (root / f"f[{k}].txt").write_text(f"Alpha{k} depends on Beta.\n")
    engine = Engine(spark, str(tmp_path / "kb"))
    engine.ingest(str(root))
    digests = {r.relpath: r.sha256 for r in engine.sources.collect()}
    # other bytes of the same length and time are not seen, so they were not read; with whole they are
    stat = (root / "f[0].txt").stat()
    (root / "f[0].txt").write_text("Omega0 depends on Beta.\n")
    os.utime(root / "f[0].txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (root / "f[1].txt").write_text("Alpha1 depends on Gamma and more.\n")
    rows = {r.relpath: r for r in engine.scan(str(root)).collect()}
    assert rows["f[0].txt"].sha256 == digests["f[0].txt"] and rows["f[0].txt"].content is None and rows["f[2].txt"].content is None
    assert rows["f[1].txt"].sha256 != digests["f[1].txt"] and rows["f[1].txt"].content is not None
    assert {r.relpath: r.sha256 for r in engine.scan(str(root), whole=True).collect()}["f[0].txt"] != digests["f[0].txt"]
    assert {r.relpath: r.status for r in engine.ingest(str(root)).collect()} == {"f[0].txt": "skipped", "f[1].txt": "updated", "f[2].txt": "skipped"}


def test_many_changed_files_are_found_by_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_NAMED", 1)
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("x")
    known = spark.createDataFrame([], "relpath string, length long, modificationTime timestamp, sha256 string")
    assert files.rescan(spark, str(tmp_path), known).filter("content is not null").count() == 3


def test_follow_is_exactly_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("Alpha depends on Beta.\n")
    engine, checkpoint = Engine(spark, str(tmp_path / "kb")), str(tmp_path / "c")
    # the commit is there, but the stream stops before it knows
    whole = engine.ingest

    def stops(*a, **k):
        whole(*a, **k)
        raise OSError("stopped")

    monkeypatch.setattr(engine, "ingest", stops)
    with pytest.raises(Exception, match="stopped"):
        engine.follow(str(root), checkpoint)
    monkeypatch.undo()
    assert engine.sources.count() == 1 and engine.store.latest() == 1
    assert engine.follow(str(root), checkpoint).first().batch == 0
    assert engine.store.latest() == 1 and engine.sources.count() == 1  # the batch ran again, and changed nothing
    (root / "b.txt").write_text("Gamma depends on Delta.\n")
    (root / "a.txt").unlink()
    assert engine.follow(str(root), checkpoint, prune=True).first().batch == 1
    assert [r.relpath for r in engine.sources.collect()] == ["b.txt"]
