"""Small shared states: leases and handoffs of agents, a registry of workspaces, artifacts that are made once."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.engine import Engine
from lorespark.operators import catalog, ledger, lint, refresh
from lorespark.operators.tables import create_once, names, read_small, union_all, unreadable, written
from lorespark.sources.sinks import VersionedTable

EVENT = "number int, resource_key string, agent_id string, op string, ts timestamp, ttl_seconds int"
#: Events of a resource after which its lease is kept, so that a claim reads fewer events than that.
SNAPSHOT_EVERY = 64
HANDOFF = "handoff_id string, from_agent string, to_agent string, resource_key string, summary string, ts timestamp"


class Coordination:
    """Leases as numbered events of a resource, each a file of its own that can only be created once, so that of many claims at
    a time each sees the one before it: one wins. State is the fold over a resource's events."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _lines(self, folder: str, known: dict[str, dict], start: int) -> tuple[int, list[dict]]:
        """The next number of a folder, and its events from a number on, in order."""
        found = names(self.spark, folder)
        for name in found[start:]:
            if name not in known:
                known[name] = json.loads(read_small(self.spark, f"{folder}/{name}"))
        return len(found), [known[name] for name in found[start:]]

    def _snapshot(self, folder: str) -> tuple[int, tuple[str, int, int] | None]:
        """How many events the latest snapshot of a resource has, and its lease after them."""
        found = names(self.spark, f"{folder}/snapshots")
        if not found:
            return 0, None
        lease = json.loads(read_small(self.spark, f"{folder}/snapshots/{found[-1]}"))
        return int(found[-1].partition(".")[0]), tuple(lease) if lease else None

    def _try(self, agent: str, resource: str, op: str, ttl: int, now: float | None) -> str:
        if not 1 <= ttl <= 86_400:
            return "invalid_ttl"
        at_resource = f"{self.root}/claims/{uuid.uuid5(uuid.NAMESPACE_URL, resource).hex}"
        folder, known = f"{at_resource}/leases", {}
        start, before = self._snapshot(at_resource)
        while True:
            at, lease = int(time.time() if now is None else now), before
            number, events = self._lines(folder, known, start)
            for e in events:
                lease, _ = ledger.step(lease, e["agent_id"], e["op"], e["at"], e["ttl_seconds"])
            after, outcome = ledger.step(lease, agent, op, at, ttl)
            if outcome not in ("claimed", "renewed", "released"):
                return outcome  # what changes nothing is not written
            event = {"number": number, "resource_key": resource, "agent_id": agent, "op": op, "at": at, "ttl_seconds": ttl}
            if create_once(self.spark, f"{folder}/{number:08d}.json", json.dumps(event)):
                if (number + 1) % SNAPSHOT_EVERY == 0:
                    create_once(self.spark, f"{at_resource}/snapshots/{number + 1:08d}.json", json.dumps(after))
                return outcome  # else another agent was faster: look again

    def claim(self, agent: str, resource: str, ttl: int = ledger.TTL_SECONDS, now: float | None = None) -> str:
        """claimed, renewed or conflict."""
        return self._try(agent, resource, "claim", ttl, now)

    def renew(self, agent: str, resource: str, ttl: int = ledger.TTL_SECONDS, now: float | None = None) -> str:
        return self._try(agent, resource, "renew", ttl, now)

    def release(self, agent: str, resource: str, now: float | None = None) -> str:
        return self._try(agent, resource, "release", ledger.TTL_SECONDS, now)

    def _events(self) -> DataFrame | None:
        fs, path = self._fs(f"{self.root}/claims")
        if not fs.exists(path):
            return None
        schema = "number int, resource_key string, agent_id string, op string, at long, ttl_seconds int"
        return self.spark.read.schema(schema).json(f"{self.root}/claims/*/leases")

    def leases(self) -> DataFrame:
        """The events of all resources, with what became of them."""
        events = self._events()
        if events is None:
            return ledger.fold_leases(self.spark.createDataFrame([], EVENT))
        return ledger.fold_leases(events.withColumn("ts", F.timestamp_seconds("at")).drop("at"))

    def _session(self, agent: str, op: str, now: float | None, session: str) -> str:
        row = self.spark.createDataFrame([(session, agent, op, int(time.time() if now is None else now))], "session_id string, agent_id string, op string, at long")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/sessions")
        return session

    def start_session(self, agent: str, now: float | None = None) -> str:
        """The id of the agent's session: the one that is open, else a new one."""
        open_ = self.sessions(now).filter((F.col("agent_id") == agent) & (F.col("status") != "closed")).select("session_id").first()
        return self._session(agent, "heartbeat" if open_ else "start", now, open_["session_id"] if open_ else uuid.uuid4().hex)

    def heartbeat(self, agent: str, now: float | None = None) -> str:
        return self._in_session(agent, "heartbeat", now)

    def close_session(self, agent: str, now: float | None = None) -> str:
        return self._in_session(agent, "close", now)

    def _in_session(self, agent: str, op: str, now: float | None) -> str:
        open_ = self.sessions(now).filter((F.col("agent_id") == agent) & (F.col("status") != "closed")).select("session_id").first()
        if open_ is None:
            raise KeyError(f"agent {agent} has no session")
        return self._session(agent, op, now, open_["session_id"])

    def sessions(self, now: float | None = None, ttl_seconds: int = ledger.TTL_SECONDS) -> DataFrame:
        """session_id, agent_id, last_seen and status (active, stale or closed) of all sessions."""
        fs, path = self._fs(f"{self.root}/sessions")
        schema = "session_id string, agent_id string, op string, at long"
        events = self.spark.read.schema(schema).parquet(f"{self.root}/sessions") if fs.exists(path) else self.spark.createDataFrame([], schema)
        # a close is a session's last event, even in the second of another
        events = events.withColumn("ts", F.timestamp_micros(F.col("at") * 1_000_000 + (F.col("op") == "close").cast("long")))
        at = F.timestamp_seconds(F.lit(int(time.time() if now is None else now)))
        agents = events.select("session_id", "agent_id").distinct()
        return ledger.session_status(events, "session_id", "ts", "op", at, "close", ttl_seconds).join(agents, "session_id").select("session_id", "agent_id", "last_seen", "status")

    def lint(self, now: float | None = None) -> DataFrame:
        """Leases that ran out and were not taken again, and sessions that went stale: kind and what."""
        last = self.leases().filter("outcome in ('claimed', 'renewed', 'released')").groupBy("resource_key").agg(F.max_by("outcome", "ts").alias("last"))
        held, raw = self.spark.createDataFrame([], "kind string, target string"), self._events()
        if raw is not None:
            ends = raw.filter("op != 'release'").groupBy("resource_key").agg(F.max(F.col("at") + F.col("ttl_seconds")).alias("end"))
            late = ends.join(last.filter("last != 'released'"), "resource_key").filter(F.col("end") <= int(time.time() if now is None else now))
            held = late.select(F.lit("stale_lease").alias("kind"), F.col("resource_key").alias("target"))
        return held.union(self.sessions(now).filter("status = 'stale'").select(F.lit("stale_session"), "session_id"))

    def hand_off(self, sender: str, receiver: str, resource: str, summary: str) -> str:
        number = uuid.uuid4().hex
        row = self.spark.createDataFrame([(number, sender, receiver, resource, summary)], HANDOFF.rpartition(",")[0])
        row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/handoffs")
        return number

    def handoffs(self, agent: str | None = None, resource: str | None = None) -> DataFrame:
        return ledger.handoffs(self.spark.read.schema(HANDOFF).parquet(f"{self.root}/handoffs"), agent, resource)


class Workspaces:
    """Knowledge bases by name. The registry is a table of a few rows, written anew with each change."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, f"{root.rstrip('/')}/workspaces")

    def register(self, workspace_id: str, root: str) -> None:
        self.table.upsert(self.spark.createDataFrame([(workspace_id, root)], "workspace_id string, root string"), "workspace_id")

    def remove(self, workspace_id: str) -> None:
        self.table.delete(self.spark.createDataFrame([(workspace_id,)], "workspace_id string"), "workspace_id")

    def roots(self) -> dict[str, str]:
        return {r["workspace_id"]: r["root"] for r in self.table.read().collect()} if self.table.exists() else {}

    def use(self, workspace_id: str) -> Engine:
        roots = self.roots()
        if workspace_id not in roots:
            raise KeyError(f"no workspace {workspace_id}")
        return Engine(self.spark, roots[workspace_id])

    def query(self, workspace_id: str, questions: DataFrame | str) -> DataFrame:
        return self.use(workspace_id).query(questions)

    def status(self) -> DataFrame:
        """workspace_id, sources, formats, last_ingest (the number of the last commit) and whether another has the same root."""
        parts = [self.spark.createDataFrame([], "workspace_id string, format string, ingested_at long")]
        for name in self.roots():
            engine = self.use(name)
            if engine.store.exists():
                parts.append(engine.sources.select(F.lit(name).alias("workspace_id"), "format", F.lit(engine.store.latest()).cast("long").alias("ingested_at")))
        return catalog.workspace_status(union_all(parts), self.table.read())


    def lint(self) -> DataFrame:
        """Findings over the registry: one that cannot be read, entries that say nothing, roots without a store, and roots of several workspaces."""
        there = self.table.exists()
        broken = unreadable(self.spark, [self.table.folder()] if there else [])
        if not (there and broken.isEmpty()):
            return lint.check_unreadable(broken, "workspace_registry_corrupt")
        registry = self.table.read()
        roots = [r["root"] for r in registry.select("root").distinct().collect() if r["root"] and Engine(self.spark, r["root"]).store.exists()]
        have = self.spark.createDataFrame([(r,) for r in roots], "root string")
        named = registry.filter("trim(coalesce(workspace_id, '')) != '' and trim(coalesce(root, '')) != ''")
        return union_all([lint.check_registry(registry), lint.check_workspaces(named, have)])


class Artifacts:
    """Results that are made once for a request: a request with the key of a stored artifact gets that one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/artifacts"

    def read(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return self.spark.read.parquet(self.path) if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else None

    def store_or_reuse(self, requests: DataFrame, make: Callable[[DataFrame], DataFrame], again: Column | None = None) -> DataFrame:
        """Artifacts of requests (idempotency_key, ...). make: the artifacts of requests that have none, with their key, asked for these only; again: a condition on requests that are made anew. artifact_id: the first 24 characters of the key's digest."""
        have = self.read()
        todo = requests if have is None else refresh.not_done(requests, have, again=again)
        made = written(make(todo).withColumns({"artifact_id": F.substring(F.sha2("idempotency_key", 256), 1, 24), "created_at": F.current_timestamp()}))
        made.write.mode("append").parquet(self.path)
        every = self.spark.read.parquet(self.path).join(requests.select("idempotency_key").distinct(), "idempotency_key", "left_semi")
        newest = every.groupBy("idempotency_key").agg(F.max("created_at").alias("created_at"))
        return every.join(newest, ["idempotency_key", "created_at"]).dropDuplicates(["idempotency_key"])
