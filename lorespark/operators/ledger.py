"""Agents' sessions, leases and handoffs as folds over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 1800


def sessions(events: DataFrame, agent: str, ts: str, gap_seconds: int = TTL_SECONDS) -> DataFrame:
    """agent, session, start, end and n: a session ends when the next event is more than the gap away."""
    w = Window.partitionBy(agent).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(w) > gap_seconds, 1).otherwise(0)
    rows = events.select(agent, ts, new.alias("new")).withColumn("session", F.sum("new").over(w))
    return rows.groupBy(agent, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def session_status(events: DataFrame, agent: str, ts: str, kind: str, now: Column, close: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """agent, last_seen and status: closed, stale (not seen for the ttl) or active."""
    last = events.groupBy(agent).agg(F.max(ts).alias("last_seen"), F.max_by(kind, ts).alias("last"))
    status = F.when(F.col("last") == close, "closed").when(F.unix_seconds(F.col("last_seen").cast("timestamp")) + ttl_seconds < F.unix_seconds(now.cast("timestamp")), "stale").otherwise("active")
    return last.select(agent, "last_seen", status.alias("status"))


def step(lease: tuple[str, int, int] | None, agent: str, op: str, at: int, ttl: int) -> tuple[tuple[str, int, int] | None, str]:
    """The lease (owner, expiry, generation) after one event, and what became of the event. A lease that has run out is none."""
    generation = lease[2] if lease else 0
    if lease and lease[1] <= at:
        lease = None
    if not 1 <= ttl <= 86_400:
        return lease, "invalid_ttl"
    if op == "claim":
        if lease is None:
            return (agent, at + ttl, generation + 1), "claimed"
        return ((agent, at + ttl, generation), "renewed") if lease[0] == agent else (lease, "conflict")
    if lease is None:
        return None, "no_lease"
    if lease[0] != agent:
        return lease, "not_owner"
    return ((agent, at + ttl, generation), "renewed") if op == "renew" else (None, "released")


OUTCOME = "resource_key string, ts timestamp, agent_id string, op string, outcome string, owner string"


def fold_leases(events: DataFrame) -> DataFrame:
    """The outcome of each lease event (resource_key, agent_id, op, ts, ttl_seconds), by resource in order of time, then agent. Spark sorts a resource's events; a task holds one batch of them and the lease in force, however many there are."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lease = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.resource_key != key:
                    key, lease = r.resource_key, None
                lease, outcome = step(lease, r.agent_id, r.op, int(r.ts.timestamp()), int(r.ttl_seconds))
                out.append((r.resource_key, r.ts, r.agent_id, r.op, outcome, lease[0] if lease else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    order = ["resource_key", "ts", "agent_id", "op"]
    return events.select(*order, "ttl_seconds").repartition("resource_key").sortWithinPartitions(*order).mapInPandas(fold, OUTCOME)


def lease_status(leases: DataFrame, now: Column, stale: bool = True) -> DataFrame:
    """leases with their status as of now; with stale false, only those in force."""
    out = leases.withColumn("status", F.when(F.col("released_at").isNotNull(), "released").when(F.col("expires_at") <= now, "expired").otherwise("active"))
    return out if stale else out.filter("status = 'active'")


def handoffs(log: DataFrame, agent: str | None = None, resource: str | None = None) -> DataFrame:
    out = log
    if agent is not None:
        out = out.filter((F.col("from_agent") == agent) | (F.col("to_agent") == agent))
    return out if resource is None else out.filter(F.col("resource_key") == resource)
