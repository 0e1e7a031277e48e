"""Streams of ledger events: windows with a watermark, sessions, and leases with kept state."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.ledger import OUTCOME, TTL_SECONDS, step


def read_events(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def counts_by_window(events: DataFrame, ts: str, by: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, by and n of tumbling (or sliding) windows; events later than `late` are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, agent: str, gap_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    w = F.session_window(ts, f"{gap_seconds} seconds")
    return events.withWatermark(ts, late).groupBy(w, agent).agg(F.count("*").alias("n")).select(agent, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def leases(events: DataFrame) -> DataFrame:
    """The outcome of each lease event, with one lease kept a resource. Events of a micro-batch are taken in order of time, then agent. State stays: a resource's generations go on for ever. See timed_leases."""

    def fold(key: tuple[Any, ...], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, expires, generation = state.get if state.exists else (None, 0, 0)
        lease = (owner, expires, generation) if owner else None
        last = generation
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "agent_id", "op"])
        for r in rows.itertuples(index=False):
            lease, outcome = step(lease or (("", 0, last) if last else None), r.agent_id, r.op, int(r.ts.timestamp()), int(r.ttl_seconds))
            last = lease[2] if lease else last
            out.append((key[0], r.ts, r.agent_id, r.op, outcome, lease[0] if lease else None))
        state.update((lease[0] if lease else None, lease[1] if lease else 0, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    return events.groupBy("resource_key").applyInPandasWithState(fold, OUTCOME, "owner string, expires long, generation long", "append", GroupStateTimeout.NoTimeout)


def timed_leases(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What becomes of leases as event time goes on: the outcome of each event, in order of time, and a row `expired` when a lease runs out that nobody renewed or released. Then its state goes, so a resource without a lease costs nothing, and its generations begin anew.

    Events wait until the watermark, `late` behind the newest, has passed them: so files may come in any order within
    that, and the rows are those of a fold over all events in order. Later events are dropped.
    """

    def fold(key: tuple[Any, ...], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease, waiting = None, []
        if state.exists:
            owner, expires, generation, kept = state.get
            lease = (owner, expires, generation) if owner else None
            waiting = [tuple(e) for e in json.loads(kept)]
        for b in batches:
            waiting += [(int(r.ts.timestamp()), r.agent_id, r.op, int(r.ttl_seconds)) for r in b.itertuples(index=False)]
        now = state.getCurrentWatermarkMs() / 1000
        waiting.sort()
        out = []

        def expire(until: float) -> None:
            nonlocal lease
            if lease and lease[1] <= until:
                out.append((key[0], pd.Timestamp(lease[1], unit="s"), lease[0], "timer", "expired", None))
                lease = None

        while waiting and waiting[0][0] <= now:
            at, agent, op, ttl = waiting.pop(0)
            expire(at)
            lease, outcome = step(lease, agent, op, at, ttl)
            out.append((key[0], pd.Timestamp(at, unit="s"), agent, op, outcome, lease[0] if lease else None))
        expire(now)
        if lease or waiting:
            owner, expires, generation = lease or (None, 0, 0)
            state.update((owner, expires, generation, json.dumps(waiting)))
            # woken when the next thing can happen: an event's turn, or the end of the lease
            state.setTimeoutTimestamp(int(max(now, min([e[0] for e in waiting[:1]] + ([expires] if lease else []))) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    shape = "owner string, expires long, generation long, waiting string"
    return events.withWatermark("ts", late).groupBy("resource_key").applyInPandasWithState(fold, OUTCOME, shape, "append", GroupStateTimeout.EventTimeTimeout)


def refresh_stream(spark: SparkSession, root: str, apply: Any, checkpoint: str) -> Any:
    """Ingests files as they come: each micro-batch of new files goes to apply(files, batch_id)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
