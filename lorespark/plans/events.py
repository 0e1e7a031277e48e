"""Queries over events: sessions, leases, handoffs, and windows in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import ledger, lint
from lorespark.plans.registry import query, table


@query("""with g as (select user_id, ts, sum(case when epoch_us(ts) - epoch_us(p) > 1800 * 1000000::bigint then 1 else 0 end) over (partition by user_id order by ts range unbounded preceding)::bigint "session" from (select *, lag(ts) over (partition by user_id order by ts) p from events))
  select user_id, "session", min(ts) as "start", max(ts) as "end", count(*) n from g group by 1, 2""")
def sessionize_gap(spark: SparkSession, d: str) -> DataFrame:
    return ledger.sessions(table(spark, d, "events"), "user_id", "ts")


@query("""select user_id, last_seen, case when lt = 'purchase' then 'closed' when epoch_us(last_seen) // 1000000 + 86400 < epoch_us((select max(ts) from events)) // 1000000 then 'stale' else 'active' end status from (select user_id, max(ts) last_seen, arg_max(event_type, ts) lt from events group by 1)""")
def stale_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return ledger.session_status(e, "user_id", "ts", "event_type", now, "purchase", 86_400)


@query()
def lease_fold(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    op = F.when(k % 5 < 3, "claim").when(k % 5 == 3, "renew").otherwise("release")
    e = table(spark, d, "events").select(F.concat(F.lit("r"), (k % 97).cast("string")).alias("resource_key"), F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("agent_id"), op.alias("op"), "ts", (F.lit(3600) * (1 + k % 30)).cast("int").alias("ttl_seconds"))
    return ledger.fold_leases(e)


@query("""select event_id handoff_id, t as type, v as value from (select event_id, unnest(['user', 'order']) t, unnest([user_id, event_id * 3]) v from events) where (t = 'user' and v not in (select c_custkey from customer where c_custkey % 2 = 0)) or (t = 'order' and v not in (select o_orderkey from orders))""")
def handoff_missing_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = F.array(F.struct(F.lit("user").alias("type"), F.col("user_id").alias("value")), F.struct(F.lit("order").alias("type"), (F.col("event_id") * 3).alias("value")))
    h = table(spark, d, "events").select(F.col("event_id").alias("handoff_id"), refs.alias("references"))
    users = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("user").alias("type"), F.col("c_custkey").alias("value"))
    orders = table(spark, d, "orders").select(F.lit("order").alias("type"), F.col("o_orderkey").alias("value"))
    return lint.check_references(h, users.union(orders))


@query("""select o_orderkey::varchar resource_key, o_custkey::varchar agent_id, o_orderdate expires_at from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1996-01-01'""")
def stale_leases(spark: SparkSession, d: str) -> DataFrame:
    leases = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("resource_key"), F.col("o_custkey").cast("string").alias("agent_id"), F.col("o_orderdate").alias("expires_at"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("released").alias("status"))
    return lint.check_leases(leases, F.lit("1996-01-01").cast("timestamp"))


@query("""select time_bucket(interval '1 hour', ts) as "start", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""select s as "start", count(*) n, round(max(value), 4) top from (select value, unnest([time_bucket(interval '15 minutes', ts), time_bucket(interval '15 minutes', ts) - interval '15 minutes', time_bucket(interval '15 minutes', ts) - interval '30 minutes', time_bucket(interval '15 minutes', ts) - interval '45 minutes']) s from events) group by 1""")
def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))
    return g.select(F.col("window.start").alias("start"), "n", "top")


@query("""with g as (select user_id, ts, sum(case when epoch_us(ts) - epoch_us(p) >= 1800 * 1000000::bigint then 1 else 0 end) over (partition by user_id order by ts range unbounded preceding) s from (select *, lag(ts) over (partition by user_id order by ts) p from events))
  select user_id, min(ts) as "start", max(ts) + interval '30 minutes' as "end", count(*) n from g group by user_id, s""")
def event_session(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("""select event_type, count(*) n, sum((props->>'$.k')::bigint)::bigint total, max((props->>'$.k')::bigint) most from events group by 1""")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))
