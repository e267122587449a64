"""Queries of rounds, snapshots, windows of time and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.plans.registry import query
from laurel.session import table
from laurel.sources import files, snapshots
from laurel.streaming import rounds


@query("incremental_round_counts", "WITH e AS (SELECT CAST(ts AS DATE) AS round, user_id FROM events), f AS (SELECT user_id, min(round) AS round FROM e GROUP BY 1) SELECT round, count(*) AS \"rows\", (SELECT count(*) FROM f WHERE f.round = e.round) AS new_entities FROM e GROUP BY 1")
def incremental_round_counts(spark, d):
    return rounds.round_counts(table(spark, d, "events").withColumn("round", F.to_date("ts")), "round", "user_id")


@query("append_missing", "SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1")
def append_missing(spark, d):
    events = table(spark, d, "events").select("event_id")
    return rounds.appended(events.where("event_id % 2 = 0"), events.where("event_id % 3 = 0"), ["event_id"])


@query("snapshot_diff", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'REMOVED' WHEN o_orderkey % 7 = 0 THEN 'ADDED' ELSE 'CHANGED' END AS change FROM orders WHERE (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0) OR (o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) OR (o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderstatus = 'P')")
def snapshot_diff(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = orders.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return snapshots.difference(orders.where("o_orderkey % 7 <> 0"), after, ["o_orderkey"])


@query("round_slices", "WITH r AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders) SELECT 'a' AS slice, count(*) AS \"rows\", count(DISTINCT o_custkey) AS fresh FROM r WHERE y = 1996 UNION ALL SELECT 'b', count(*), count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT o_custkey FROM r WHERE y = 1996)) FROM r WHERE y = 1997")
def round_slices(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    made = files.slices(orders, {"a": "y = 1996", "b": "y = 1997"}, "c_custkey", table(spark, d, "customer"))
    out = None
    for name, (part, fresh) in made.items():
        row = part.agg(F.count("*").alias("rows")).crossJoin(fresh.agg(F.count("*").alias("fresh"))).select(F.lit(name).alias("slice"), "rows", "fresh")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("events_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return rounds.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query("events_sliding", "SELECT date_trunc('hour', ts) - to_hours(k) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def events_sliding(spark, d):
    return rounds.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", [])


@query(
    "events_session",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f, event_id FROM events),
 b AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""",
)
def events_session(spark, d):
    return rounds.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"])
