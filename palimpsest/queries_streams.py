"""More of the catalogue: the tables replayed as streams, with rows that arrive out of order or late."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.queries import query
from palimpsest.sources import tables
from palimpsest.sources.scratch import shared_folder
from palimpsest.streaming import keyed_state
from palimpsest.streaming.frozen_reports import FrozenReports

_c = F.col


def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, d):
    return tables.read(spark, d, "events").withColumn("ts", _c("ts").cast("timestamp"))


def _arriving(rows):
    """Each row up to fifty minutes after its time, so that they cross."""
    return rows.withColumn("arrives", F.timestamp_add("SECOND", F.pmod(F.xxhash64("id"), F.lit(3000)).cast("int"), "ts"))


@query(""", a AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, n, event_id, [ts] AS times, true AS allowed FROM a WHERE n = 1
          UNION ALL SELECT user_id, n, event_id, CASE WHEN len(k) < 3 THEN list_append(k, ts) ELSE k END, len(k) < 3
          FROM (SELECT a.user_id, a.n, a.event_id, a.ts, list_filter(r.times, lambda x: x > a.ts - INTERVAL 86400 SECOND) AS k FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1))
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, allowed FROM r""")
def streamed_rate_limit(spark, d):
    """At most three events a day of each user, decided on a stream."""
    attempts = _events(spark, d).select(_c("user_id").cast("string").alias("key"), "ts", _c("event_id").alias("id"))
    found = keyed_state.replayed(_arriving(attempts), lambda s: keyed_state.rate_limited(s, 3, 86_400), _new(spark, "limits"), "arrives")
    return found.filter("id is not null").select("key", "id", "allowed")


@query(""", m AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent FROM conversations),
    walk(conv_id, turn, parent) AS (SELECT conv_id, turn, parent FROM m WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM m GROUP BY 1)
        UNION ALL SELECT m.conv_id, m.turn, m.parent FROM walk JOIN m ON m.conv_id = walk.conv_id AND m.turn = walk.parent)
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, (SELECT count(*) FROM m WHERE m.conv_id = walk.conv_id) AS messages FROM walk""")
def decayed_threads(spark, d):
    """Conversations that go quiet: a minute between turns, one conversation begun each minute; the active thread of each, once."""
    t = _c("turn").cast("long")
    at = F.timestamp_add("MINUTE", (F.pmod(F.xxhash64("conv_id"), F.lit(10_000)) + t).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    parent = F.when(t % 3 == 2, t - 2).when(t > 0, t - 1)
    said = tables.read(spark, d, "conversations").select("conv_id", at.alias("ts"), t.alias("id"), parent.alias("parent"))
    found = keyed_state.replayed(_arriving(said), keyed_state.decay_events, _new(spark, "threads"), "arrives")
    return found.filter("conv_id is not null").select("conv_id", "turn", "pos", "messages")


@query(""", i AS (SELECT event_id AS id, user_id, ts, event_id % 3 = 0 AS snoozed, event_id % 5 = 0 AS answered FROM events)
    SELECT CAST(user_id AS VARCHAR) AS user_id, id, CASE WHEN answered THEN 'ANSWERED' ELSE 'AUTO_RESOLVED' END AS state,
           ts + CASE WHEN answered THEN INTERVAL 30 HOUR WHEN snoozed THEN INTERVAL 173 HOUR ELSE INTERVAL 168 HOUR END AS ts FROM i""")
def settled_queue(spark, d):
    """Every event as an item of its user's queue: some are snoozed after five hours, some answered after thirty, the others settle themselves."""
    e = _events(spark, d)
    priority = (_c("event_id") % 3).cast("long").alias("priority_rank")
    kinds = F.explode(F.array(F.struct(F.lit("created").alias("kind"), F.lit(0).alias("h")), F.struct(F.lit("snoozed").alias("kind"), F.lit(5).alias("h")), F.struct(F.lit("answered").alias("kind"), F.lit(30).alias("h"))))
    rows = e.select("user_id", "ts", _c("event_id").alias("id"), priority, (_c("event_id") % 4).cast("long").alias("signal_rank"), kinds.alias("k"))
    rows = rows.filter("k.kind = 'created' or k.kind = 'snoozed' and id % 3 = 0 or k.kind = 'answered' and id % 5 = 0")
    rows = rows.select("user_id", F.timestamp_add("HOUR", _c("k.h"), "ts").alias("ts"), "id", "k.kind", "priority_rank", "signal_rank")
    log = keyed_state.replayed(_arriving(rows), keyed_state.queue_log, _new(spark, "queue"), "arrives")
    return log.filter("state in ('ANSWERED', 'AUTO_RESOLVED')").select("user_id", "id", "state", _c("ts").cast("timestamp_ntz").alias("ts"))


@query(""", e AS (SELECT event_id, ts, date_trunc('week', ts)::TIMESTAMP AS period_start, CAST(floor(epoch(ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END - TIMESTAMP '2024-01-01') / 432000) AS INT) AS b FROM events),
    c AS (SELECT b, max(max(ts)) OVER (ORDER BY b) AS clock FROM e GROUP BY b), k AS (SELECT b, clock, lag(clock) OVER (ORDER BY b) AS before FROM c),
    t AS (SELECT e.*, coalesce(period_start + INTERVAL 8 DAY <= before, false) AS late FROM e JOIN k USING (b))
    SELECT period_start, 'macro_weekly_' || strftime(period_start, '%Y_%m_%d') AS report_id, count(*) FILTER (NOT late) AS findings, count(*) FILTER (late) AS late
    FROM t WHERE period_start + INTERVAL 8 DAY <= (SELECT max(clock) FROM c) GROUP BY 1""")
def frozen_reports(spark, d):
    """A count of each week's findings from a stream of five-day batches in which one event in fifty comes ten days late."""
    e = _events(spark, d).select("event_id", "ts")
    arrives = F.when(_c("event_id") % 50 == 0, F.timestamp_add("DAY", F.lit(10), "ts")).otherwise(_c("ts"))
    e = e.withColumn("b", F.floor((F.unix_seconds(arrives) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 432_000))
    folder = _new(spark, "reports")
    for b in sorted(r.b for r in e.select("b").distinct().collect()):  # five-day blocks of the table
        e.filter(_c("b") == b).drop("b").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    frozen = FrozenReports(folder, lambda rows: rows.groupBy("period_start").agg(F.count(F.lit(1)).alias("findings")))
    frozen.start(spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/checkpoint").awaitTermination()
    late = frozen.late(spark).groupBy("period_start").agg(F.count(F.lit(1)).alias("late"))
    told = frozen.reports(spark).filter("status = 'WRITTEN'").select("period_start", "report_id", "findings")
    told = told.join(late, "period_start", "left").withColumn("late", F.coalesce("late", F.lit(0)))
    return told.withColumn("period_start", _c("period_start").cast("timestamp_ntz"))
