"""Sessions by inactivity, bursts, limits and the queue's clock.

sessions, daily and bursts work on a stream and on a table; a stream gets its
watermark from the caller's `late`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.temporal import moment


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late and events.isStreaming else events


def sessions(events: DataFrame, gap: str = "120 minutes", late: str | None = "1 day") -> DataFrame:
    """A user's events with gaps under the limit, as one session each: start, end of the last event plus gap, count."""
    w = F.session_window("ts", gap)
    return _marked(events, late).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts")).select("user_id", F.col("session_window.start").alias("started_at"), "last_ts", "events")


def decayed(open_sessions: DataFrame, now: str, minutes: int = 120, n: int = 5) -> DataFrame:
    """Open sessions quiet for longer than the limit, the oldest first, a few at a time."""
    cutoff = F.timestamp_add("MINUTE", F.lit(-minutes), moment(now))
    return open_sessions.filter((F.col("last_ts") < cutoff) & (F.col("events") > 0)).orderBy("last_ts", "user_id", "started_at").limit(n)


def daily(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """One session for each user and day."""
    return _marked(events, late).groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("window.start").alias("day"), "events")


def bursts(decisions: DataFrame, length: str = "48 hours", slide: str = "1 day", min_decisions: int = 3, min_targets: int = 2, late: str | None = "1 day") -> DataFrame:
    """Sliding windows with enough shifting decisions (ts, target) over enough targets.

    Whether there are two targets is exact on a stream and on a table: the least
    and the greatest differ. How many there are, and limits above two, a stream
    counts approximately, as exact distinct counts keep no bounded state.
    """
    stream = decisions.isStreaming
    targets = F.approx_count_distinct("target") if stream else F.count_distinct("target")
    counted = _marked(decisions, late).groupBy(F.window("ts", length, slide)).agg(F.count(F.lit(1)).alias("decisions"), targets.alias("targets"), F.min("target").alias("_low"), F.max("target").alias("_high"))
    two = F.when(F.col("_low") != F.col("_high"), 2).when(F.col("_low").isNotNull(), 1).otherwise(0)
    enough = two >= min_targets if min_targets <= 2 else F.col("targets") >= min_targets
    return counted.filter((F.col("decisions") >= min_decisions) & enough).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "decisions", "targets")


def claim_once(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """The first claim of each session."""
    if claims.isStreaming:
        return claims.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id"])
    w = Window.partitionBy("session_id").orderBy("ts", "claim_id")
    return claims.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rate_limited(attempts: DataFrame, limit: int = 10, seconds: int = 300) -> DataFrame:
    """Attempts (key, ts, id) with whether each is allowed: at most so many allowed ones in the time before it.

    Refused attempts don't count, so each answer hangs on the ones before it: a
    key's attempts are folded in order in one task, however many, but batch by
    batch, with the times of at most `limit` allowed ones as all that is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["ts"], strict=True):
                if k != key:
                    key, times = k, []
                times = [x for x in times if (t - x).total_seconds() < seconds]
                out.append(len(times) < limit)
                if out[-1]:
                    times.append(t)
            yield pdf.assign(allowed=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in attempts.schema) + ", allowed boolean"
    return attempts.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, schema)


def ring(events: DataFrame, n: int = 50) -> DataFrame:
    """The latest events."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def queue_state(items: DataFrame, now: str, cap: int = 40, snooze_hours: int = 24, resolve_days: int = 7) -> DataFrame:
    """What each item (id, user_id, created_at, priority_rank, signal_rank, last_snoozed_at) is now.

    Items unanswered for long after their last snooze, or their start, resolve
    themselves; the first of a user's queue up to the cap are pending, or snoozed
    for a day; the others are parked.
    """
    from palimpsest.operators.ranking import queue_order

    since = F.coalesce("last_snoozed_at", "created_at")
    over = F.timestamp_add("DAY", F.lit(resolve_days), since) <= moment(now)
    w = Window.partitionBy("user_id", "_over").orderBy(*queue_order(), "id")
    placed = items.withColumn("_over", over).withColumn("_n", F.row_number().over(w))
    asleep = F.col("last_snoozed_at").isNotNull() & (F.timestamp_add("HOUR", F.lit(snooze_hours), "last_snoozed_at") > moment(now))
    state = F.when(F.col("_over"), "AUTO_RESOLVED").when(F.col("_n") > cap, "SUSPENDED_QUEUE_FULL").when(asleep, "SNOOZED").otherwise("PENDING_HITL")
    return placed.withColumn("state", state).drop("_over", "_n")


def jobs_due(runs: DataFrame, now: str) -> DataFrame:
    """Interval jobs (job, every_seconds, last_run) that are due: never run, or long enough ago, failed or not."""
    return runs.filter(F.col("last_run").isNull() | (F.timestamp_add("SECOND", F.col("every_seconds"), F.col("last_run")) <= moment(now)))
