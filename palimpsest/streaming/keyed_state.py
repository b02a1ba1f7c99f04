"""Operators that keep state and timers for each key, and give on a stream what the fold gives on a table, however rows arrive.

Rows wait in state until the watermark passes them and are then folded in the
order of their event time; what arrives later than the watermark allows is dropped
by Spark before (streaming.reports keeps such rows). State is kept by RocksDB.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.streaming.buffer import remember

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = 3_600_000_000
_DAY = 24 * _HOUR
#: Rows of one file of a table that is replayed as a stream.
ROWS = 500_000


class InOrder(StatefulProcessor):
    """Rows (at: microseconds, id, and the `columns`) of a key in the order of at and id.

    fold() gets the rows that the watermark has passed and keeps what it needs in
    self.kept (None at first, and when there is nothing to keep); due() says when it
    has to be called next although nothing arrives. What a key keeps, what waits and
    its one timer are one value in state, as each call to the state is a message to
    another process: a few for a key and batch, none for a row.
    """

    columns = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in ["at", "id", *filter(None, map(str.strip, self.columns.split(",")))]]
        self.row = Row(*self.names)
        self.state = handle.getValueState("state", "pickled binary")

    def fold(self, key: Any, rows: list[Row], now: int) -> Iterator[Row]:
        raise NotImplementedError(type(self).__name__)

    def due(self) -> int | None:
        return None

    def _ready(self, key: Any, timers, new: list[tuple], fired: int | None = None) -> Iterator[Row]:
        passed = timers.getCurrentWatermarkInMs()
        found = self.state.get()
        before = bytes(found[0]) if found else b""
        waiting, self.kept, timer = pickle.loads(before) if before else ([], None, None)
        ready, ahead = [], []
        for r in [*waiting, *new]:
            (ready if r[0] <= 1000 * passed else ahead).append(r)
        ready.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        yield from self.fold(key[0], [self.row(*r) for r in ready], 1000 * passed)
        times = [t for t in (min((r[0] for r in ahead), default=None), self.due()) if t is not None]
        at = max(-(-min(times) // 1000), passed + 1) if times else None
        if timer not in (None, at, fired):
            self.handle.deleteTimer(timer)
        if at is not None and at != timer:
            self.handle.registerTimer(at)
        after = pickle.dumps((ahead, self.kept, at)) if ahead or self.kept is not None or at is not None else b""
        if after and after != before:
            self.state.update((after,))
        elif before and not after:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._ready(key, timerValues, [tuple(r[n] for n in self.names) for r in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._ready(key, timerValues, [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None: ...


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str, late: str) -> DataFrame:
    """Run a processor over a stream (key, ts, id, its columns)."""
    spark = rows.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    columns = [c.split()[0] for c in filter(None, map(str.strip, processor.columns.split(",")))]
    told = rows.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), *columns)
    return told.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


class _Limit(InOrder):
    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.span = limit, seconds * 1_000_000

    def fold(self, key, rows, now):
        times = self.kept or []
        for r in rows:
            times = [t for t in times if r.at - t < self.span]
            free = len(times) < self.limit
            if free:
                times.append(r.at)
            yield Row(key=key, at=r.at, id=r.id, allowed=free)
        # What no row ahead of the watermark can count any more goes, so a quiet key keeps nothing.
        times = [t for t in times if now - t < self.span]
        self.kept = times or None

    def due(self):
        return min(self.kept) + self.span if self.kept else None


def rate_limited(attempts: DataFrame, limit: int = 10, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """sessions.rate_limited() on a stream (key, ts, id): key, ts, id, allowed.

    A key's state is the times of at most `limit` allowed attempts, which expire
    by a timer, and what arrived within the watermark.
    """
    found = in_order(attempts.withColumn("key", F.col("key").cast("string")), "key", _Limit(limit, seconds), "key string, at long, id long, allowed boolean", late)
    return found.select("key", F.timestamp_micros("at").alias("ts"), "id", "allowed")


def by_answer(limited: DataFrame, path: str, checkpoint: str):
    """Start the stream of rate_limited(): allowed attempts go to one folder, refused ones to another, each batch under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in (("allowed", batch.filter("allowed")), ("refused", batch.filter("not allowed"))):
            rows.drop("allowed").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return limited.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class _Held(InOrder):
    columns = "turn long, pos long, node_id string, protected boolean"

    def __init__(self, size: int, idle: int, forget: int) -> None:
        self.size, self.idle, self.forget = size, idle, forget * _HOUR

    def fold(self, key, rows, now):
        held, last = self.kept or ({}, None)
        turns: dict[tuple[int, int], list[Row]] = {}
        for r in rows:
            turns.setdefault((r.at, r.turn), []).append(r)
        for (at, turn), offered in sorted(turns.items()):
            if last is not None and at - last >= self.forget:
                held.clear()
            remember(held, turn, [(r.node_id, r.protected) for r in sorted(offered, key=lambda r: (r.pos, r.id))], self.size, self.idle)
            last = at
            for node, (seen, safe) in held.items():
                yield Row(conv_id=key, at=at, turn=turn, node_id=node, last_turn=seen, protected=safe)
        if last is not None and now - last >= self.forget:
            held, last = {}, None
        self.kept = None if last is None else (held, last)

    def due(self):
        return self.kept[1] + self.forget if self.kept else None


def held(offers: DataFrame, size: int = 5, idle: int = 5, forget_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """buffer.replay() on a stream (conv_id, ts, id, turn, pos, node_id, protected): what is held after each turn.

    The rows of a turn have one time. A conversation that is quiet for
    `forget_hours` is forgotten by a timer, and what comes after begins anew.
    """
    schema = "conv_id string, at long, turn long, node_id string, last_turn long, protected boolean"
    found = in_order(offers.withColumn("conv_id", F.col("conv_id").cast("string")), "conv_id", _Held(size, idle, forget_hours), schema, late)
    return found.select("conv_id", F.timestamp_micros("at").alias("ts"), "turn", "node_id", "last_turn", "protected")


class QueueFold:
    """A user's review queue in time: what each item comes to, and when.

    items: id to [created, snoozed or None, priority rank, signal rank, state].
    """

    def __init__(self, items: dict[int, list], cap: int, snooze: int, resolve: int) -> None:
        self.items, self.cap, self.snooze, self.resolve = items, cap, snooze, resolve

    def next(self) -> int | None:
        times = []
        for created, snoozed, _, _, state in self.items.values():
            times.append((created if snoozed is None else snoozed) + self.resolve)
            if state == "SNOOZED":
                times.append(snoozed + self.snooze)
        return min(times, default=None)

    def _settle(self, at: int) -> Iterator[tuple[int, int, str]]:
        for i in sorted(i for i, (created, snoozed, *_) in self.items.items() if (created if snoozed is None else snoozed) + self.resolve <= at):
            del self.items[i]
            yield at, i, "AUTO_RESOLVED"
        queue = sorted(self.items, key=lambda i: (self.items[i][2], -self.items[i][3], self.items[i][0], i))
        for n, i in enumerate(queue):
            snoozed = self.items[i][1]
            state = "SUSPENDED_QUEUE_FULL" if n >= self.cap else "SNOOZED" if snoozed is not None and snoozed + self.snooze > at else "PENDING_HITL"
            if state != self.items[i][4]:
                self.items[i][4] = state
                yield at, i, state

    def until(self, at: int) -> Iterator[tuple[int, int, str]]:
        """What time alone changes up to then."""
        while (due := self.next()) is not None and due <= at:
            yield from self._settle(due)

    def step(self, at: int, events: list[tuple[int, str, int, int]]) -> Iterator[tuple[int, int, str]]:
        """What events (item, kind, priority rank, signal rank) of one time change. What is no longer open isn't asked again."""
        yield from self.until(at)
        for i, kind, priority, signal in events:
            if kind == "created":
                self.items.setdefault(i, [at, None, priority, signal, ""])
            elif i in self.items and kind == "snoozed":
                self.items[i][1] = at
            elif i in self.items and kind == "answered":
                del self.items[i]
                yield at, i, "ANSWERED"
        yield from self._settle(at)


class _Queue(InOrder):
    columns = "kind string, priority_rank long, signal_rank long"

    def __init__(self, cap: int, snooze: int, resolve: int) -> None:
        self.limits = cap, snooze, resolve

    def fold(self, key, rows, now):
        queue = QueueFold(self.kept or {}, *self.limits)
        at_once: dict[int, list] = {}
        for r in rows:
            at_once.setdefault(r.at, []).append((r.id, r.kind, r.priority_rank, r.signal_rank))
        for at, events in at_once.items():
            for t, i, state in queue.step(at, events):
                yield Row(user_id=key, at=t, id=i, state=state)
        for t, i, state in queue.until(now):
            yield Row(user_id=key, at=t, id=i, state=state)
        self.kept = queue.items or None
        self.next = queue.next()

    def due(self):
        return self.next


_QUEUE = "user_id string, at long, id long, state string"


def queue_log(events: DataFrame, cap: int = 40, snooze_hours: int = 24, resolve_days: int = 7, late: str = "1 hour", until: str | None = None) -> DataFrame:
    """Every change of state (user_id, ts, id, state) of the items of users' queues.

    events: user_id, ts, id (of the item), kind (created, snoozed, answered),
    priority_rank, signal_rank. On a stream timers end a snooze after
    `snooze_hours`, resolve what nobody answered for `resolve_days` after its last
    snooze or its start, and let in what was parked as soon as there is room. On a
    table the same fold runs up to `until`, batch by batch in one task for a user,
    who has a bounded number of open items.
    """
    limits = cap, snooze_hours * _HOUR, resolve_days * _DAY
    events = events.withColumn("user_id", F.col("user_id").cast("string"))
    if events.isStreaming:
        found = in_order(events, "user_id", _Queue(*limits), _QUEUE, late)
    else:
        end = events.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '{until}')").first()[0] if until else None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            user, queue, at, waiting = None, None, None, []
            for pdf in batches:
                out: list[tuple] = []
                for u, t, i, kind, priority, signal in pdf.itertuples(index=False):
                    if u != user or t != at:
                        if queue is not None:
                            out += [(user, *x) for x in queue.step(at, waiting)]
                            if u != user and end is not None:
                                out += [(user, *x) for x in queue.until(end)]
                        if u != user:
                            user, queue = u, QueueFold({}, *limits)
                        at, waiting = t, []
                    waiting.append((i, kind, priority, signal))
                yield pd.DataFrame(out, columns=["user_id", "at", "id", "state"])
            if queue is not None:
                out = [(user, *x) for x in queue.step(at, waiting)]
                out += [(user, *x) for x in queue.until(end)] if end is not None else []
                yield pd.DataFrame(out, columns=["user_id", "at", "id", "state"])

        told = events.select("user_id", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), "kind", F.col("priority_rank").cast("long"), F.col("signal_rank").cast("long"))
        told = told.filter(F.col("at") <= F.lit(end)) if end is not None else told
        found = told.repartition("user_id").sortWithinPartitions("user_id", "at", "id").mapInPandas(run, _QUEUE)
    return found.select("user_id", F.timestamp_micros("at").alias("ts"), "id", "state")


def thread_of(messages: dict[int, int | None], leaf: int) -> list[int]:
    """Turns from the root to the leaf by their parents (turn to parent); all of them where a parent is missing."""
    path, at, seen = [], leaf, set()
    while at is not None:
        if at not in messages or at in seen:
            return sorted(messages)
        seen.add(at)
        path.append(at)
        at = messages[at]
    return path[::-1]


class _Decay(InOrder):
    columns = "parent long"

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def fold(self, key, rows, now):
        open_ = self.kept or {}
        last = max(((at, turn) for turn, (_, at) in open_.items()), default=None)
        for r in [*rows, None]:
            if last is not None and (now if r is None else r.at) - last[0] >= self.gap:
                for pos, turn in enumerate(thread_of({t: p for t, (p, _) in open_.items()}, last[1])):
                    yield Row(conv_id=key, ended=last[0], messages=len(open_), pos=pos, turn=turn)
                open_, last = {}, None
            if r is not None:
                open_[r.id] = (r.parent, r.at)
                last = (r.at, r.id) if last is None else max(last, (r.at, r.id))
        self.kept = open_ or None
        self.until = None if last is None else last[0] + self.gap

    def due(self):
        return self.until


def decay_events(messages: DataFrame, gap_minutes: int = 120, late: str = "1 hour") -> DataFrame:
    """(conv_id, ended, messages, pos, turn): the active thread of each conversation, once, when it has been quiet for the gap.

    messages: a stream of conv_id, ts, id (the turn), parent. The thread leads from
    the root to the message said last; branches that were left are not in it, nor
    counted on. What is said afterwards is a conversation of its own. The log of an
    open conversation is kept in state and leaves it with the event.
    """
    schema = "conv_id string, ended long, messages long, pos long, turn long"
    found = in_order(messages.withColumn("conv_id", F.col("conv_id").cast("string")), "conv_id", _Decay(gap_minutes * 60_000_000), schema, late)
    return found.select("conv_id", F.timestamp_micros("ended").alias("ended_at"), "messages", "pos", "turn")


def replayed(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, order: str, parts: int = 4, end: str | None = "ts", files: int | None = None) -> DataFrame:
    """What a streaming operator gives when rows arrive by a column of times, in so many batches of `files` files.

    A batch has a file for about ROWS rows, unless `files` says. The batches are cut at quantiles of the column, written one after the other
    and read as a stream. A last row with null for everything but the time (`end`),
    a century later, lets the watermark pass all others.
    """
    spark: SparkSession = rows.sparkSession
    at = F.unix_micros(order)
    edges = rows.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    part = sum((F.coalesce(at > F.lit(edge), F.lit(False)).cast("int") for edge in edges), F.lit(0))
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/arrived")
    arrived = spark.read.schema(f"{rows._jdf.schema().toDDL()}, _part int").parquet(f"{folder}/arrived")
    files = files or -(-arrived.count() // (parts * ROWS)) or 1
    for k in range(parts):
        part = arrived.filter(F.col("_part") == k).drop("_part")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    if end:
        last = [F.lit("2124-01-01").cast("timestamp").alias(c) if c == end else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
        spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    out = operator(stream)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
