"""State and timers on streams: whatever the order of arrival, what the fold on the table gives."""

import tempfile
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.streaming import buffer, keyed_state, sessions


def new():
    return tempfile.mkdtemp(prefix="spark-") + "/x"


T0 = datetime(2024, 1, 1)


def shuffled(df):
    """Arrives within an hour of its time, in another order."""
    return df.withColumn("arrives", F.expr("timestampadd(SECOND, cast(pmod(xxhash64(id, 4), 3000) as int), ts)"))


def test_rate_limit(spark):
    rows = [("ab"[i % 2], T0 + timedelta(minutes=i * i % 997), i) for i in range(120)] + [(None, T0, 500), ("a", T0 + timedelta(minutes=9), 7)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    got = keyed_state.replayed(shuffled(df), lambda s: keyed_state.rate_limited(s, 3, 1800), new(), "arrives")
    want = sessions.rate_limited(df, 3, 1800)
    assert sorted(map(tuple, got.filter("id is not null").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_refused_attempts_leave_by_their_own_output(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=i), i) for i in range(10)] + [("z", datetime(2100, 1, 1), 99)], "key string, ts timestamp, id long")
    path = new()
    df.coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    keyed_state.by_answer(keyed_state.rate_limited(stream, 4, 3600), path, f"{path}/checkpoint").awaitTermination()
    ids = lambda name: sorted(r.id for r in spark.read.parquet(f"{path}/{name}").filter("key = 'a'").collect())
    assert ids("allowed") == [0, 1, 2, 3] and ids("refused") == [4, 5, 6, 7, 8, 9]


def test_held_records(spark):
    rows = [(c, t * 10 + p, T0 + timedelta(minutes=10 * t + c), t, p, f"n{(t * 3 + p * c) % 9}", (t + p) % 6 == 0) for c in range(3) for t in range(25) for p in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, id long, ts timestamp, turn long, pos long, node_id string, protected boolean")
    got = keyed_state.replayed(shuffled(df), keyed_state.held, new(), "arrives").filter("turn is not null")
    last = got.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    got = got.join(last, ["conv_id", "turn"]).selectExpr("cast(conv_id as long)", "node_id", "last_turn", "protected")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, buffer.replay(df).collect()))


def test_a_quiet_conversation_is_forgotten(spark):
    rows = [(1, i, T0 + timedelta(hours=h), i, 0, f"n{i}", True) for i, h in enumerate((0, 1, 30, 31))]
    df = spark.createDataFrame(rows, "conv_id long, id long, ts timestamp, turn long, pos long, node_id string, protected boolean")
    got = keyed_state.replayed(df, keyed_state.held, new(), "ts")
    assert sorted((r.turn, r.node_id) for r in got.filter("turn is not null").collect()) == [(0, "n0"), (1, "n0"), (1, "n1"), (2, "n2"), (3, "n2"), (3, "n3")]


def queue_events(spark):
    out = []
    for i in range(40):
        at = T0 + timedelta(hours=3 * i)
        user = i % 2
        out.append((user, at, i, "created", i % 3, i % 4))
        if i % 3 == 0:
            out.append((user, at + timedelta(hours=5), i, "snoozed", None, None))
        if i % 4 == 0:
            out.append((user, at + timedelta(hours=40), i, "answered", None, None))
    return spark.createDataFrame(out, "user_id long, ts timestamp, id long, kind string, priority_rank long, signal_rank long")


def test_queue(spark):
    events = queue_events(spark)
    want = sorted(map(tuple, keyed_state.queue_log(events, cap=6, until="2124-01-01").collect()))
    got = keyed_state.replayed(shuffled(events), lambda s: keyed_state.queue_log(s, cap=6), new(), "arrives")
    assert sorted(map(tuple, got.filter("id is not null").collect())) == want
    assert {r[3] for r in want} == {"PENDING_HITL", "SNOOZED", "AUTO_RESOLVED", "SUSPENDED_QUEUE_FULL", "ANSWERED"}


def test_queue_log_ends_in_the_state_of_the_queue(spark):
    now = "2024-01-06 12:00:00"
    events = queue_events(spark).filter(F.col("ts") <= now)
    log = keyed_state.queue_log(events, cap=6, until=now)
    last = log.groupBy("id").agg(F.max_by("state", F.struct("ts", F.lit(1))).alias("state")).filter("state <> 'ANSWERED'")
    by_kind = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    items = events.groupBy("id").agg(F.first("user_id").alias("user_id"), by_kind("created", "ts").alias("created_at"), by_kind("created", "priority_rank").alias("priority_rank"), by_kind("created", "signal_rank").alias("signal_rank"), by_kind("snoozed", "ts").alias("last_snoozed_at"), by_kind("answered", "ts").alias("answered"))
    want = sessions.queue_state(items.filter("answered is null"), now, cap=6)
    assert sorted(map(tuple, last.collect())) == sorted((r.id, r.state) for r in want.collect())


def test_decay_events(spark):
    rows = [(c, T0 + timedelta(minutes=10 * t + 300 * c), t, None if t == 0 else t - 2 if t % 3 == 2 else t - 1) for c in range(4) for t in range(8)]
    rows += [(9, T0, 0, None), (9, T0 + timedelta(minutes=5), 1, 7), (1, T0 + timedelta(days=3), 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, ts timestamp, id long, parent long")
    got = keyed_state.replayed(shuffled(df), keyed_state.decay_events, new(), "arrives").filter("turn is not null and conv_id is not null")
    first = df.filter("ts < '2024-01-03'").selectExpr("conv_id", "id as turn", "parent")
    want = graph.thread(first, first.groupBy("conv_id").agg(F.max("turn").alias("turn")))
    assert sorted((int(r.conv_id), r.pos, r.turn) for r in got.filter("ended_at < '2024-01-03'").collect()) == sorted(map(tuple, want.collect()))
    assert [(r.conv_id, r.messages, r.turn) for r in got.filter("ended_at > '2024-01-03'").collect()] == [("1", 1, 0)]


class Handle:
    """State of one key, counting the messages to it."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getValueState(self, *_):
        return self

    def _called(self, value=None):
        self.calls += 1
        return value

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def registerTimer(self, _):
        self._called()

    deleteTimer = registerTimer

    def getCurrentWatermarkInMs(self):
        return 50_000


def test_messages_to_the_state_do_not_grow_with_rows(spark):
    def calls(n):
        handle, limit = Handle(), keyed_state._Limit(3, 60)
        limit.init(handle)
        for _ in range(2):
            told = list(limit.handleInputRows(("a",), iter([Row(at=1000 * i, id=i) for i in range(n)]), handle))
        assert len(told) == min(n, 50_001)
        return handle.calls

    assert calls(10) == calls(1000) <= 10


def test_a_large_replay_is_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(keyed_state, "ROWS", 100)
    df = spark.range(2000).selectExpr("cast(id % 7 as string) key", "timestampadd(MINUTE, cast(id as int), timestamp '2024-01-01') ts", "id")
    folder = new()
    got = keyed_state.replayed(df, lambda s: keyed_state.rate_limited(s, 3, 1800), folder, "ts")
    assert len(list(Path(f"{folder}/in").glob("*.parquet"))) == 4 * 5 + 1
    assert got.filter("id is not null").count() == 2000
