"""Boundary cases of the scalar rules, the folds and the sources."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import ids, scoring, temporal, text
from palimpsest.operators import graph, ranking, shaping, vectors
from palimpsest.operators.vectors import cosine
from palimpsest.plans import decisions, report, retrieval
from palimpsest.sources import chat_export, sinks
from palimpsest.streaming import buffer, sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("days", "band", "weight"), [(0, "FRESH", 1.0), (29, "FRESH", 1.0), (30, "COOLING", 0.85), (179, "COOLING", 0.85), (180, "STALE", 0.7), (364, "STALE", 0.7), (365, "DORMANT", 0.5), (4000, "DORMANT", 0.5)])
def test_age(spark, days, band, weight):
    seen = F.timestamp_add("DAY", F.lit(-days), F.lit("2026-01-01").cast("timestamp"))
    assert one(spark, scoring.age_band(temporal.quiet_days(seen, "2026-01-01"))) == band
    assert one(spark, scoring.recency_weight(seen, "2026-01-01")) == weight


def test_weights(spark):
    null = F.lit(None).cast("timestamp")
    assert one(spark, temporal.quiet_days(null, "2026-01-01")) == 0
    assert one(spark, temporal.quiet_days(F.lit("2027-01-01").cast("timestamp"), "2026-01-01")) == 0
    assert [one(spark, F.round(scoring.frequency_weight(F.lit(h)), 6)) for h in ("3", "500", "lots", "-4")] == [1.3, 1.5, 1.0, 1.0]
    old = F.lit("2024-11-27").cast("timestamp")
    assert one(spark, F.round(scoring.final_score(F.lit(1.0), F.lit("CRITICAL"), old, F.lit("UNVERIFIED"), F.lit("2"), "2026-01-01"), 6)) == 0.6
    assert one(spark, scoring.final_score(F.lit(-1.0), F.lit("HIGH"), old, F.lit("VERIFIED"), F.lit("0"), "2026-01-01")) == 0.0


def test_windows(spark):
    at = F.lit("2026-05-14 10:00").cast("timestamp")
    assert one(spark, temporal.window_start("week", at)) == datetime(2026, 5, 11)
    assert one(spark, temporal.window_shift("quarter", temporal.window_start("quarter", at), -1)) == datetime(2026, 1, 1)
    assert one(spark, temporal.readable(F.lit("last Tuesday"))) is None
    assert one(spark, temporal.readable(F.lit("0"))) == datetime(1970, 1, 1)


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x]).cast("array<float>")
    assert [one(spark, cosine(a, b)) for a, b in [(v(1, 0), v(1, 0, 0)), (v(0, 0), v(1, 0)), (v(1, 0), v(-1, 0)), (v(1, 0), v(2, 0))]] == [0.0, 0.0, 0.0, 1.0]


def test_text(spark):
    said = [("um, I went uh-huh to, um, the shop umbrella", 3, "I went to, the shop umbrella"), ("plain", 0, "plain"), ("", 0, "")]
    for t, n, out in said:
        assert one(spark, text.filler_count(F.lit(t))) == n
        assert one(spark, text.strip_fillers(F.lit(t))) == out
    assert one(spark, text.is_trivial(F.lit("Yeah - interesting!"))) and not one(spark, text.is_trivial(F.lit("right, so")))
    assert one(spark, text.in_crisis(F.lit("I can't go on anymore."))) and not one(spark, text.in_crisis(F.lit(None).cast("string")))
    assert one(spark, text.overlap(F.lit("the cat sat"), F.lit("a cat sat down"))) == 1.0
    assert one(spark, text.word_overlap(F.array(F.lit("Cat"), F.lit("dog")), F.lit("concatenate"))) == 0.5
    assert one(spark, text.mentions(F.lit("Saw Ann-Marie."), F.lit("ann marie"))) and not one(spark, text.mentions(F.lit("Saw Anna"), F.lit("Ann")))
    assert one(spark, ids.versioned_id(F.lit("bel_core_values"), F.lit(2))) == "bel_core_values_v2"
    assert one(spark, ids.slug("p_", F.lit("--"))) is None
    assert one(spark, report.spread_picks(F.lit(12), 5)) == [1, 4, 7, 9, 12]


def test_thread_falls_back(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 2), (2, 0, None), (2, 5, 4), (2, 6, 5)], "conv_id long, turn long, parent long")
    leaf = spark.createDataFrame([(1, 3), (2, 6)], "conv_id long, turn long")
    got = {(r.conv_id, r.turn) for r in graph.thread(rows, leaf).collect()}
    assert got == {(1, 0), (1, 2), (1, 3), (2, 0), (2, 5), (2, 6)}


def test_version_cycle_ends(spark):
    rows = spark.createDataFrame([("a", "a", 1), ("b", "gone", 2), ("c", "b", 3)], "node_id string, previous_version_id string, version int")
    assert {r.node_id for r in graph.version_chain(spark, rows, "a").collect()} == {"a"}
    assert {r.node_id for r in graph.version_chain(spark, rows, "c").collect()} == {"b", "c"}


def test_long_version_chain(spark):
    """Hundreds of versions on either side of the one asked for; another chain and a missing predecessor stay out."""
    links = [(f"v{i}", f"v{i - 1}" if i else "gone", i) for i in range(400)] + [("w0", "gone", 1), ("w1", "w0", 2)]
    rows = spark.createDataFrame(links, "node_id string, previous_version_id string, version int")
    assert sorted(r.version for r in graph.version_chain(spark, rows, "v200").collect()) == list(range(400))
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 250}", i) for i in range(250)], "node_id string, previous_version_id string, version int")
    assert graph.version_chain(spark, ring, "r7").count() == 250


def test_a_short_version_chain_is_looked_up(spark, monkeypatch):
    """Without components of the whole table; a missing predecessor joins nothing, and an id that doesn't stand in the table finds nothing."""
    monkeypatch.setattr(graph, "connected_components", None)
    links = [("a", "gone"), ("b", "gone"), ("c", "b"), ("d", "c"), ("e", "c"), ("e", "c"), ("x", "y"), ("y", "x"), ("z", None)]
    rows = spark.createDataFrame(links, "node_id string, previous_version_id string")
    for node, want in (("b", "bcde"), ("e", "bcde"), ("a", "a"), ("x", "xy"), ("z", "z"), ("gone", ""), ("none", "")):
        assert sorted(r.node_id for r in graph.version_chain(spark, rows, node).collect()) == list(want)


def test_all_chains_end_in_cycles(spark):
    """Self-pointing, gapped and missing versions, a ring and what hangs from it, beside a long chain."""
    links = [("a", "a", 1), ("b", "gone", 2), ("c", "b", 9), ("r0", "r1", 1), ("r1", "r2", 2), ("r2", "r0", 3), ("s", "r1", 4)]
    links += [(f"v{i}", f"v{i - 1}" if i else None, 3 * i) for i in range(70)]
    rows = spark.createDataFrame(links, "node_id string, previous_version_id string, version int")
    got = {r.node_id: (r.root, r.steps) for r in graph.all_chains(rows).collect()}
    want = {"a": ("a", 0), "b": ("b", 0), "c": ("b", 1), **{x: (None, None) for x in ("r0", "r1", "r2", "s")}}
    assert got == want | {f"v{i}": ("v0", i) for i in range(70)}
    assert graph.all_chains(rows.limit(0)).count() == 0


def test_neighbourhood_limit(spark):
    """A hub with ten leaves: the limit ends the walk as soon as it is met, exactly met too, and keeps the start."""
    edges = spark.createDataFrame([("e", "hub", f"n{i}") for i in range(10)] + [("e", "n3", "far")], "edge_type string, from_id string, to_id string")
    start = spark.createDataFrame([("hub",)], "node_id string")
    walk = lambda depth, limit: (lambda seen, cut: (sorted((r.hop, r.node_id) for r in seen.collect()), cut))(*graph.neighbourhood(edges, start, depth, "both", limit))
    assert walk(3, 5) == ([(0, "hub"), *((1, f"n{i}") for i in range(4))], True)
    assert walk(1, 11) == ([(0, "hub"), *((1, f"n{i}") for i in range(10))], True)
    assert walk(3, 100) == ([(0, "hub"), *((1, f"n{i}") for i in range(10)), (2, "far")], False)
    assert walk(3, 1) == ([(0, "hub")], True)


def test_slugs_are_unique(spark):
    """Against a plain walk in order: names that look like dated or suffixed slugs of others, and taken ones among them."""
    rng = random.Random(8)
    names = ["a", "a", "a 2", "A", "a 2024 01 05", "a 2024 01 05 2", "b", "--", None]
    rows = [(i, rng.choice(names), f"2024-01-0{rng.choice([5, 5, 6])}") for i in range(80)]
    taken = ["x_b", "x_a_2024_01_05_3", "x_a_2024_01_06"]
    used, want = set(taken), {}
    for i, name, day in rows:
        base = re.sub(r"[^a-z0-9]+", "_", (name or "").lower()).strip("_")
        if base:
            dated, k = f"x_{base}_{day.replace('-', '_')}", 2
            slug = f"x_{base}" if f"x_{base}" not in used else dated
            while slug in used:
                slug, k = f"{dated}_{k}", k + 1
            used.add(slug)
        want[i] = slug if base else None
    df = spark.createDataFrame(rows, "i long, name string, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.i: r.slug for r in shaping.unique_slugs(df, "x_", "name", "day", "i", spark.createDataFrame([(t,) for t in taken], "slug string")).collect()}
    assert got == want


def test_gates_keep_what_was_claimed(spark):
    """AMBIGUOUS is possible between any records; a change recorded apart has the claimed action for its runner-up."""
    base = {"source_type": "ObservationNode", "standing": True, "target_from": datetime(2020, 1, 1), "breakthrough": False, "deviated": False, "local_extremum": False, "has_anchor": True, "delta_description": "d", "contradiction_summary": "c", "tension_summary": "t", "regulation_summary": "r"}
    cases = [("AMBIGUOUS", 1.0, None, None, None), ("AMBIGUOUS", 0.9, None, None, None), ("EVOLVE", 0.95, "BRANCH", 0.7, "BeliefNode"), ("CONTRADICT", 0.99, "BRANCH", 0.7, "BeliefNode")]
    rows = [base | {"action": a, "confidence": c, "runner_up_action": r, "runner_up_confidence": rc, "target_type": t, "n": n} for n, (a, c, r, rc, t) in enumerate(cases)]
    schema = "n int, action string, confidence double, runner_up_action string, runner_up_confidence double, target_type string, source_type string, standing boolean, target_from timestamp, breakthrough boolean, deviated boolean, local_extremum boolean, has_anchor boolean, delta_description string, contradiction_summary string, tension_summary string, regulation_summary string"
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], schema)
    got = [(r.action, r.refused_by, r.altered_by, r.runner_up_action, r.runner_up_confidence) for r in decisions.apply_gates(df, "2026-01-01").orderBy("n").collect()]
    assert got == [("AMBIGUOUS", None, None, None, None), ("AMBIGUOUS", "BELOW_THRESHOLD", None, None, None), ("BRANCH", None, "TRIAL_NOT_TRAIT", "EVOLVE", 0.95), ("CONTRADICT", None, None, "BRANCH", 0.7)]


def test_merge_and_boost(spark):
    found = spark.createDataFrame([("a", "SEMANTIC", 0.9, False), ("a", "STRUCTURAL", 0.6, False), ("b", "CONTINUITY", 0.5, True)], "node_id string, found_by string, rank_score double, boosted boolean")
    held = spark.createDataFrame([("a",), ("b",)], "node_id string")
    got = [(r.node_id, r.found_by, round(r.rank_score, 6), r.boosted) for r in ranking.merge_passes(found, held, 5).collect()]
    assert got == [("a", "STRUCTURAL", 0.78, True), ("b", "CONTINUITY", 0.5, True)]


def test_greedy_budget(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x", 90, "red fox"), (1, 1, "b", "x", 20, "blue sky"), (1, 2, "c", "y", 10, "the red fox"), (1, 3, "d", "y", 10, "green sea")], "g int, pos int, node_id string, kind string, tokens int, preview string")
    got = {r.node_id: r.reason for r in ranking.greedy_budget(rows, ["g"], 100, 4).collect()}
    assert got == {"a": None, "b": "over_budget", "c": "duplicate", "d": None}


def test_buffer():
    held = {}
    buffer.remember(held, 0, [(f"n{i}", i < 2) for i in range(3)], 3, 5)
    buffer.remember(held, 1, [("new", False)], 3, 5)
    assert set(held) == {"n0", "n1", "new"}
    buffer.remember(held, 6, [("late", True)], 3, 5)
    assert set(held) == {"n0", "n1", "late"}
    buffer.remember(held, 7, [("more", False)], 3, 5)
    assert set(held) == {"n0", "n1", "late"}


def test_sensitivity(spark):
    rows = spark.createDataFrame([("CRITICAL", "HEALTH"), ("CRITICAL", None), ("HIGH", "HEALTH"), ("CRITICAL", "CAREER")], "s string, d string")
    closed = lambda opened: [r[0] for r in rows.select(ranking.withheld(F.col("s"), F.col("d"), opened)).collect()]
    assert closed([]) == [True, True, False, False] and closed(["HEALTH"]) == [False, False, False, False]


def test_rate_limit(spark):
    rows = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, s), s) for s in range(0, 50, 5)], "key string, ts timestamp, id long")
    got = [r.allowed for r in sessions.rate_limited(rows, limit=2, seconds=20).orderBy("id").collect()]
    assert got == [True, True, False, False, True, True, False, False, True, True]


def test_triggers(spark):
    raw = spark.createDataFrame([(1, 0, "PATTERN_MENTION", True), (1, 1, "NAMED_PERSON", False), (1, 2, "NAMED_PERSON", True), (1, 3, "NAMED_PERSON", True)], "turn_id long, pos int, kind string, grounded boolean")
    assert [(r.kind, r.pos) for r in retrieval.ground_triggers(raw).orderBy("place").collect()] == [("NAMED_PERSON", 2), ("PATTERN_MENTION", 0)]


def test_chat_export(spark):
    body = '{"conversations":[{"id":"c","title":"t","lastUpdated":"2024-01-01T00:00:00Z","messages":[{"id":"1","role":"Human","content":"hi"},{"id":"2","role":"ai","content":{"parts":["a","","b"]},"timestamp":"2024-01-02T00:00:00Z"},{"id":"3","role":"user","content":[{"text":"x"},{"text":"y"}]},{"id":"4","role":"tool","content":"z"},{"id":"5","role":"user","content":"  "}]}]}'
    files = spark.createDataFrame([("a.json", body), ("b.json", "{oops")], "filename string, body string")
    got = chat_export.messages(chat_export.conversations(files)).orderBy("seq").collect()
    assert [(r.role, r.content, r.skipped) for r in got] == [("user", "hi", None), ("assistant", "a\n\nb", None), ("user", "x\n\ny", None), (None, "z", "role"), ("user", "", "empty")]
    assert [r["at"] for r in got] == [datetime(2024, 1, 1)] + [datetime(2024, 1, 2)] * 4
    assert [r.filename for r in chat_export.rejected(files).collect()] == ["b.json"]
    assert len(chat_export.conversation_ids(chat_export.messages(chat_export.conversations(files))).first().conversation_id) == 16


def test_commit_needs_its_marker(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").cast("string").alias("node_id"))
    sinks.commit({"nodes": rows}, str(tmp_path), "b1")
    rows.write.parquet(f"{tmp_path}/nodes/batch=b2")
    assert sinks.read_committed(spark, str(tmp_path), "nodes").count() == 3


def test_sinks(spark, tmp_path):
    """Records of known kinds only, lists as JSON; a report with one edge per episode; an old collection adopted once."""
    nodes = spark.createDataFrame([("a", "EventNode", ["x", "y"]), ("b", "BeliefNode", None)], "node_id string, label string, tags array<string>")
    sinks.write_nodes(nodes, str(tmp_path / "n"))
    assert {(r.node_id, r.label, r.tags) for r in spark.read.parquet(str(tmp_path / "n")).collect()} == {("a", "EventNode", '["x","y"]'), ("b", "BeliefNode", None)}
    for bad in ("Strange", None):
        with pytest.raises(ValueError, match="no such kind"):
            sinks.write_nodes(spark.createDataFrame([("c", bad)], "node_id string, label string"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2
    sinks.write_report(spark.createDataFrame([("rep", ["e1", "e2", "e1"])], "node_id string, episode_ids array<string>"), str(tmp_path / "r"), "b1")
    assert {(r.from_id, r.to_id) for r in sinks.read_committed(spark, str(tmp_path / "r"), "report_edges").collect()} == {("e1", "rep"), ("e2", "rep")}
    assert sinks.read_committed(spark, str(tmp_path / "r"), "reports").count() == 1
    assert sinks.adopt(nodes, False, str(tmp_path / "old")) and not sinks.adopt(nodes, True, str(tmp_path / "old"))
    assert spark.read.parquet(str(tmp_path / "old")).count() == 2


def test_staged_imports(spark):
    """A repeated load gives the first import; a label that stands for another conversation gets a suffix."""
    known = spark.createDataFrame([("u", "c1", "imp00001aaa", "Evening")], "user_id string, source_conversation_id string, import_id string, label string")
    new = [("u", "c1", "imp00009", "Evening"), ("u", "c2", "imp00003bbb", "Evening"), ("u", "c3", "imp00005", "Walk"), ("u", "c3", "imp00004", "Walk"), ("u", "c4", "imp00006ddd", "Walk"), ("v", "c1", "imp00007", "Evening")]
    got = chat_export.staged(spark.createDataFrame(new, known.schema), known).collect()
    assert {(r.user_id, r.source_conversation_id, r.import_id, r.new, r.label) for r in got} == {
        ("u", "c1", "imp00001aaa", False, "Evening"), ("u", "c2", "imp00003bbb", True, "Evening-c2"), ("u", "c3", "imp00004", True, "Walk"), ("u", "c4", "imp00006ddd", True, "Walk-c4"), ("v", "c1", "imp00007", True, "Evening"),
    }
    assert chat_export.stage(spark.createDataFrame(new, known.schema), known).count() == 4


def test_two_targets_make_a_burst_on_a_stream_too(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, i), "a") for i in range(5)] + [(datetime(2024, 1, 5, 0, i), "ab"[i % 2]) for i in range(5)]
    events = spark.createDataFrame(rows, "ts timestamp, target string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.bursts(stream, late="0 seconds").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.window_start, r.decisions) for r in sessions.bursts(events).collect())
    assert want and sorted((r.window_start, r.decisions) for r in spark.table("bursts").collect()) == want


def test_streams_match_tables(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, datetime(2024, 1, 1, i % 24, 0), i) for i in range(60)], "user_id long, ts timestamp, event_id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, late="0 seconds").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.user_id, r.events) for r in sessions.sessions(events).collect())
    assert sorted((r.user_id, r.events) for r in spark.table("sess").collect()) == want


def test_buffer_stream(spark, tmp_path):
    offers = spark.createDataFrame([(1, t, 0, f"n{t % 7}", t % 4 == 0) for t in range(20)], "conv_id long, turn long, pos long, node_id string, protected boolean")
    offers.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(offers.schema).parquet(str(tmp_path / "in"))
    q = buffer.stream(stream).writeStream.format("memory").queryName("held").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.node_id for r in spark.table("held").collect()} == {r.node_id for r in buffer.replay(offers).collect()}


def test_rare_people_disappear(spark):
    rows = [(f"e{i}", "common", "2024-01-01") for i in range(3000)] + [("e1", "rare", "2024-01-01")]
    was = spark.createDataFrame(rows, "episode_id string, pattern_id string, event_date string")
    gone = lambda **more: {r.pattern_id for r in report.disappearing_patterns(was.filter("false"), was, **more).collect()}
    assert gone() == {"common"}
    assert gone(rare=True) == {"common", "rare"}


def test_empty_sections_count_nothing(spark):
    parts = {"some": spark.range(3), "none": spark.range(0)}
    assert {tuple(r) for r in report.section_sizes(parts).collect()} == {("some", 3), ("none", 0)}


def test_nearest_by_kind_meet_in_bounded_tasks(spark, monkeypatch):
    """Slices and blocks of a few rows against every pair scored: equal, scaled, opposite, zero, null, short and infinite vectors."""
    monkeypatch.setattr(vectors, "_SLICE", 9)
    monkeypatch.setattr(vectors, "_BLOCK", 4)
    draw = random.Random(3)
    some = [[draw.uniform(-1, 1) for _ in range(4)] for _ in range(12)]
    odd = [None, [], [0.0] * 4, [1.0], [1.0, None, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [-x for x in some[0]], [3 * x for x in some[0]]]
    rows = [(f"n{i}", i % 2, e) for i, e in enumerate([*some, *odd, *[some[1]] * 30, *some, *[[-1.0, -1.0, -1.0, -1.0]] * 12])]
    v = spark.createDataFrame(rows, "node_id string, kind int, embedding array<double>")
    q = v.withColumn("query_id", F.substring("node_id", 2, 9).cast("int"))
    pairs = v.alias("a").join(q.alias("b"), F.expr("a.kind = b.kind and a.node_id <> b.node_id")).select("query_id", "a.node_id", cosine(F.col("a.embedding"), F.col("b.embedding")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).filter("rank <= 3")
    got = vectors.by_kind(v, q, 3).select("query_id", "node_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
