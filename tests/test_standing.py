"""Boundary cases of records, previews, people, refusals and jobs."""

from datetime import date, datetime

from pyspark.sql import functions as F

from palimpsest.plans import assembly, ingest, standing

AT = datetime(2024, 1, 1)
EDGE = "edge_type string, from_id string, to_id string, invalidated_at timestamp"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_people_through_edges_of_each_kind(spark):
    records = spark.createDataFrame([("o1", "ObservationNode"), ("o2", "ObservationNode"), ("e1", "EventNode"), ("p1", "PatternNode"), ("p2", "PatternNode"), ("b1", "BeliefNode")], "node_id string, label string")
    edges = spark.createDataFrame([("mentions_obs", "o1", "ann", AT), ("mentions_obs", "o1", "ann", None), ("mentions_evt", "e1", "ann", None), ("mentions_obs", "o2", "bob", None), ("branches_to_obs_pat", "o1", "p1", None), ("branches_to_obs_pat", "o1", "p2", AT), ("reinforces_obs_bel", "o2", "b1", None)], EDGE)
    about = lambda kinds, n=10: [tuple(r) for r in standing.about_person(records, edges, "ann", kinds, n).collect()]
    assert about(["PatternNode", "ObservationNode", "EventNode", "BeliefNode", "Other"]) == [("p1", "PatternNode"), ("o1", "ObservationNode"), ("e1", "EventNode")]
    assert about(["EventNode", "ObservationNode"], 1) == [("e1", "EventNode")] and about(["Other"]) == []
    links = standing.standing_links(edges, spark.createDataFrame([("o1",), ("o1",), (None,)], "node_id string"))
    assert rows(links) == [("o1", "ann", "person", "mentions_obs"), ("o1", "p1", "pattern", "branches_to_obs_pat")]
    assert dict(map(tuple, standing.sorted_targets(links.limit(0)).collect())) == dict.fromkeys(standing.TARGET_KINDS, 0)


def test_tallies_jobs_and_scripts(spark):
    drops = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", None), ("B", "odd")], "stage string, rule string")
    assert rows(standing.tallies(drops, {"A": ("x", "y")})) == [("A", "x", 2), ("A", "y", 0), ("B", "odd", 1)]
    log = spark.createDataFrame([(1, 2, "RUNNING"), (1, 1, "PENDING"), (1, 3, "FAILED"), (1, 4, "RUNNING"), (2, 1, "PENDING")], "job_id long, seq long, status string")
    assert rows(standing.job_states(log)) == [(1, "RUNNING", 1, 4), (2, "PENDING", 0, 1)]
    said = spark.createDataFrame([(1, 0, "system", "s"), (1, 3, "user", " b "), (1, 2, "assistant", "a"), (1, 1, "user", None), (2, 0, "assistant", "only")], "conv_id long, turn long, role string, text string")
    assert rows(standing.scripts(said)) == [(1, "b", "[2] assistant: a\n[3] user: b", "[1] ASSISTANT: a\n\n[2] ME: b"), (2, None, "[0] assistant: only", "[1] ASSISTANT: only")]


def test_assembled_rows(spark):
    episodes = spark.createDataFrame([("e1", date(2024, 1, 2), 1, "REFLECTION", AT, AT, "sum", ["A Safer self", " "], "m"), ("e2", date(2024, 1, 2), 2, None, None, AT, None, None, "m")], "episode_id string, event_date date, episode_index int, entry_class string, occurred_at timestamp, recorded_at timestamp, summary string, adopted array<string>, model string")
    findings = spark.createDataFrame([("e1", 5, "EMOTION", "x", ["building a safer SELF"], "HIGH", "USER_GENERATED", 1), ("e1", 2, "FACT", None, None, "CRITICAL", "ASSISTANT", 1), ("gone", 1, "FACT", "x", None, "HIGH", "USER_GENERATED", 1)], "episode_id string, pos int, type string, content string, evidence array<string>, signal_strength string, provenance string, attempt int")
    rejected = spark.createDataFrame([("e1", 1, None, "kept as it was", "UNKNOWN_TYPE", None, 2)], "episode_id string, pos int, type string, content string, rule string, last_rule string, attempts int")
    events = spark.createDataFrame([], "episode_id string, pos int, summary string, signal_strength string")
    steps = spark.createDataFrame([("e1", 7, 9, "OUTCOME", "b"), ("e1", 7, 4, "TRIGGER", "a"), ("e1", 3, 1, "TRIGGER", "c")], "episode_id string, chain int, pos int, kind string, content string")
    out = assembly.assemble(episodes, findings, rejected, events, steps)
    got = {r.node_id: r for r in out["observations"].collect()}
    assert {k: (r.type, r.provenance, r.status) for k, r in got.items()} == {"obs_2024_01_02_01_001": ("FACT", "ASSISTANT", "ACTIVE"), "obs_2024_01_02_01_002": ("EMOTION", "CO_CREATED", "ACTIVE"), "obs_2024_01_02_01_003": ("CONTEXT", "USER_GENERATED", "EXTRACTION_FAILED")}
    assert got["obs_2024_01_02_01_003"].raw_evidence == ["extraction failed: UNKNOWN_TYPE", "attempted type: none given"]
    assert rows(out["steps"].select("node_id", "chain_id", "step_index", "content")) == [("step_2024_01_02_01_001", "chain_2024_01_02_01_001", 1, "c"), ("step_2024_01_02_01_002", "chain_2024_01_02_01_002", 1, "a"), ("step_2024_01_02_01_003", "chain_2024_01_02_01_002", 2, "b")]
    assert rows(out["sessions"].select("node_id", "signal_strength", F.size("participant_entities"))) == [("sess_2024_01_02_01_001", "CRITICAL", 2), ("sess_2024_01_02_02_001", "STANDARD", 1)]
    assert out["events"].collect() == []


def test_previews_and_histories(spark):
    df = spark.createDataFrame([("a", "PatternNode", {"pattern_name": " ", "pattern_description": " d "}), ("b", "Odd", {"event_summary": "s"}), ("c", None, {}), ("d", "BeliefNode", {"content": "x", "belief_statement": "y", "valid_from": "2024-01-02T03:04:05Z"}), ("e", "", None)], "node_id string, label string, fields map<string,string>")
    assert dict(map(tuple, df.select("node_id", assembly.card_preview(F.col("label"), F.col("fields"))).collect())) == {"a": "d", "b": "s", "c": "", "d": "y", "e": ""}
    wanted = spark.createDataFrame([(1, "d"), (2, "d"), (3, "none"), (4, None), (5, "e")], "item_id long, node_id string")
    got = {r.node_id: r for r in assembly.candidate_history(wanted, df).collect()}
    assert set(got) == {"d", "e"} and got["d"].valid_from == datetime(2024, 1, 2, 3, 4, 5) and got["d"].preview == "x" and got["e"].node_type == "unknown" and got["e"].valid_from is None


def test_candidates_of_a_target_that_has_no_vector(spark, tmp_path):
    from palimpsest.operators import vector_index

    v = spark.createDataFrame([(f"n{i}", [1.0, i / 10]) for i in range(12)], "node_id string, embedding array<double>")
    index = vector_index.build(v, str(tmp_path / "index"), cells=2, asks=0)
    records = v.selectExpr("node_id", "case when node_id = 'n1' then 'ep1' end as episode_id", "'HIGH' as signal_strength")
    targets = spark.createDataFrame([("t1", "ep1", [1.0, 0.1]), ("t2", "ep1", None), ("t3", None, [1.0, 0.1])], "target_id string, episode_id string, embedding array<double>")
    anchors = spark.createDataFrame([("ep1", "n2", 2), ("ep1", "x", 1), ("ep1", "x", 3)], "episode_id string, node_id string, pos int")
    out = {}
    for r in sorted(ingest.candidates(index, targets, records, anchors, fetch=4, keep=2, cap=3, exact=True).collect(), key=lambda r: (r.target_id, r.place)):
        out.setdefault(r.target_id, []).append((r.node_id, r.source))
    assert out["t2"] == [("x", "STRUCTURAL"), ("n2", "STRUCTURAL")] and out["t1"][:2] == out["t2"] and out["t1"][2][1] == "SEMANTIC" and out["t1"][2][0] not in ("n1", "n2")
    assert [s for _, s in out["t3"]] == ["SEMANTIC", "SEMANTIC"] and out["t3"][0][0] == "n1"
