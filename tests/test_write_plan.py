"""Plans as nested rows: saved, read back, chosen, refused."""

from datetime import datetime

from palimpsest.plans import write_plan

AT = datetime(2024, 1, 1)
COLUMNS = "decision_id string, action string, tied_action string, confidence double, runner_up_action string, runner_up_confidence double, refused_by string, source_node_id string, source_type string, target_node_id string, target_type string, standing boolean, episode_id string, at timestamp, version int, statement string, anchor_id string, wording string, delta_description string, contradiction_summary string, tension_summary string, regulation_summary string, promoted_label string, promoted_id string, belief_id string"
BASE = {"decision_id": "d_1", "action": "MERGE", "confidence": 0.9, "source_node_id": "obs_1", "source_type": "ObservationNode", "target_node_id": "bel_9", "target_type": "BeliefNode", "standing": True, "episode_id": "ep_1", "at": AT, "version": 3, "statement": "old", "belief_id": "bel_new"}


def rows(spark, *changes):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple({**BASE, **c}.get(n) for n in names) for c in changes], COLUMNS)


def plan_of(spark, **change):
    return write_plan.plans(rows(spark, change)).first().plan


def test_what_an_action_lacks_is_not_written(spark):
    assert [(e.edge_type, e.from_id, e.to_id) for e in plan_of(spark).edges] == [("same_as", "obs_1", "bel_9"), ("decided_by", "obs_1", "d_1"), ("decided_by", "bel_9", "d_1")]
    evolved = plan_of(spark, action="EVOLVE", wording=" ", anchor_id="ses_1", delta_description="less")
    assert [(n.label, n.node_id, dict(n.fields)) for n in evolved.nodes][0] == ("BeliefNode", "bel_9_v4", {"statement": "old", "version": "4", "previous_version_id": "bel_9", "delta_description": "less"})
    assert [e.edge_type for e in evolved.edges] == ["evolved_from", "caused_by", "decided_by", "decided_by"] and [m.operation for m in evolved.marks] == ["MARK_SUPERSEDED"]
    for change in ({"action": "EVOLVE", "version": None}, {"action": "MERGE", "target_node_id": None}, {"action": "BRANCH"}, {"action": "DIALECTIC", "promoted_label": "OpenLoopNode", "promoted_id": "loop_1"}, {"action": "AMBIGUOUS"}, {"refused_by": "TIE"}, {"action": None}):
        plan = plan_of(spark, **change)
        assert [n.label for n in plan.nodes] == ["DecisionAuditNode"] and {e.edge_type for e in plan.edges} == {"decided_by"} and plan.marks == [] and plan.primary is None
    loop = plan_of(spark, action="BRANCH", promoted_label="OpenLoopNode", promoted_id="loop_1")
    assert [(e.edge_type, e.to_id, e.decision_id) for e in loop.edges][0] == ("investigated_by", "ep_1", None) and loop.primary is None


def test_plans_are_judged_together(spark):
    planned = write_plan.plans(rows(spark, {"action": "BRANCH", "promoted_label": "BeliefNode", "promoted_id": "bel_x"}, {"decision_id": "d_2", "action": "BRANCH", "promoted_label": "BeliefNode", "promoted_id": "bel_x"}, {"decision_id": "d_3", "target_node_id": "gone"}))
    there = spark.createDataFrame([("obs_1",), ("bel_9",), ("d_3",)], "node_id string")
    assert sorted(map(tuple, write_plan.flaws(planned, there).collect())) == [("duplicate", "bel_x"), ("exists", "d_3"), ("unknown end", "gone")]


def test_answers(spark, tmp_path):
    held = rows(
        spark,
        {"action": "CONTRADICT", "wording": "w", "runner_up_action": "MERGE"},
        {"decision_id": "d_2", "action": "AMBIGUOUS", "tied_action": "MERGE", "target_node_id": "bel_old"},
        {"decision_id": "d_3", "action": "REGULATE", "target_node_id": "nowhere"},
        {"decision_id": "d_4", "action": "MERGE", "target_type": None, "target_node_id": None},
    )
    write_plan.freeze(held).write.parquet(str(tmp_path / "held"))
    saved = spark.read.parquet(str(tmp_path / "held"))
    assert {r.decision_id: r.worth_asking for r in saved.collect()} == {"d_1": True, "d_2": True, "d_3": True, "d_4": False}
    assert [(r.operation, r.node_id) for r in write_plan.close(saved).collect()] == [("DISMISS", "d_4")]
    records = spark.createDataFrame([("bel_9", "ACTIVE"), ("bel_9", None), ("bel_old", "SUPERSEDED")], "node_id string, status string")
    late = datetime(2024, 2, 1)
    choices = spark.createDataFrame([("d_1", "PRIMARY", AT), ("d_1", "RUNNER_UP", late), ("d_2", "PRIMARY", late), ("d_3", "PRIMARY", late), ("d_4", "RUNNER_UP", late), ("d_9", "PRIMARY", late)], "decision_id string, choice string, at timestamp")
    got = {r.decision_id: r for r in write_plan.resolve(saved, choices, records).collect()}
    assert {k: r.refused_by for k, r in got.items()} == {"d_1": None, "d_2": "STALE", "d_3": "STALE", "d_4": "NOT_OFFERED"}
    plan = got["d_1"].plan
    assert got["d_2"].plan is None and got["d_1"].choice == "PRIMARY"
    assert {e.decision_id for e in plan.edges if e.edge_type == "contradicts"} == {"d_1_r"}
    assert [n.fields["decision_id"] for n in plan.nodes if n.label == "ContradictionNode"] == ["d_1_r"]
    assert [(n.node_id, n.fields["choice"]) for n in plan.nodes if n.label == "DecisionAuditNode"] == [("d_1_r", "PRIMARY")]
    assert [(m.operation, m.choice, m.action) for m in plan.marks] == [("MARK_HITL_RESOLVED", "PRIMARY", "CONTRADICT")]
    apart = write_plan.resolve(saved, spark.createDataFrame([("d_2", "EXPIRED", late)], choices.schema), records).first()
    assert apart.refused_by is None and apart.plan.action == "BRANCH"
    assert write_plan.resolve(saved.limit(0), choices, records).collect() == []
