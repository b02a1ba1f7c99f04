"""Decision planning: gates in order, then the writes that each action comes to.

Decisions are rows; every gate is a column. The result of planning is rows to
append: nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ids import versioned_id
from palimpsest.functions.temporal import quiet_days

# How sure each action has to be; any other must be certain.
THRESHOLDS = {"MERGE": 0.88, "REINFORCE": 0.80, "EVOLVE": 0.93, "BRANCH": 0.75, "CONTRADICT": 0.85, "DIALECTIC": 0.88, "REGULATE": 0.82}
TIE_WINDOW = 0.05
LONG_HELD_DAYS = 180
TRIAL_CONFIDENCE = 0.98

# The edge that each action adds, and the wording that it needs.
ACTION_EDGES = {"MERGE": "same_as", "REINFORCE": "reinforces", "EVOLVE": "evolved_from", "BRANCH": "branches_to", "CONTRADICT": "contradicts", "DIALECTIC": "dialectic_with", "REGULATE": "regulates"}
REQUIRED_WORDING = {"EVOLVE": "delta_description", "CONTRADICT": "contradiction_summary", "DIALECTIC": "tension_summary", "REGULATE": "regulation_summary"}

# Allowed changes of a job's state.
TRANSITIONS = (("PENDING", "RUNNING"), ("PENDING", "CANCELLED"), ("RUNNING", "COMPLETE"), ("RUNNING", "FAILED"), ("RUNNING", "CANCELLED"), ("FAILED", "RUNNING"))


def threshold(action: Column) -> Column:
    out = F.lit(1.0)
    for name, value in THRESHOLDS.items():
        out = F.when(action == name, value).otherwise(out)
    return out


def possible(action: Column, source: Column, target: Column, standing: Column) -> Column:
    """Whether an action can join these kinds of record (target null: none is named). An open question always can."""
    lasting = target.isin("PatternNode", "BeliefNode")
    return F.coalesce(
        F.when(action == "AMBIGUOUS", F.lit(True))
        .when(action.isin("MERGE", "REINFORCE", "REGULATE", "EVOLVE"), lasting)
        .when(action == "BRANCH", F.lit(True))
        .when(action == "CONTRADICT", (source == "ObservationNode") & (target == "BeliefNode") & standing)
        .when(action == "DIALECTIC", (source == "ObservationNode") & lasting & standing),
        F.lit(False),
    )


def apply_gates(decisions: DataFrame, now: str) -> DataFrame:
    """Decisions with the first gate that refuses them (`refused_by`), the one that changed them (`altered_by`) and the action that stands.

    Columns: action, confidence, runner_up_action, runner_up_confidence,
    source_type, target_type, standing, target_from, breakthrough, deviated,
    local_extremum, has_anchor, delta_description, contradiction_summary,
    tension_summary, regulation_summary. A gate that records a decision
    separately makes it a BRANCH, and what was claimed its runner-up.
    """
    c = F.col
    ok = possible(c("action"), c("source_type"), c("target_type"), c("standing"))
    second = possible(c("runner_up_action"), c("source_type"), c("target_type"), c("standing"))
    swap = ~ok & second
    d = decisions.withColumn("_swap", swap).withColumn("_impossible", ~ok & ~second)
    swapped = {
        "action": F.when(c("_swap"), c("runner_up_action")).otherwise(c("action")),
        "confidence": F.when(c("_swap"), F.coalesce("runner_up_confidence", "confidence")).otherwise(c("confidence")),
        "runner_up_action": F.when(c("_swap"), c("action")).otherwise(c("runner_up_action")),
        "runner_up_confidence": F.when(c("_swap"), c("confidence")).otherwise(c("runner_up_confidence")),
    }
    d = d.withColumns(swapped)
    tie = F.coalesce((c("runner_up_action") != c("action")) & (F.abs(c("confidence") - c("runner_up_confidence")) < TIE_WINDOW), F.lit(False))
    long_held = c("action").isin("EVOLVE", "CONTRADICT") & (quiet_days(c("target_from"), now) > LONG_HELD_DAYS) & ~c("breakthrough") & ~c("deviated") & (c("confidence") < TRIAL_CONFIDENCE)
    extremum = (c("action") == "EVOLVE") & c("local_extremum")
    d = d.withColumn("_tie", tie).withColumn("_trial", ~c("_impossible") & ~c("_tie") & F.coalesce(long_held, F.lit(False)))
    d = d.withColumn("_extremum", ~c("_impossible") & ~c("_tie") & ~c("_trial") & extremum)
    apart = c("_trial") | c("_extremum")
    d = d.withColumn("runner_up_action", F.when(apart, c("action")).otherwise(c("runner_up_action"))).withColumn("runner_up_confidence", F.when(apart, c("confidence")).otherwise(c("runner_up_confidence")))
    d = d.withColumn("action", F.when(c("_tie") & ~c("_impossible"), "AMBIGUOUS").when(apart, "BRANCH").otherwise(c("action")))
    wording = F.lit(False)
    for action, column in REQUIRED_WORDING.items():
        wording |= (c("action") == action) & (F.trim(F.coalesce(c(column), F.lit(""))) == "")
    refused = (
        F.when(c("_impossible"), "IMPOSSIBLE_ACTION")
        .when(c("_tie"), "TIE")
        .when((c("action") == "EVOLVE") & ~c("has_anchor"), "NO_CAUSAL_ANCHOR")
        .when(wording, "MISSING_WORDING")
        .when(c("confidence") < threshold(c("action")), "BELOW_THRESHOLD")
    )
    altered = F.when(c("_trial"), "TRIAL_NOT_TRAIT").when(c("_extremum"), "LOCAL_EXTREMUM").when(c("_swap"), "IMPOSSIBLE_ACTION")
    return d.withColumn("refused_by", refused).withColumn("altered_by", altered).drop("_swap", "_impossible", "_tie", "_trial", "_extremum")


def _standing(gated: DataFrame, row: Column, needed: Column) -> DataFrame:
    """A row for each decision that stands. A filter would be pushed below the gates and repeat all of them in its condition."""
    return gated.select(F.explode(F.when(F.col("refused_by").isNull() & needed.isNotNull(), F.array(row))).alias("r")).select("r.*")


def plan_edges(gated: DataFrame) -> DataFrame:
    """The edge of each decision that stands (decision_id, source_node_id, target_node_id, version, action, confidence, at)."""
    name = F.lit(None).cast("string")
    for action, edge in ACTION_EDGES.items():
        name = F.when(F.col("action") == action, edge).otherwise(name)
    new_version = versioned_id(F.col("target_node_id"), F.col("version") + 1)
    start = F.when(F.col("action") == "EVOLVE", new_version).when(F.col("action") == "CONTRADICT", F.concat(F.lit("con_"), F.regexp_replace("decision_id", "^d_", ""))).otherwise(F.col("source_node_id"))
    end = F.when(F.col("action") == "BRANCH", F.concat(F.lit("pat_new_"), F.regexp_replace("decision_id", "^d_", ""))).otherwise(F.col("target_node_id"))
    edge = F.struct(name.alias("edge_type"), start.alias("from_id"), end.alias("to_id"), F.col("at").alias("valid_from"), "decision_id", "confidence")
    return _standing(gated, edge, name)


def bookkeeping(gated: DataFrame) -> DataFrame:
    """Counter and state changes that come with the writes."""
    what = F.when(F.col("action") == "REINFORCE", "RECORD_REINFORCEMENT").when(F.col("action") == "EVOLVE", "MARK_SUPERSEDED")
    return _standing(gated, F.struct(what.alias("operation"), F.col("target_node_id").alias("node_id"), "at"), what)


def status_after(action: Column, refused_by: Column) -> Column:
    """What a decision makes of the record or question it was about: no other column changes."""
    stands = refused_by.isNull()
    return F.when(stands & (action == "EVOLVE"), "SUPERSEDED").when(stands & (action == "REINFORCE"), "RESOLVED").when(refused_by == "TIE", "DISMISSED").otherwise("ACTIVE")


def audit_notes(gated: DataFrame) -> DataFrame:
    """One note per decision, refused ones too."""
    status = F.when(F.col("refused_by").isNull(), "ACTIVE").when(F.col("refused_by").isin("TIE", "MISSING_WORDING", "NO_CAUSAL_ANCHOR"), "PENDING_HITL").otherwise("BELOW_THRESHOLD")
    return gated.select("decision_id", "action", "source_node_id", "target_node_id", "confidence", "runner_up_action", "refused_by", "altered_by", status.alias("status"))


def next_versions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The new version of each changed record (changes: node_id, statement, at): fields carried, the number one up."""
    both = current.drop("valid_from").join(changes.select("node_id", F.col("statement").alias("_s"), F.col("at").alias("valid_from")), "node_id")
    kept = [c for c in current.columns if c not in ("node_id", "version", "previous_version_id", "statement", "valid_from")]
    return both.select(versioned_id(F.col("node_id"), F.col("version") + 1).alias("node_id"), (F.col("version") + 1).alias("version"), F.col("node_id").alias("previous_version_id"), F.coalesce("_s", "statement").alias("statement"), "valid_from", *kept)


def validate_findings(rows: DataFrame, known_types: list[str], excluded: list[str], permitted: list[str], weighty: list[str]) -> DataFrame:
    """Findings with the first rule that each breaks; null for a good one."""
    kind, signal = F.upper(F.trim("type")), F.upper(F.trim("signal_strength"))
    rule = (
        F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "EMPTY_CONTENT")
        .when(~F.coalesce(kind.isin(*known_types), F.lit(False)), "UNKNOWN_TYPE")
        .when(kind.isin(*excluded), "EXCLUDED_TYPE")
        .when(~kind.isin(*permitted), "TYPE_NOT_ALLOWED_HERE")
        .when(~F.coalesce(signal.isin("STANDARD", "HIGH", "CRITICAL"), F.lit(False)), "UNKNOWN_ENUM_VALUE")
        .when(kind.isin(*weighty) & (signal == "STANDARD"), "SIGNAL_FLOOR")
    )
    return rows.withColumn("rule", rule)


def validate_chains(steps: DataFrame, cap: int = 12) -> DataFrame:
    """Causal chains (chain_id, step, kind, content): in order and cut at the cap; a bad step or fewer than two reject the chain.

    The cut comes before the steps are gathered, so a chain of any length is `cap` rows at most in one place.
    """
    order = Window.partitionBy("chain_id").orderBy("step", "kind", "content")
    few = steps.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap)
    item = F.struct("_n", "kind", "content")
    chains = few.groupBy("chain_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    good = F.forall("s", lambda x: x["kind"].isin("TRIGGER", "INTERNAL_STATE", "ACTION", "OUTCOME", "LESSON") & (F.trim(x["content"]) != ""))
    return chains.filter((F.size("s") >= 2) & good).select("chain_id", F.posexplode("s").alias("i", "x")).select("chain_id", (F.col("i") + 1).alias("step_index"), "x.kind", "x.content")


def bad_transitions(log: DataFrame) -> DataFrame:
    """Entries of a state log (job_id, seq, status) that may not follow the one before."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed |= (F.col("before") == a) & (F.col("status") == b)
    return log.withColumn("before", before).filter(F.when(F.col("before").isNull(), F.col("status") != "PENDING").otherwise(~allowed))
