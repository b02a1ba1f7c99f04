"""A decision's plan as nested rows: the records, edges and bookkeeping of each answer, saved whole and written when it is chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import versioned_id
from palimpsest.plans.decisions import ACTION_EDGES, possible

NODE = "struct<label:string,node_id:string,at:timestamp,fields:map<string,string>>"
EDGE = "struct<edge_type:string,from_id:string,to_id:string,valid_from:timestamp,decision_id:string,confidence:double,note:string>"
MARK = "struct<operation:string,node_id:string,at:timestamp,choice:string,action:string>"
#: One answer: what it is, the record it acts on, and what it writes. `primary` names the edge that is its point.
VARIANT = f"struct<action:string,target_node_id:string,confidence:double,primary:string,nodes:array<{NODE}>,edges:array<{EDGE}>,marks:array<{MARK}>>"

_c = F.col


def _node(label: Column, node_id: Column, fields: dict[str, Column]) -> Column:
    held = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return F.struct(label.alias("label"), node_id.alias("node_id"), _c("at").alias("at"), held.alias("fields")).cast(NODE)


def _edge(name: str, start: Column, end: Column, confidence: Column, decided: bool = True, note: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("edge_type"), start.alias("from_id"), end.alias("to_id"), _c("at").alias("valid_from"), (_c("decision_id") if decided else none).alias("decision_id"),
        (confidence if decided else none).cast("double").alias("confidence"), (none if note is None else note).alias("note"),
    ).cast(EDGE)


def _mark(operation: str, node_id: Column) -> Column:
    return F.struct(F.lit(operation).alias("operation"), node_id.alias("node_id"), _c("at").alias("at"), F.lit(None).alias("choice"), F.lit(None).alias("action")).cast(MARK)


def variant(action: Column, confidence: Column) -> Column:
    """What one action comes to, as VARIANT; of a decision with these columns:

    decision_id, source_node_id, source_type, target_node_id, target_type,
    episode_id, at; version, statement (of the target, null where it isn't known);
    anchor_id; wording, delta_description, contradiction_summary, tension_summary,
    regulation_summary; promoted_label, promoted_id (the lasting record that the
    finding has earned, null for most), belief_id (what it would be as a belief).

    Arrays hold three at most. An action that lacks what it needs writes nothing:
    a version without the one before it, a link without a target, a tension
    without a lasting record. Gates are not asked here.
    """
    target, tail = _c("target_node_id"), F.regexp_replace("decision_id", "^d_", "")
    linked = target.isNotNull() & _c("target_type").isNotNull()
    said = F.when(F.trim(F.coalesce("wording", F.lit(""))) != "", _c("wording"))
    new, clash = versioned_id(target, _c("version") + 1), F.concat(F.lit("con_"), tail)
    evolved = {"statement": F.coalesce(said, _c("statement")), "version": _c("version") + 1, "previous_version_id": target, "delta_description": _c("delta_description")}
    belief = {"statement": said, "is_contradicted": F.lit("true"), "contradiction_node_id": clash}
    joint = {"belief_a_id": target, "belief_b_id": _c("belief_id"), "contradiction_summary": _c("contradiction_summary"), "decision_id": _c("decision_id")}
    lasting = _c("promoted_id").isNotNull()
    loop = _c("promoted_label") == "OpenLoopNode"
    standing = _node(_c("promoted_label"), _c("promoted_id"), {"statement": said})
    source = _c("source_node_id")
    link = lambda name, note=None: _edge(name, source, target, confidence, note=note)
    old = _c("version").isNotNull()
    anchored = F.when(_c("anchor_id").isNotNull(), _edge("caused_by", new, _c("anchor_id"), confidence))
    both = F.array(_edge("contradicts", clash, target, confidence), _edge("contradicts", clash, _c("belief_id"), confidence))
    cases = {
        "MERGE": (linked, [], F.array(link("same_as")), []),
        "REINFORCE": (linked, [], F.array(link("reinforces")), [_mark("RECORD_REINFORCEMENT", target)]),
        "EVOLVE": (linked & old, [_node(_c("target_type"), new, evolved)], F.filter(F.array(_edge("evolved_from", new, target, confidence), anchored), lambda x: x.isNotNull()), [_mark("MARK_SUPERSEDED", target)]),
        "BRANCH": (lasting, [standing], F.array(F.when(loop, _edge("investigated_by", _c("promoted_id"), _c("episode_id"), confidence, decided=False)).otherwise(_edge("branches_to", source, _c("promoted_id"), confidence))), []),
        "CONTRADICT": (target.isNotNull(), [_node(F.lit("BeliefNode"), _c("belief_id"), belief), _node(F.lit("ContradictionNode"), clash, joint)], both, []),
        "DIALECTIC": (lasting & ~F.coalesce(loop, F.lit(False)) & target.isNotNull(), [standing], F.array(_edge("dialectic_with", _c("promoted_id"), target, confidence, note=_c("tension_summary"))), []),
        "REGULATE": (linked, [], F.array(link("regulates", _c("regulation_summary"))), []),
    }

    def pick(kind: str, of) -> Column:
        out = F.array().cast(f"array<{kind}>")
        for name, (able, *parts) in cases.items():
            out = F.when((action == name) & able, of(*parts).cast(f"array<{kind}>")).otherwise(out)
        return out

    primary = F.lit(None).cast("string")
    for name, (able, *_) in cases.items():
        edge = F.when(loop, F.lit(None)).otherwise(F.lit(ACTION_EDGES[name])) if name == "BRANCH" else F.lit(ACTION_EDGES[name])
        primary = F.when((action == name) & able, edge).otherwise(primary)
    nodes, edges, marks = pick(NODE, lambda n, e, m: F.array(*n)), pick(EDGE, lambda n, e, m: e), pick(MARK, lambda n, e, m: F.array(*m))
    aimed = F.when(action != "BRANCH", target)
    return F.struct(action.alias("action"), aimed.alias("target_node_id"), confidence.cast("double").alias("confidence"), primary.alias("primary"), nodes.alias("nodes"), edges.alias("edges"), marks.alias("marks")).cast(VARIANT)


def plans(settled: DataFrame) -> DataFrame:
    """(decision_id, refused_by, plan): what each decision (action, confidence, refused_by, and the columns of variant()) writes; a refused one its note alone.

    The note of every decision is among the nodes, with a decided_by edge from each
    record that it is about.
    """
    kept = F.when(_c("refused_by").isNull(), _c("action")).otherwise("NONE")
    plan = variant(kept, _c("confidence"))
    status = F.when(_c("action") == "AMBIGUOUS", "PENDING_HITL").when(_c("refused_by").isNull(), "ACTIVE").otherwise("BELOW_THRESHOLD")
    note = _node(F.lit("DecisionAuditNode"), _c("decision_id"), {"action": _c("action"), "source_node_id": _c("source_node_id"), "target_node_id": _c("target_node_id"), "edge_type_created": _c("plan.primary"), "confidence": _c("confidence"), "status": status})
    about = F.array_distinct(F.filter(F.array(_c("source_node_id"), F.when(_c("target_type").isin("PatternNode", "BeliefNode", "ContradictionNode"), _c("target_node_id"))), lambda x: x.isNotNull()))
    decided = F.transform(about, lambda x: _edge("decided_by", x, _c("decision_id"), F.lit(None), decided=False))
    out = settled.withColumn("plan", plan)
    # The action of the plan is the decision's own, refused or not.
    whole = F.struct(_c("action").alias("action"), "target_node_id", _c("confidence").cast("double").alias("confidence"), "plan.primary", F.concat("plan.nodes", F.array(note)).alias("nodes"), F.concat("plan.edges", decided).alias("edges"), "plan.marks")
    return out.select("decision_id", "refused_by", whole.cast(VARIANT).alias("plan"))


def rows(planned: DataFrame, plan: str = "plan", keys: tuple[str, ...] = ("decision_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records, edges and bookkeeping of plans, ready for the sinks, each with the decision it comes from."""
    out = [planned.select(*keys, F.explode(f"{plan}.{part}").alias("x")) for part in ("nodes", "edges", "marks")]
    return tuple(df.select(*[F.col(k).alias(f"of_{k}") for k in keys], "x.*") for df in out)


def flaws(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(problem, id): what is wrong with plans taken together: records planned twice or there already (existing: node_id), edges with an end that isn't known."""
    nodes, edges, _ = rows(planned)
    twice = nodes.groupBy("node_id").count().filter("count > 1").select(F.lit("duplicate").alias("problem"), _c("node_id").alias("id"))
    there = nodes.join(existing.select("node_id"), "node_id", "left_semi").select(F.lit("exists").alias("problem"), _c("node_id").alias("id")).distinct()
    known = nodes.select("node_id").union(existing.select("node_id")).distinct()
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    return twice.union(there).union(ends.join(known, "node_id", "left_anti").select(F.lit("unknown end").alias("problem"), _c("node_id").alias("id")))


def freeze(held: DataFrame) -> DataFrame:
    """(decision_id, source_node_id, at, primary, runner_up, fallback, worth_asking): every answer that a held decision could be given, as VARIANT values.

    primary is the reading that was in front (`tied_action` where a tie took its
    name away), runner_up the one it nearly was, if there is one, and fallback the
    finding recorded apart. An answer that can't join these records is not offered.
    A question is worth asking only if its first two answers write an edge; the
    others are closed by close().
    """
    first = F.coalesce(_c("tied_action"), _c("action"))
    able = lambda action: F.coalesce(action.isNotNull() & (action != "AMBIGUOUS") & possible(action, _c("source_type"), _c("target_type"), _c("standing")), F.lit(False))
    made = held.select(
        "decision_id", "source_node_id", "at",
        F.when(able(first), variant(first, _c("confidence"))).alias("p"),
        F.when(able(_c("runner_up_action")) & (_c("runner_up_action") != first), variant(_c("runner_up_action"), F.coalesce("runner_up_confidence", "confidence"))).alias("r"),
        variant(F.lit("BRANCH"), _c("confidence")).alias("f"),
    )
    writes = lambda v: F.coalesce(F.size(_c(f"{v}.edges")) > 0, F.lit(False))
    saved = lambda v: F.to_variant_object(_c(v))
    return made.select("decision_id", "source_node_id", "at", saved("p").alias("primary"), saved("r").alias("runner_up"), saved("f").alias("fallback"), (writes("p") | writes("r")).alias("worth_asking"))


def close(proposals: DataFrame) -> DataFrame:
    """Bookkeeping that dismisses the questions that no answer to would change anything."""
    return proposals.filter("not worth_asking").select(F.lit("DISMISS").alias("operation"), _c("decision_id").alias("node_id"), "at", F.lit(None).cast("string").alias("choice"), F.lit(None).cast("string").alias("action"))


def resolve(proposals: DataFrame, choices: DataFrame, records: DataFrame) -> DataFrame:
    """(decision_id, choice, refused_by, plan): what the answers (decision_id, choice, at) to held decisions write.

    A choice is PRIMARY, RUNNER_UP or NEITHER (the fallback), or EXPIRED for the
    fallback that nobody chose. One that the card didn't offer is refused, and so
    is one whose target was superseded or is gone (records: node_id, status); the
    fallback has no target and is always safe. A plan's edges carry the note of the
    answer (the waiting note's id and _r) in place of the waiting one, the note is
    among the nodes, joined to the waiting one, and the bookkeeping says that it was
    answered, and how. The first answer to a decision counts.
    """
    one = choices.groupBy("decision_id").agg(F.min_by(F.struct("choice", "at"), F.struct("at", "choice")).alias("_a"))
    both = proposals.drop("at").join(one, "decision_id").select("*", "_a.*").drop("_a")
    taken = F.when(_c("choice") == "PRIMARY", _c("primary")).when(_c("choice") == "RUNNER_UP", _c("runner_up")).when(_c("choice").isin("NEITHER", "EXPIRED"), _c("fallback"))
    both = both.withColumn("v", F.variant_get(taken, "$", VARIANT))
    known = records.groupBy(F.col("node_id").alias("_id")).agg(F.max((F.col("status") == "SUPERSEDED").cast("int")).alias("_over"))
    both = both.join(known, _c("v.target_node_id") == _c("_id"), "left")
    stale = _c("v.target_node_id").isNotNull() & (F.coalesce("_over", F.lit(1)) == 1)
    refused = F.when(_c("v").isNull(), "NOT_OFFERED").when(stale, "STALE")
    answer = F.concat("decision_id", F.lit("_r"))
    edges = F.transform("v.edges", lambda e: F.when(e["decision_id"].isNotNull(), e.withField("decision_id", answer)).otherwise(e))
    nodes = F.transform("v.nodes", lambda n: F.when(F.map_contains_key(n["fields"], "decision_id"), n.withField("fields", F.transform_values(n["fields"], lambda k, x: F.when(k == "decision_id", answer).otherwise(x)))).otherwise(n))
    note = _node(F.lit("DecisionAuditNode"), answer, {"action": _c("v.action"), "source_node_id": _c("source_node_id"), "target_node_id": _c("v.target_node_id"), "edge_type_created": _c("v.primary"), "confidence": _c("v.confidence"), "status": F.lit("ACTIVE"), "model_used": F.lit("human-review"), "choice": _c("choice")})
    link = F.struct(F.lit("superseded_by").alias("edge_type"), _c("decision_id").alias("from_id"), answer.alias("to_id"), _c("at").alias("valid_from"), F.lit(None).alias("decision_id"), F.lit(None).alias("confidence"), F.lit(None).alias("note")).cast(EDGE)
    stamp = F.struct(F.lit("MARK_HITL_RESOLVED").alias("operation"), _c("decision_id").alias("node_id"), _c("at").alias("at"), _c("choice").alias("choice"), _c("v.action").alias("action")).cast(MARK)
    plan = F.struct("v.action", "v.target_node_id", "v.confidence", "v.primary", F.concat(nodes, F.array(note)).alias("nodes"), F.concat(edges, F.array(link)).alias("edges"), F.concat("v.marks", F.array(stamp)).alias("marks")).cast(VARIANT)
    return both.withColumn("refused_by", refused).select("decision_id", "choice", "refused_by", F.when(_c("refused_by").isNull(), plan).alias("plan"))
