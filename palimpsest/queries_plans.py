"""More of the catalogue: plans of decisions as rows, frozen answers, what a resolution writes, and an erasure."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from palimpsest.plans import write_plan
from palimpsest.plans.erasure_run import Erasure
from palimpsest.queries import _GATED, NOW, _found, _gated, query
from palimpsest.sources import tables
from palimpsest.sources.scratch import cut, shared_folder

_c = F.col
_ACTIONS = ("MERGE", "REINFORCE", "EVOLVE", "BRANCH", "CONTRADICT", "DIALECTIC", "REGULATE", "AMBIGUOUS")
_HELD = ("TIE", "MISSING_WORDING", "NO_CAUSAL_ANCHOR")


def _settled(spark, d):
    """The gated decisions of the catalogue with what a plan needs: half of the targets are known records, some findings have earned a lasting one."""
    e = F.regexp_replace("decision_id", "^d_", "").cast("long")
    g = cut(_gated(spark, d))
    label = F.when(e % 7 == 0, "BeliefNode").when(e % 7 == 1, "PatternNode").when(e % 7 == 2, "OpenLoopNode")
    return g.withColumns({
        "version": F.when(e % 2 == 0, 1), "statement": F.concat(F.lit("old "), "target_node_id"), "wording": F.when(e % 5 > 0, F.concat(F.lit("new "), e)), "episode_id": F.concat(F.lit("ep_"), e % 40),
        "anchor_id": F.when(_c("has_anchor"), F.concat(F.lit("ses_"), e % 40)), "promoted_label": label, "promoted_id": F.when(label.isNotNull(), F.concat(F.lit("new_"), e)), "belief_id": F.concat(F.lit("bel_"), e),
        "tied_action": F.when(_c("action") == "AMBIGUOUS", F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), (e % 8 + 1).cast("int"))),
    })


_ROWS = """
    SELECT {k}, 'NODE' AS part, 'BeliefNode' AS what, 'bel_' || event_id AS a, NULL AS b FROM {t} WHERE act = 'CONTRADICT' UNION ALL SELECT {k}, 'NODE', 'ContradictionNode', 'con_' || event_id, 'bel_' || event_id FROM {t} WHERE act = 'CONTRADICT'
    UNION ALL SELECT {k}, 'EDGE', 'contradicts', 'con_' || event_id, unnest([target_node_id, 'bel_' || event_id]) FROM {t} WHERE act = 'CONTRADICT'
    UNION ALL SELECT {k}, 'EDGE', CASE act WHEN 'MERGE' THEN 'same_as' WHEN 'REINFORCE' THEN 'reinforces' ELSE 'regulates' END, source_node_id, target_node_id FROM {t} WHERE act IN ('MERGE', 'REINFORCE', 'REGULATE') AND tt IS NOT NULL
    UNION ALL SELECT {k}, 'MARK', 'RECORD_REINFORCEMENT', target_node_id, NULL FROM {t} WHERE act = 'REINFORCE' AND tt IS NOT NULL
    UNION ALL SELECT {k}, 'NODE', tt, replace(target_node_id, '_v1', '_v2'), CASE WHEN event_id % 5 > 0 THEN 'new ' || event_id ELSE 'old ' || target_node_id END FROM {t} WHERE act = 'EVOLVE' AND tt IS NOT NULL AND event_id % 2 = 0
    UNION ALL SELECT {k}, 'EDGE', 'evolved_from', replace(target_node_id, '_v1', '_v2'), target_node_id FROM {t} WHERE act = 'EVOLVE' AND tt IS NOT NULL AND event_id % 2 = 0
    UNION ALL SELECT {k}, 'EDGE', 'caused_by', replace(target_node_id, '_v1', '_v2'), 'ses_' || event_id % 40 FROM {t} WHERE act = 'EVOLVE' AND tt IS NOT NULL AND event_id % 2 = 0 AND anchor
    UNION ALL SELECT {k}, 'MARK', 'MARK_SUPERSEDED', target_node_id, NULL FROM {t} WHERE act = 'EVOLVE' AND tt IS NOT NULL AND event_id % 2 = 0
    UNION ALL SELECT {k}, 'NODE', lab, 'new_' || event_id, CASE WHEN event_id % 5 > 0 THEN 'new ' || event_id END FROM {t} WHERE lab IS NOT NULL AND (act = 'BRANCH' OR act = 'DIALECTIC' AND lab <> 'OpenLoopNode')
    UNION ALL SELECT {k}, 'EDGE', CASE lab WHEN 'OpenLoopNode' THEN 'investigated_by' ELSE 'branches_to' END, CASE lab WHEN 'OpenLoopNode' THEN 'new_' || event_id ELSE source_node_id END, CASE lab WHEN 'OpenLoopNode' THEN 'ep_' || event_id % 40 ELSE 'new_' || event_id END FROM {t} WHERE act = 'BRANCH' AND lab IS NOT NULL
    UNION ALL SELECT {k}, 'EDGE', 'dialectic_with', 'new_' || event_id, target_node_id FROM {t} WHERE act = 'DIALECTIC' AND lab IN ('BeliefNode', 'PatternNode')"""
_LABELLED = ", lg AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 'BeliefNode' WHEN 1 THEN 'PatternNode' WHEN 2 THEN 'OpenLoopNode' END AS lab FROM gated)"


def _rows(planned, keys=("decision_id",)):
    """(keys, part, what, a, b) of every row of plans: the record's wording or second belief stands for its fields."""
    nodes, edges, marks = write_plan.rows(planned, keys=keys)
    own = [_c(f"of_{k}").alias(k) for k in keys]
    none = F.lit(None).cast("string").alias("b")
    fields = F.coalesce(F.when(_c("label") == "ContradictionNode", _c("fields")["belief_b_id"]).when(_c("label") == "DecisionAuditNode", _c("fields")["status"]).when(~F.map_contains_key("fields", "is_contradicted"), _c("fields")["statement"]))
    out = nodes.select(*own, F.lit("NODE").alias("part"), _c("label").alias("what"), _c("node_id").alias("a"), fields.alias("b"))
    out = out.union(edges.select(*own, F.lit("EDGE"), "edge_type", "from_id", "to_id"))
    return out.union(marks.select(*own, F.lit("MARK"), "operation", "node_id", F.coalesce(_c("choice"), none)))


@query(_GATED + _LABELLED + ", sd AS (SELECT *, action AS act FROM lg WHERE refused_by IS NULL), rr AS (" + _ROWS.format(k="decision_id", t="sd") + """)
    SELECT * FROM rr UNION ALL SELECT decision_id, 'NODE', 'DecisionAuditNode', decision_id, CASE WHEN action = 'AMBIGUOUS' THEN 'PENDING_HITL' WHEN refused_by IS NULL THEN 'ACTIVE' ELSE 'BELOW_THRESHOLD' END FROM lg
    UNION ALL SELECT decision_id, 'EDGE', 'decided_by', unnest(CASE WHEN tt IS NULL THEN [source_node_id] ELSE [source_node_id, target_node_id] END), decision_id FROM lg""")
def planned_writes(spark, d):
    """Every record, edge and bookkeeping row of all decisions' plans."""
    return _rows(write_plan.plans(_settled(spark, d)))


_OFFERED = _LABELLED + """, hd AS (SELECT *, ['MERGE','REINFORCE','EVOLVE','BRANCH','CONTRADICT','DIALECTIC','REGULATE','AMBIGUOUS'][event_id % 8 + 1] AS own FROM lg WHERE refused_by IN ('TIE', 'MISSING_WORDING', 'NO_CAUSAL_ANCHOR')),
    h2 AS (SELECT *, CASE WHEN action = 'AMBIGUOUS' THEN own ELSE action END AS lead FROM hd),
    o AS (SELECT *, 'PRIMARY' AS answer, lead AS act FROM h2 UNION ALL SELECT *, 'RUNNER_UP', runner_up_action FROM h2 WHERE runner_up_action <> lead UNION ALL SELECT *, 'NEITHER', 'BRANCH' FROM h2),
    v3 AS (SELECT * FROM o WHERE answer = 'NEITHER' OR CASE WHEN act IN ('MERGE','REINFORCE','REGULATE','EVOLVE') THEN tt IS NOT NULL WHEN act = 'BRANCH' THEN true WHEN act = 'CONTRADICT' THEN coalesce(tt = 'BeliefNode', false) AND standing WHEN act = 'DIALECTIC' THEN tt IS NOT NULL AND standing ELSE false END)"""


def _proposals(spark, d):
    return cut(write_plan.freeze(_settled(spark, d).filter(_c("refused_by").isin(*_HELD))))


@query(_GATED + _OFFERED + _ROWS.format(k="decision_id, answer", t="v3"))
def frozen_plans(spark, d):
    """The rows of every answer that the held decisions were saved with, read back from what was saved."""
    held = _proposals(spark, d)
    one = lambda name, v: held.select("decision_id", F.lit(name).alias("answer"), F.variant_get(v, "$", write_plan.VARIANT).alias("plan")).filter("plan is not null")
    every = one("PRIMARY", "primary").union(one("RUNNER_UP", "runner_up")).union(one("NEITHER", "fallback"))
    return _rows(every, ("decision_id", "answer"))


_CHOSEN = _OFFERED + """, ch AS (SELECT h2.decision_id, h2.event_id AS eid, CASE h2.event_id % 3 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'RUNNER_UP' ELSE 'NEITHER' END AS choice FROM h2),
    pk AS (SELECT ch.decision_id AS did, ch.choice, v3.* FROM ch LEFT JOIN v3 ON v3.decision_id = ch.decision_id AND v3.answer = ch.choice),
    rs AS (SELECT *, CASE WHEN act IS NULL THEN 'NOT_OFFERED' WHEN act <> 'BRANCH' AND target_node_id IN ('pat_1_v1', 'pat_9_v1') THEN 'STALE' END AS no FROM pk), ok AS (SELECT * FROM rs WHERE no IS NULL)"""


def _resolved(spark, d):
    """Answers by turns; one target was superseded meanwhile, one is gone."""
    held = _proposals(spark, d)
    e = F.regexp_replace("decision_id", "^d_", "").cast("long")
    choice = F.when(e % 3 == 0, "PRIMARY").when(e % 3 == 1, "RUNNER_UP").otherwise("NEITHER")
    choices = held.select("decision_id", choice.alias("choice"), F.timestamp_add("DAY", F.lit(1), "at").alias("at"))
    records = spark.range(20).select(F.concat(F.lit("pat_"), "id", F.lit("_v1")).alias("node_id"), F.when(_c("id") == 1, "SUPERSEDED").otherwise("ACTIVE").alias("status")).filter("node_id <> 'pat_9_v1'")
    return write_plan.resolve(held, choices, records)


@query(_GATED + _CHOSEN + " SELECT did AS decision_id, choice, no AS refused_by FROM rs")
def answers_taken(spark, d):
    """Which answers can be taken, and why the others can't."""
    return _resolved(spark, d).select("decision_id", "choice", "refused_by")


@query(_GATED + _CHOSEN + ", rr AS (" + _ROWS.format(k="decision_id, CASE WHEN false THEN '' END AS stamp", t="ok") + """)
    SELECT decision_id, part, what, a, b, CASE WHEN part = 'EDGE' AND what <> 'investigated_by' THEN decision_id || '_r' END AS decided FROM rr
    UNION ALL SELECT did, 'NODE', 'DecisionAuditNode', did || '_r', 'ACTIVE', NULL FROM ok UNION ALL SELECT did, 'EDGE', 'superseded_by', did, did || '_r', NULL FROM ok UNION ALL SELECT did, 'MARK', 'MARK_HITL_RESOLVED', did, choice, NULL FROM ok""")
def resolution_writes(spark, d):
    """The rows that the answers write: edges under the note of the answer, that note, its link to the waiting one, and the stamp."""
    plans = _resolved(spark, d).filter("plan is not null")
    _, edges, _ = write_plan.rows(plans)
    stamps = edges.select(_c("of_decision_id").alias("decision_id"), F.lit("EDGE").alias("part"), _c("edge_type").alias("what"), _c("from_id").alias("a"), _c("to_id").alias("b"), _c("decision_id").alias("decided"))
    others = _rows(plans).filter("part <> 'EDGE'").withColumn("decided", F.lit(None).cast("string"))
    return others.unionByName(stamps)


@query(_GATED + _OFFERED + """ SELECT decision_id AS node_id, 'DISMISS' AS operation FROM h2 WHERE NOT EXISTS (SELECT 1 FROM v3 WHERE v3.decision_id = h2.decision_id AND answer <> 'NEITHER' AND (act IN ('MERGE', 'REINFORCE', 'REGULATE') OR act = 'CONTRADICT' OR act = 'EVOLVE' AND event_id % 2 = 0
    OR act = 'BRANCH' AND lab IS NOT NULL OR act = 'DIALECTIC' AND lab IN ('BeliefNode', 'PatternNode')))""")
def closed_questions(spark, d):
    """Held decisions that are dismissed, as no answer would change anything."""
    return write_plan.close(_proposals(spark, d)).select("node_id", "operation")


_ERASED = """, m AS (SELECT 'graph' AS step, count(*) FILTER (user_id = 5) AS n, count(*) AS total FROM f UNION ALL SELECT 'index', count(*) FILTER (vec_id % 50 = 5), count(*) FILTER (vec_id % 50 <> 5) FROM embeddings
    UNION ALL SELECT 'messages', count(*) FILTER (conv_id % 10 = 5), count(*) FROM conversations UNION ALL SELECT 'summaries', count(DISTINCT conv_id) FILTER (conv_id % 10 = 5), count(DISTINCT conv_id) FROM conversations
    UNION ALL SELECT 'coreference notes', count(DISTINCT conv_id) FILTER (conv_id % 10 = 5 AND role = 'system'), count(DISTINCT conv_id) FILTER (conv_id % 10 <> 5 AND role = 'system') FROM conversations
    UNION ALL SELECT 'uploads', count(*) FILTER (page_id % 10 = 5), count(*) FROM pages UNION ALL SELECT 'review queue', count(*) FILTER (user_id = 5 AND type = 'error'), count(*) FILTER (type = 'error') FROM f
    UNION ALL SELECT 'settings', count(DISTINCT type) FILTER (user_id = 5), count(DISTINCT user_id || type) FILTER (user_id <> 5) FROM f)"""


@query(_ERASED + " SELECT step, n AS changed, total AS left_over FROM m")
def erasure_run(spark, d):
    """A user's erasure over a store made of the tables: what each step changed, and how many rows are there afterwards."""
    found, t = _found(spark, d), lambda name: tables.read(spark, d, name)
    talks, pages = t("conversations"), t("pages")
    session = lambda column: F.concat(F.lit("s"), column).alias("session_id")
    own = F.concat(F.lit("u"), "user_id").alias("user_id")
    store = {
        "nodes": found.select("node_id", _c("type").alias("content"), "person"),
        "vectors": tables.vectors(spark, d).select("node_id", "embedding"),
        "messages": talks.select(session(_c("conv_id")), "turn", _c("text").alias("content")),
        "sessions": talks.groupBy(session(_c("conv_id"))).agg(F.max("text").alias("rolling_summary")),
        "coreferences": talks.filter("role = 'system'").select(session(_c("conv_id"))).distinct().withColumn("ref", F.lit("he")),
        "imports": pages.select(session(_c("page_id")), _c("url").alias("title"), _c("url").alias("filename")),
        "queue": found.filter("type = 'error'").select(own, _c("node_id").alias("context_summary")),
        "settings": found.select(own, _c("type").alias("name")).distinct(),
    }
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    for name, df in store.items():
        df.withColumn("bucket", F.pmod(F.xxhash64(df.columns[0]), F.lit(4)).cast("int")).write.partitionBy("bucket").parquet(f"{root}/{name}")
    nodes = found.filter("user_id = 5").select("node_id").union(tables.vectors(spark, d).filter("vec_id % 50 = 5").select("node_id"))
    sessions = talks.filter("conv_id % 10 = 5").select(session(_c("conv_id"))).union(pages.filter("page_id % 10 = 5").select(session(_c("page_id")))).distinct()
    sessions = sessions.join(talks.filter("conv_id % 10 <> 5").select(session(_c("conv_id"))), "session_id", "left_anti")
    users = spark.createDataFrame([("u5",)], "user_id string")
    run = Erasure(root)
    run.run(spark, "u5", NOW, {"nodes": nodes, "sessions": sessions, "users": users})
    done = run.entries(spark).filter("status = 'DONE'").select("step", _c("rows").alias("changed"))
    left = [spark.read.parquet(f"{root}/{c.folder}").agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(c.name).alias("step"), "left_over") for c in run.contents]
    return done.join(reduce(lambda a, b: a.unionByName(b), left), "step")
