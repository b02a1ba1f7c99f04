"""More of the catalogue: reads that follow records, retrieval as one flow, writes, extraction, and whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ids, scoring, temporal, text
from palimpsest.operators import graph, overlap, ranking, reads, scans
from palimpsest.plans import decisions, erasure, extraction, report, retrieval, writing
from palimpsest.queries import NEXT_WEEK, NOW, WEEK, _COS, _STOP, _found, _gated, _GATED, _previous, _score, _vector, _week, query
from palimpsest.sources import sinks, tables
from palimpsest.sources.scratch import cut
from palimpsest.streaming import sessions

_c = F.col


def _label(e):
    """Kinds of record for the findings, by their type."""
    return F.when(e == "view", "PatternNode").when(e == "signup", "BeliefNode").when(e == "purchase", "OpenLoopNode").when(e == "click", "EventNode").otherwise("ObservationNode")


_LABEL = "CASE type WHEN 'view' THEN 'PatternNode' WHEN 'signup' THEN 'BeliefNode' WHEN 'purchase' THEN 'OpenLoopNode' WHEN 'click' THEN 'EventNode' ELSE 'ObservationNode' END"
_STATUS = "CASE WHEN value >= 150 THEN 'SUPERSEDED' WHEN value >= 140 THEN 'SUPPRESSED' WHEN value >= 120 THEN NULL ELSE 'ACTIVE' END"
_DOMAIN = "CASE floor(value / 10) % 4 WHEN 0 THEN 'HEALTH' WHEN 1 THEN 'CAREER' WHEN 2 THEN 'RELATIONAL' END"
#: Records of the data directory with the label, state, domain and era that the flows read.
_REC = f", rec AS (SELECT *, {_LABEL} AS label, {_STATUS} AS status, {_DOMAIN} AS domain, strftime(occurred_at, '%Y_%m') AS era FROM f)"


def _records(spark, d):
    v = _c("value")
    status = F.when(v >= 150, "SUPERSEDED").when(v >= 140, "SUPPRESSED").when(v >= 120, None).otherwise("ACTIVE")
    band = F.floor(v / 10) % 4
    domain = F.when(band == 0, "HEALTH").when(band == 1, "CAREER").when(band == 2, "RELATIONAL")
    return _found(spark, d).withColumns({"label": _label(_c("type")), "status": status, "domain": domain, "era": F.date_format("occurred_at", "yyyy_MM"), "at": _c("occurred_at")})


# Scans and reads


@query(""", r AS (SELECT 'rep_' || pattern_id || '_' || strftime(date_trunc('week', occurred_at), '%Y_%m_%d') AS node_id, 'WEEKLY' AS report_type, CAST(date_trunc('week', occurred_at) AS DATE) AS period_start, max(occurred_at) AS created_at FROM f GROUP BY 1, 2, 3)
    SELECT node_id FROM r WHERE period_start = DATE '2024-01-08' ORDER BY created_at DESC, node_id LIMIT 5""")
def report_scan(spark, d):
    """One report for each pattern and week with findings, written when the last of them came in."""
    start = F.date_trunc("week", "occurred_at")
    made = _found(spark, d).groupBy("pattern_id", start.alias("start")).agg(F.max("occurred_at").alias("created_at"))
    reports = made.select(F.concat(F.lit("rep_"), "pattern_id", F.date_format("start", "_yyyy_MM_dd")).alias("node_id"), F.lit("WEEKLY").alias("report_type"), _c("start").cast("date").alias("period_start"), "created_at")
    keep = scans.listing_filter(equal={"type": (_c("report_type"), "WEEKLY"), "start": (_c("period_start"), WEEK)})
    return scans.page(reports.filter(keep), "created_at", 5).select("node_id")


@query("SELECT 'vec_' || vec_id AS node_id, label AS kind, len(embedding) AS width FROM embeddings WHERE 'vec_' || vec_id > 'vec_3' ORDER BY 1 LIMIT 200", base=False)
def vector_page(spark, d):
    return scans.after(tables.vectors(spark, d), "vec_3", 200).select("node_id", "kind", F.size("embedding").cast("long").alias("width"))


@query("SELECT pos, vec_id, label AS kind FROM embeddings JOIN (SELECT min(i) AS pos, i * 7 % 60 AS vec_id FROM range(0, 90) r(i) GROUP BY 2) USING (vec_id)", base=False)
def vectors_by_id(spark, d):
    wanted = spark.range(90).select(_c("id").alias("pos"), F.concat(F.lit("vec_"), _c("id") * 7 % 60).alias("node_id"))
    return scans.by_ids(tables.vectors(spark, d), wanted).select("pos", "vec_id", "kind")


@query(_REC + " SELECT node_id, label FROM rec WHERE label IN ('PatternNode', 'OpenLoopNode') AND (label = 'OpenLoopNode' OR domain = 'CAREER') AND era = '2024_01' ORDER BY occurred_at DESC, node_id LIMIT 40 OFFSET 5")
def mixed_listing(spark, d):
    """Several kinds at once; open loops have no domain, so that filter isn't asked of them."""
    r = _records(spark, d)
    keep = scans.listing_filter(kind=_c("label"), kinds=["PatternNode", "OpenLoopNode"], equal={"era": (_c("era"), "2024_01")}) & scans.listing_filter(equal={"domain": (_c("domain"), "CAREER")}, answers=_c("label") != "OpenLoopNode")
    return scans.page(r.filter(keep), "occurred_at", 40, 5).select("node_id", "label")


@query(_REC + " SELECT label, count(*) AS n, count(*) FILTER (label IN ('EventNode', 'OpenLoopNode') OR coalesce(status = 'ACTIVE', false)) AS active, count(*) FILTER (label <> 'OpenLoopNode' AND coalesce(status, '') <> 'SUPERSEDED') AS live, count(*) FILTER (coalesce(status, '') = 'SUPERSEDED') AS retired FROM rec GROUP BY 1")
def live_records(spark, d):
    r = _records(spark, d)
    machinery = F.when(_c("label") == "OpenLoopNode", "DecisionAuditNode").otherwise(_c("label"))
    count = lambda cond, name: F.count_if(cond).alias(name)
    return r.groupBy(reads.kind_of(_c("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"), count(scans.active(_c("label"), _c("status"), ["EventNode", "OpenLoopNode"]), "active"), count(reads.live_content(machinery, _c("status")), "live"), count(reads.retired(_c("status")), "retired"))


@query(", kept AS (SELECT * FROM f WHERE occurred_at <= TIMESTAMP '2024-01-12' OR node_id = 'obs_3') SELECT DISTINCT edge_type, from_id, to_id FROM g WHERE edge_type = 'contains_obs' AND to_id IN (SELECT node_id FROM kept) AND from_id IN (SELECT episode_id FROM kept WHERE occurred_at <= TIMESTAMP '2024-01-12')")
def slice_as_of(spark, d):
    """A slice as of a day: later findings go, but for the start, and so do edges that lost an end."""
    found = _found(spark, d)
    nodes = found.select("node_id", _c("occurred_at").alias("valid_from")).unionByName(tables.episodes(found.filter(temporal.node_as_of(_c("occurred_at"), "2024-01-12"))).select(_c("episode_id").alias("node_id"), _c("occurred_at").alias("valid_from")))
    start = spark.createDataFrame([("obs_3",)], "node_id string")
    edges = tables.edges(found).filter("edge_type = 'contains_obs'")
    return graph.drop_after(nodes, edges, "2024-01-12", start)[1].select("edge_type", "from_id", "to_id").distinct()


@query(" SELECT node_id, action FROM dec WHERE target_node_id = 'pat_7'")
def decision_history(spark, d):
    notes = tables.decisions(_found(spark, d))
    edges = writing.decided_by(notes.withColumn("decision_id", _c("node_id")).withColumn("source_node_id", F.lit(None).cast("string")))
    return reads.decision_history(edges, notes, "pat_7").select("node_id", "action")


@query(" SELECT DISTINCT 'decided_by' AS edge_type, unnest([source_node_id, target_node_id]) AS from_id, node_id AS to_id FROM dec")
def decided_by_edges(spark, d):
    return writing.decided_by(tables.decisions(_found(spark, d)).withColumn("decision_id", _c("node_id")))


_STEPS = ", st AS (SELECT 'chain_' || episode_id AS chain_id, node_id, row_number() OVER (PARTITION BY episode_id ORDER BY occurred_at, event_id) AS step_index FROM f)"


@query(_STEPS + " SELECT node_id, step_index FROM st WHERE chain_id = (SELECT 'chain_' || min(episode_id) FROM f WHERE user_id = 3)")
def causal_chain(spark, d):
    found = _found(spark, d)
    from pyspark.sql import Window

    steps = found.withColumn("step_index", F.row_number().over(Window.partitionBy("episode_id").orderBy("occurred_at", "event_id")))
    chain = F.concat(F.lit("chain_"), "episode_id")
    edges = steps.select(F.lit("chain_contains").alias("edge_type"), chain.alias("from_id"), _c("node_id").alias("to_id"))
    first = found.filter("user_id = 3").agg(F.min(chain)).first()[0]
    return reads.chain_steps(edges, steps, first or "none").select("node_id", "step_index")


@query(_REC + " SELECT node_id, label FROM rec WHERE label IN ('PatternNode', 'BeliefNode') AND era = '2024_01' ORDER BY node_id LIMIT 10")
def era_lookup(spark, d):
    r = _records(spark, d).withColumn("era_tag", _c("era")).withColumn("historical_era", F.lit(None).cast("string"))
    return reads.by_era(r, "2024_01", ["PatternNode", "BeliefNode"], 10).select("node_id", "label")


@query(" SELECT node_id, episode_id FROM f")
def finding_episodes(spark, d):
    return reads.episode_of(tables.edges(_found(spark, d)))


@query(f"WITH s AS (SELECT a.vec_id, {_COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 7), t AS (SELECT * FROM s ORDER BY s DESC, 'vec_' || vec_id LIMIT 30) SELECT 'vec_' || vec_id AS node_id, label AS kind, floor(s * 1e5 + 0.5) / 1e5 AS similarity FROM t JOIN embeddings USING (vec_id) WHERE vec_id % 3 > 0", base=False)
def hit_hydration(spark, d):
    """Search hits read back; a hit whose record is gone is dropped."""
    from palimpsest.operators import vectors

    v = tables.vectors(spark, d)
    hits = vectors.top_k(v, _vector(spark, d), 30).select("node_id", _c("score").alias("similarity"))
    return _score(reads.hydrate(hits, v.filter("vec_id % 3 > 0")), "similarity").select("node_id", "kind", "similarity")


@query(""", start AS (SELECT chain, version FROM v WHERE node_id = 'bel_100'), t AS (SELECT chain, version, node_id AS token_id, lead(node_id) OVER (PARTITION BY chain ORDER BY version) AS rotated_to FROM v)
    SELECT token_id, rotated_to, CASE WHEN (chain, 1) IN (SELECT chain, 1 FROM start) AND t.version >= (SELECT version FROM start) THEN TIMESTAMP '2024-02-01' END AS revoked_at FROM t""")
def revoked_tokens(spark, d):
    from pyspark.sql import Window

    v = tables.versions(spark, d)
    tokens = v.select(_c("node_id").alias("token_id"), F.lead("node_id").over(Window.partitionBy("chain").orderBy("version")).alias("rotated_to"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return reads.revoke_chain(tokens, "bel_100", NOW)


@query(_REC + " SELECT user_id, count(*) FILTER (type = 'error') AS pending, count(*) FILTER (type = 'error' AND value > 60) AS asked, min(occurred_at) FILTER (type = 'error') AS oldest FROM rec GROUP BY 1")
def queue_counts(spark, d):
    items = _found(spark, d).select("user_id", F.when(_c("type") == "error", "PENDING_HITL").otherwise("RESOLVED").alias("status"), F.when(_c("value") > 60, _c("occurred_at")).alias("asked_at"), _c("occurred_at").alias("created_at"))
    return reads.queue_counts(items)


@query(" SELECT user_id, event_date AS day, events FROM (SELECT user_id, event_date, count(*) AS events, row_number() OVER (PARTITION BY user_id ORDER BY event_date DESC) AS r FROM f WHERE event_date < DATE '2024-01-20' AND event_date >= DATE '2024-01-06' GROUP BY 1, 2) WHERE r <= 3")
def recent_conversations(spark, d):
    days = sessions.daily(_found(spark, d).withColumn("ts", _c("occurred_at")))
    return reads.recent_days(days, "2024-01-20", 3).select("user_id", _c("day").cast("date").alias("day"), "events")


@query(" SELECT event_id FROM f WHERE user_id = 5 ORDER BY occurred_at DESC, node_id LIMIT 50")
def recent_jobs(spark, d):
    return scans.page(_found(spark, d).filter("user_id = 5"), "occurred_at", 50).select("event_id")


@query(" SELECT episode_id, count(*) - 2 AS dropped FROM f GROUP BY 1 HAVING count(*) > 2")
def capped_findings(spark, d):
    return reads.cap_with_loss(_found(spark, d), ["episode_id"], ["occurred_at", "event_id"], 2)[1]


@query(" SELECT episode_id, lower(type) AS key, arg_min(CASE WHEN event_id % 2 = 0 THEN upper(type) ELSE type END, (occurred_at, event_id)) AS name FROM f GROUP BY 1, 2")
def distinct_names(spark, d):
    named = _found(spark, d).withColumn("name", F.when(_c("event_id") % 2 == 0, F.upper("type")).otherwise(F.concat(F.lit(" "), "type", F.lit(" "))))
    return reads.distinct_names(named, ["episode_id"], "name", ["occurred_at", "event_id"])


@query(" SELECT DISTINCT user_id AS session_id, pattern_id AS node_id FROM f WHERE (user_id, pattern_id) NOT IN (SELECT user_id, pattern_id FROM q)")
def claimed_hits(spark, d):
    found = _found(spark, d)
    hits = lambda rows: rows.select(_c("user_id").alias("session_id"), _c("pattern_id").alias("node_id"))
    return reads.claim_hits(hits(found), hits(_previous(spark, d)))


@query(" SELECT pattern_id AS node_id, evidence_count + (SELECT count(*) FROM w WHERE w.pattern_id = p.pattern_id AND type = 'click') AS mention_count FROM p")
def mention_counts(spark, d):
    records = tables.patterns(_found(spark, d)).select(_c("pattern_id").alias("node_id"), _c("evidence_count").alias("mention_count"))
    return reads.counters(records, _week(spark, d).filter("type = 'click'").select(_c("pattern_id").alias("node_id")), "mention_count")


_LATE = ", x AS (SELECT *, occurred_at + to_days(CAST(CASE WHEN value > 90 THEN 9 WHEN value > 60 THEN 3 ELSE 0 END AS INT)) AS written_at FROM w)"


@query(_LATE + """ SELECT 'rep_weekly_2024_01_08' AS report_id, count(*) AS findings FROM x WHERE written_at < TIMESTAMP '2024-01-16'
    UNION ALL SELECT 'rep_weekly_2024_01_08_r2', count(*) FROM x""")
def late_findings(spark, d):
    """A week's report as it stood when its grace ended, and made anew when what came late is asked for."""
    v = _c("value")
    written = F.timestamp_add("DAY", F.when(v > 90, 9).when(v > 60, 3).otherwise(0), "occurred_at")
    found = _found(spark, d).withColumn("written_at", written)
    name = lambda n: reads.report_id(F.lit("WEEKLY"), F.lit(WEEK).cast("date"), F.lit(n)).alias("report_id")
    run = lambda n, forced: reads.report_rows(found, WEEK, NEXT_WEEK, 1, forced).agg(F.count(F.lit(1)).alias("findings")).select(name(n), "findings")
    return run(0, False).unionByName(run(1, True))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS parent, text FROM conversations), l AS (SELECT conv_id, max(turn) AS last FROM m GROUP BY 1),
    n AS (SELECT m.conv_id, last + 1 AS turn, parent, 'again: ' || text AS text FROM m JOIN l USING (conv_id) WHERE turn = 2)
    SELECT conv_id, turn FROM n UNION ALL SELECT m.conv_id, m.turn FROM m JOIN n USING (conv_id) WHERE m.turn < 2
    UNION ALL SELECT conv_id, turn FROM m WHERE conv_id NOT IN (SELECT conv_id FROM n)""", base=False)
def revised_thread(spark, d):
    """The third turn of each conversation revised: the active thread ends with the new wording, the old branch stays aside."""
    t = _c("turn")
    m = tables.read(spark, d, "conversations").select("conv_id", "turn", F.when(t > 0, t - 1).alias("parent"), "text")
    log, leaf = reads.revise(m, m.filter("turn = 2").select("conv_id", "turn", F.concat(F.lit("again: "), "text").alias("text")))
    return graph.thread(log, leaf).select("conv_id", "turn")


# Sinks


@query(" SELECT edge_type, from_id, to_id FROM g WHERE from_id IN (SELECT node_id FROM w) AND edge_type = 'reinforces_obs_pat' AND to_id IN (SELECT pattern_id FROM p WHERE evidence_count % 2 = 0)")
def valid_edges(spark, d):
    found = _found(spark, d)
    nodes = _week(spark, d).select("node_id").unionByName(tables.patterns(found).filter("evidence_count % 2 = 0").select(_c("pattern_id").alias("node_id")))
    return sinks.valid_edges(tables.edges(found).filter("edge_type = 'reinforces_obs_pat'"), nodes).select("edge_type", "from_id", "to_id")


@query(" SELECT 'analyzed_in' AS edge_type, episode_id AS from_id, 'rep_' || type AS to_id FROM w GROUP BY 2, 3")
def report_coverage(spark, d):
    reports = _week(spark, d).groupBy("type").agg(F.collect_list("episode_id").alias("episode_ids")).select(F.concat(F.lit("rep_"), "type").alias("node_id"), "episode_ids")
    return sinks.coverage(reports)


@query(" SELECT 'vec_' || vec_id AS node_id FROM embeddings WHERE label <> 3")
def vectors_left(spark, d):
    v = tables.vectors(spark, d)
    return sinks.delete(v, v.filter("kind = 3").select("node_id"))[0].select("node_id")


@query(" SELECT node_id FROM w WHERE signal_strength = 'STANDARD'")
def missing_vectors(spark, d):
    week = _week(spark, d)
    log = sinks.write_log("j", week.select("node_id"), spark.createDataFrame([], "edge_type string, from_id string, to_id string"), week.filter("signal_strength <> 'STANDARD'").select("node_id"), F.lit(NOW).cast("timestamp"))
    return sinks.missing_entries(log)


@query(_REC + " SELECT node_id, CASE WHEN status IS NULL THEN '{\"node_id\":\"' || node_id || '\",\"node_type\":\"' || label || '\",\"episode_id\":\"' || episode_id || '\"}' ELSE '{\"node_id\":\"' || node_id || '\",\"node_type\":\"' || label || '\",\"episode_id\":\"' || episode_id || '\",\"status\":\"' || status || '\"}' END AS payload FROM rec")
def index_payloads(spark, d):
    return reads.index_payload(_records(spark, d), ["episode_id", "status"])


@query(" SELECT edge_type, from_id AS from_node_id, to_id AS to_node_id, CASE WHEN invalidated_at IS NULL THEN 0 ELSE 1 END AS properties FROM g")
def tidied_edges(spark, d):
    """Edges with the properties that are there: a withdrawal time for some, a blank note for none."""
    edges = tables.edges(_found(spark, d)).withColumn("note", F.lit(""))
    return reads.tidy_edges(edges, ["invalidated_at", "note"]).withColumn("properties", F.size("properties"))


# Retrieval


_KIND_OF_TRIGGER = "['NAMED_PERSON', 'HISTORICAL_ERA', 'PROGRESS_CLAIM', 'BELIEF_CHALLENGE', 'OPEN_LOOP_MATCH']"
_TRIGGERS = f""", tr AS (SELECT i AS turn_id, {_KIND_OF_TRIGGER}[i % 5 + 1] AS kind, 'person_' || (i % 40) AS person, '2024_01' AS era, CASE WHEN i % 3 = 0 THEN 'CAREER' END AS domain FROM range(0, 60) t(i))"""
_STRUCT = _REC + _TRIGGERS + """, live AS (SELECT * FROM rec WHERE status = 'ACTIVE'),
    a AS (SELECT turn_id, kind, 'PERSON' AS lookup, node_id, occurred_at FROM tr JOIN rec USING (person) WHERE kind = 'NAMED_PERSON'
        UNION ALL SELECT turn_id, kind, 'ERA', node_id, occurred_at FROM tr JOIN rec USING (era) WHERE kind = 'HISTORICAL_ERA' AND label IN ('PatternNode', 'BeliefNode')
        UNION ALL SELECT turn_id, kind, 'STANDING', node_id, occurred_at FROM tr JOIN live ON tr.domain IS NULL OR tr.domain = live.domain WHERE (kind = 'PROGRESS_CLAIM' AND label IN ('PatternNode', 'BeliefNode')) OR (kind = 'BELIEF_CHALLENGE' AND label = 'BeliefNode')
        UNION ALL SELECT turn_id, kind, 'OPEN_QUESTIONS', node_id, occurred_at FROM tr, live WHERE kind IN ('OPEN_LOOP_MATCH', 'PROGRESS_CLAIM') AND label = 'OpenLoopNode'),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id, kind, lookup ORDER BY occurred_at DESC, node_id) AS r FROM a WHERE lookup <> 'PERSON' OR node_id IN (SELECT node_id FROM rec WHERE label <> 'OpenLoopNode')) WHERE r <= 5)"""


def _triggers(spark):
    i = _c("id")
    kinds = F.array(*[F.lit(k) for k in ("NAMED_PERSON", "HISTORICAL_ERA", "PROGRESS_CLAIM", "BELIEF_CHALLENGE", "OPEN_LOOP_MATCH")])
    return spark.range(60).select(i.alias("turn_id"), F.element_at(kinds, (i % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit("person_"), i % 40).alias("person"), F.lit("2024_01").alias("era"), F.when(i % 3 == 0, "CAREER").alias("domain"))


def _structural(spark, d):
    r = _records(spark, d)
    return retrieval.structural(_triggers(spark), r, r.select("node_id", "person"))


@query(_STRUCT + " SELECT turn_id, kind, lookup, node_id, CAST(0.6 AS DOUBLE) AS base_score FROM hits")
def structural_lookups(spark, d):
    return _structural(spark, d).select("turn_id", "kind", "lookup", "node_id", "base_score")


_FLOW = _STRUCT + """, s AS (SELECT turn_id, node_id, 'STRUCTURAL' AS found_by, 0 AS p, 0.6 * CASE signal_strength WHEN 'CRITICAL' THEN 2.0 WHEN 'HIGH' THEN 1.5 ELSE 1.0 END AS sc, false AS boosted, signal_strength, domain FROM hits JOIN rec USING (node_id)
        UNION ALL SELECT turn_id, node_id, 'SEMANTIC', 1, 0.5 + turn_id / 100.0, false, signal_strength, rec.domain FROM tr JOIN rec ON rec.event_id % 60 = tr.turn_id WHERE event_date = DATE '2024-01-10'
        UNION ALL SELECT turn_id, node_id, 'CONTINUITY', 2, 0.45, true, signal_strength, rec.domain FROM tr JOIN rec ON rec.event_id = tr.turn_id),
    gate AS (SELECT *, signal_strength = 'CRITICAL' AND coalesce(domain IN ('HEALTH', 'RELATIONAL') AND domain <> 'HEALTH', false) AS closed FROM s),
    best AS (SELECT *, row_number() OVER (PARTITION BY turn_id, node_id ORDER BY p, sc DESC) AS n FROM gate WHERE NOT closed),
    lifted AS (SELECT * REPLACE (CASE WHEN event_held AND NOT boosted THEN sc * 1.3 ELSE sc END AS sc) FROM (SELECT *, node_id = 'obs_' || turn_id AS event_held FROM best WHERE n = 1)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY floor(sc * 1e6 + 0.5) DESC, p, node_id) AS place FROM lifted)"""


def _flow(spark, d):
    r, t = _records(spark, d), _triggers(spark).select("turn_id")
    rows = lambda df, by, score, boosted: df.select("turn_id", "node_id", F.lit(by).alias("found_by"), score.cast("double").alias("rank_score"), F.lit(boosted).alias("boosted"), "signal_strength", "domain")
    s = rows(_structural(spark, d).select("turn_id", "node_id", "base_score").join(r, "node_id"), "STRUCTURAL", _c("base_score") * scoring.signal_weight(_c("signal_strength")), False)
    m = rows(t.join(r.filter("event_date = '2024-01-10'"), _c("turn_id") == _c("event_id") % 60), "SEMANTIC", 0.5 + _c("turn_id") / 100.0, False)
    held = t.join(r, _c("turn_id") == _c("event_id"))
    found = s.unionByName(m).unionByName(rows(held, "CONTINUITY", F.lit(0.45), True)).withColumn("rank_score", F.floor(_c("rank_score") * 1e6 + 0.5) / 1e6)
    i = _c("id")
    turns = spark.range(66).select(i.alias("turn_id"), F.when(i < 60, 1).otherwise(0).alias("triggers"), (i == 65).alias("crisis"))
    passes = spark.range(64).select(i.alias("turn_id"), F.explode(F.array(F.lit("SEMANTIC"), F.lit("STRUCTURAL"))).alias("pass"), (i < 64).alias("had_work"), F.when(i % 2 == 0, "FAILED").otherwise("OK").alias("status"))
    kept, withheld, outcome = retrieval.conversational(found, held.select("turn_id", "node_id"), turns, passes, ["HEALTH"])
    return kept, withheld, outcome, turns, passes


@query(_FLOW + " SELECT turn_id, node_id, found_by, place FROM kept WHERE place <= 12")
def conversational_retrieval(spark, d):
    """Every turn's passes by meaning, by structure and from what was held: gated, merged, lifted and cut."""
    return _flow(spark, d)[0].select("turn_id", "node_id", "found_by", "place")


@query(_FLOW + " SELECT DISTINCT turn_id, node_id FROM gate WHERE closed")
def withheld_records(spark, d):
    return _flow(spark, d)[1]


@query(_FLOW + """ SELECT i AS turn_id, CASE WHEN i = 65 THEN 'SUPPRESSED' WHEN i >= 60 THEN 'NOT_NEEDED' WHEN i IN (SELECT turn_id FROM kept) THEN 'RETRIEVED' WHEN i % 2 = 0 THEN 'UNAVAILABLE' ELSE 'NOTHING' END AS outcome FROM range(0, 66) t(i)""")
def retrieval_outcomes(spark, d):
    return _flow(spark, d)[2]


@query(_REC + """ SELECT t.kind AS trigger, count(*) AS n FROM (VALUES ('SOMATIC_MARKER'), ('IDENTITY_STATEMENT'), ('NAMED_PERSON')) t(kind), rec
    WHERE t.kind = 'NAMED_PERSON' OR (t.kind = 'SOMATIC_MARKER' AND label = 'ObservationNode' AND signal_strength <> 'HIGH') OR (t.kind = 'IDENTITY_STATEMENT' AND (label = 'BeliefNode' OR (label = 'ObservationNode' AND signal_strength = 'HIGH'))) GROUP BY 1""")
def trigger_filter(spark, d):
    r = _records(spark, d)
    observed = F.when(_c("signal_strength") == "HIGH", "META_BELIEF").otherwise("PHYSIOLOGICAL_CAPACITY_STATE")
    kinds = F.explode(F.array(F.lit("SOMATIC_MARKER"), F.lit("IDENTITY_STATEMENT"), F.lit("NAMED_PERSON")))
    every = r.select("label", observed.alias("kind"), kinds.alias("trigger"))
    return every.filter(retrieval.wanted(_c("trigger"), _c("label"), _c("kind"))).groupBy("trigger").agg(F.count(F.lit(1)).alias("n"))


@query()
def context_assembly(spark, d):
    """The candidates of each turn fitted into the room of its register; a crisis gets nothing."""
    kept = _flow(spark, d)[0].join(_records(spark, d).select("node_id", "occurred_at", "type"), "node_id")
    register = F.when(_c("turn_id") % 10 == 0, "CRISIS").when(_c("turn_id") % 2 == 0, "CALM").otherwise("LOW")
    rows = kept.withColumn("register", register).withColumn("kind", _c("type")).withColumn("preview", F.concat_ws(" ", "node_id", "type", F.date_format("occurred_at", "yyyy MM dd"), "domain"))
    return retrieval.assemble(rows, {"CALM": 40, "LOW": 20}, alert_tokens=5)


@query("SELECT doc_id AS pos, coalesce((SELECT arg_min(event_type, event_id) FROM events WHERE user_id * 7 = doc_id), 'none') AS answer FROM documents", base=False)
def aligned_answers(spark, d):
    """Events as answers to documents by a number: the first for each counts, gaps get the fallback."""
    answers = tables.read(spark, d, "events").select((_c("user_id") * 7).alias("index"), _c("event_type").alias("answer"), _c("event_id").alias("seq"))
    return ranking.align(tables.read(spark, d, "documents").select(_c("doc_id").alias("pos")), answers, F.lit("none"))


@query("WITH b AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id = 7), s AS (SELECT a.vec_id, " + _COS + " AS s FROM embeddings a, b WHERE a.vec_id % 2 = 0) SELECT 'vec_' || vec_id AS node_id, floor(1.3 * s * 1e5 + 0.5) / 1e5 AS rank_score FROM s WHERE s >= 0.1", base=False)
def continuity_revisit(spark, d):
    from palimpsest.operators import vectors

    v = tables.vectors(spark, d)
    q = F.broadcast(_vector(spark, d).select(_c("embedding").alias("q")))  # one row
    held = v.filter("vec_id % 2 = 0").join(q).select("node_id", "embedding", F.lit("").alias("text"), vectors.cosine(_c("embedding"), _c("q")).alias("rank_score"))
    query_row = _vector(spark, d).select("embedding", F.array().cast("array<string>").alias("keywords"))
    return _score(retrieval.revisit(held, query_row, at_least=0.1), "rank_score").select("node_id", "rank_score")


@query(" SELECT node_id, floor((value / 100) * 0.9 * 1e5 + 0.5) / 1e5 AS rank_score FROM w WHERE event_id % 4 IN (1, 2)")
def carried_results(spark, d):
    late = _week(spark, d).select("node_id", (_c("value") / 100).cast("double").alias("rank_score"), (_c("event_id") % 4).alias("fetched_for"))
    return _score(retrieval.carried(late, 2), "rank_score").select("node_id", "rank_score")


@query(" SELECT 'it shifted' AS alert FROM (SELECT max(occurred_at) AS moment FROM f WHERE type = 'purchase') WHERE moment IS NOT NULL")
def shadow_alerts(spark, d):
    reports = _found(spark, d).filter("type = 'purchase'").select("node_id", _c("occurred_at").alias("created_at"), F.lit("SHADOW").alias("report_type"), F.lit(True).alias("detected"), F.lit("it shifted").alias("alert"))
    newest = reports.agg(F.max("created_at")).first()[0]
    return retrieval.shadow_alert(reports, str(newest) if newest else NOW)


# Writing


@query(""", a AS (SELECT event_id AS item_id, CASE WHEN event_id % 13 = 0 THEN 'mrge' ELSE ' merge' END AS action, event_id % 150 / 100.0 AS confidence, pattern_id AS target FROM w),
    v2 AS (SELECT event_id AS item_id, event_id % 2 = 0 AS confirmed, 'EVOLVE' AS action, 0.5 AS confidence, pattern_id AS target FROM w WHERE event_id % 3 = 0),
    b AS (SELECT a.item_id, confirmed IS NOT NULL AS escalated, CASE WHEN NOT confirmed THEN v2.action ELSE a.action END AS action, CASE WHEN NOT confirmed THEN v2.confidence ELSE a.confidence END AS confidence, a.target FROM a LEFT JOIN v2 ON a.item_id = v2.item_id)
    SELECT item_id, escalated, CASE WHEN action = 'mrge' THEN 'BRANCH' ELSE upper(trim(action)) END AS action, CAST(round(least(confidence, 1.0) * 100) AS BIGINT) AS percent,
    CASE WHEN target <> 'pat_3' THEN target END AS target_node_id, CASE WHEN action = 'mrge' THEN 'UNKNOWN_ACTION' END AS refused_by FROM b""")
def interpreted_answers(spark, d):
    w, e = _week(spark, d), _c("event_id")
    target = _c("pattern_id").alias("target")
    answers = w.select(e.alias("item_id"), F.when(e % 13 == 0, "mrge").otherwise(" merge").alias("action"), (e % 150 / 100).alias("confidence"), target)
    verdicts = w.filter("event_id % 3 = 0").select(e.alias("item_id"), (e % 2 == 0).alias("confirmed"), F.lit("EVOLVE").alias("action"), F.lit(0.5).alias("confidence"), target)
    offered = w.filter("pattern_id <> 'pat_3'").select(e.alias("item_id"), _c("pattern_id").alias("node_id"), F.lit("PatternNode").alias("node_type"))
    out = writing.interpret(answers, verdicts, offered)
    return out.select("item_id", "escalated", "action", F.round(_c("confidence") * 100).cast("long").alias("percent"), "target_node_id", "refused_by")


@query(""" SELECT event_id AS item_id, CASE type WHEN 'view' THEN 'BeliefNode' WHEN 'error' THEN 'PatternNode' ELSE 'OpenLoopNode' END AS label, CASE type WHEN 'view' THEN 'bel_' WHEN 'error' THEN 'pat_' ELSE 'loop_' END || pattern_id AS node_id
    FROM w WHERE type IN ('view', 'error') OR (type = 'click' AND signal_strength <> 'STANDARD')""")
def promoted_records(spark, d):
    w = _week(spark, d)
    kind = F.when(_c("type") == "view", "CORE_WOUND").when(_c("type") == "error", "RUMINATION_LOOP").when(_c("type") == "click", "OPEN_LOOP").otherwise("EMOTION")
    items = w.select(_c("event_id").alias("item_id"), kind.alias("kind"), _c("pattern_id").alias("text"), _c("occurred_at").alias("at"))
    return writing.standing_records(items, w.filter("signal_strength <> 'STANDARD'").select(_c("event_id").alias("item_id"))).select("item_id", "label", "node_id")


_PEOPLE = ", m AS (SELECT episode_id AS entry_id, event_id AS pos, node_id, CASE WHEN event_id % 2 = 0 THEN 'Person ' ELSE 'PERSON ' END || (event_id % 9) AS name, occurred_at AS moment FROM w), k AS (SELECT *, 'person_person_' || (pos % 9) AS person_id FROM m)"


def _people(spark, d):
    e = _c("event_id")
    named = _week(spark, d).select(_c("episode_id").alias("entry_id"), e.alias("pos"), "node_id", F.concat(F.when(e % 2 == 0, " Person ").otherwise("PERSON "), e % 9).alias("name"), _c("occurred_at").alias("at"))
    known = spark.range(4).select(F.concat(F.lit("person_person_"), "id").alias("node_id"))
    return writing.people(named, known)


@query(_PEOPLE + " SELECT DISTINCT 'mentions_person' AS edge_type, node_id AS from_id, person_id AS to_id FROM k")
def person_edges(spark, d):
    return _people(spark, d)[2]


@query(_PEOPLE + " SELECT person_id AS node_id, min(moment) AS first_mentioned_at FROM k WHERE pos % 9 >= 4 GROUP BY 1")
def new_people(spark, d):
    return _people(spark, d)[0].select("node_id", "first_mentioned_at")


_HELD = """, held AS (SELECT *, coalesce(CASE WHEN action = 'AMBIGUOUS' THEN a0 END, action) AS tied FROM gated WHERE refused_by IN ('TIE', 'MISSING_WORDING', 'NO_CAUSAL_ANCHOR')),
    can AS (SELECT *, CASE WHEN tied IN ('MERGE','REINFORCE','REGULATE','EVOLVE') THEN tt IS NOT NULL WHEN tied IN ('BRANCH', 'AMBIGUOUS') THEN true WHEN tied = 'CONTRADICT' THEN coalesce(tt = 'BeliefNode', false) AND standing ELSE tt IS NOT NULL AND standing END AS first,
        CASE WHEN runner_up_action IN ('MERGE','REINFORCE','REGULATE','EVOLVE') THEN tt IS NOT NULL WHEN runner_up_action IN ('BRANCH', 'AMBIGUOUS') THEN true WHEN runner_up_action = 'CONTRADICT' THEN coalesce(tt = 'BeliefNode', false) AND standing ELSE runner_up_action IS NOT NULL AND tt IS NOT NULL AND standing END AS second FROM held)"""


def _frozen(spark, d):
    held = cut(_gated(spark, d)).filter("refused_by in ('TIE', 'MISSING_WORDING', 'NO_CAUSAL_ANCHOR')").withColumn("tied_action", F.when(_c("action") == "AMBIGUOUS", F.element_at(F.array(*[F.lit(a) for a in ("MERGE", "REINFORCE", "EVOLVE", "BRANCH", "CONTRADICT", "DIALECTIC", "REGULATE", "AMBIGUOUS")]), (F.regexp_replace("decision_id", "^d_", "").cast("int") % 8 + 1))))
    return cut(writing.frozen(held))


@query(_GATED + _HELD.replace("THEN a0 END", "THEN ['MERGE','REINFORCE','EVOLVE','BRANCH','CONTRADICT','DIALECTIC','REGULATE','AMBIGUOUS'][event_id % 8 + 1] END") + " SELECT decision_id, first OR second AS worth_asking, first AS has_primary, second AS has_runner_up FROM can")
def frozen_variants(spark, d):
    return _frozen(spark, d).select("decision_id", "worth_asking", _c("primary").isNotNull().alias("has_primary"), _c("runner_up").isNotNull().alias("has_runner_up"))


@query(_GATED + _HELD.replace("THEN a0 END", "THEN ['MERGE','REINFORCE','EVOLVE','BRANCH','CONTRADICT','DIALECTIC','REGULATE','AMBIGUOUS'][event_id % 8 + 1] END") + " SELECT decision_id, first AND target_node_id = 'pat_1_v1' AS stale FROM can")
def resolved_decisions(spark, d):
    """Everyone takes the first reading; where its record was superseded meanwhile nothing is written."""
    held = _frozen(spark, d)
    choices = held.select("decision_id", F.lit("PRIMARY").alias("choice"), F.lit(NOW).cast("timestamp").alias("at"))
    records = spark.createDataFrame([("pat_1_v1", "SUPERSEDED"), ("pat_2_v1", "ACTIVE")], "node_id string, status string")
    return writing.resolve(held, choices, records).select("decision_id", "stale")


@query(""", e AS (SELECT user_id, episode_id, event_date, max(event_id) % 5 > 0 AS committed FROM f GROUP BY 1, 2, 3),
    o AS (SELECT episode_id, last_value(CASE WHEN committed THEN episode_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e)
    SELECT CASE type WHEN 'click' THEN 'contains_event' ELSE 'contains_obs' END AS edge_type, episode_id AS from_id, node_id AS to_id FROM f
    UNION SELECT 'chain_contains', 'chain_' || episode_id, 'step_' || event_id FROM f WHERE type = 'error' AND user_id % 2 = 0
    UNION SELECT 'contains_chain', episode_id, 'chain_' || episode_id FROM f WHERE user_id % 2 = 0
    UNION SELECT 'failed_extraction', episode_id, 'failed_' || episode_id FROM f WHERE user_id = 7
    UNION SELECT 'follows_from', episode_id, previous FROM o WHERE previous IS NOT NULL""")
def composed_edges(spark, d):
    found = _found(spark, d)
    episodes = found.groupBy("user_id", "episode_id", _c("event_date").alias("seq")).agg((F.max("event_id") % 5 > 0).alias("committed"))
    chain = F.concat(F.lit("chain_"), "episode_id")
    children = found.select("episode_id", "node_id", F.when(_c("type") == "click", "EventNode").otherwise("ObservationNode").alias("label")).unionByName(found.filter("user_id % 2 = 0").select("episode_id", chain.alias("node_id"), F.lit("CausalChainNode").alias("label")).distinct())
    steps = found.filter("type = 'error'").select("episode_id", chain.alias("chain_id"), F.concat(F.lit("step_"), "event_id").alias("node_id"))
    failed = extraction.failed_rows(episodes.withColumn("read_failed", _c("user_id") == 7))
    return writing.compose(episodes, children, steps, failed)


# Extraction


def _flat(x: str) -> str:
    return f"' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _mentions(x: str) -> str:
    """Whether `text` has x as whole words, in SQL."""
    return f"(trim({_flat(x)}) <> '' AND contains({_flat('text')}, {_flat(x)}))"


_READ = f"""WITH x AS (SELECT doc_id, text, source, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS summary, CASE WHEN n_chars % 5 = 0 THEN 'loud' ELSE ' high' END AS signal, trim(split_part(text, ' ', 1)) AS n1, trim(source) AS n2,
      trim(CASE WHEN doc_id % 3 > 0 THEN substr(text, 11, 30) ELSE substr(text, 11, 30) || 'zq zq' END) AS quote, CASE WHEN doc_id % 4 > 0 THEN lang ELSE ' ' END AS context, CASE WHEN doc_id % 2 = 0 THEN split_part(text, ' ', 2) END AS emotion,
      CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 25) WHEN doc_id % 3 = 1 THEN substr(text, 5, 25) || 'zq' END AS felt FROM documents),
    ev AS (SELECT doc_id, CASE WHEN trim(coalesce(summary, '')) = '' THEN 'EMPTY_CONTENT' WHEN signal = 'loud' THEN 'UNKNOWN_ENUM_VALUE' END AS rule, array_to_string(list_concat(CASE WHEN n1 <> '' AND {_mentions('n1')} THEN [n1] ELSE [] END, CASE WHEN n2 <> '' AND n2 <> n1 AND {_mentions('n2')} THEN [n2] ELSE [] END), ',') AS people,
      {_mentions('quote')} AS grounded FROM x),
    cap AS (SELECT doc_id AS entry_id, 'CONTEXT' AS type, CASE WHEN trim(context) <> '' THEN trim(context) END AS content, CASE WHEN trim(context) = '' THEN 'EMPTY_CONTENT' END AS rule FROM x
      UNION ALL SELECT doc_id, 'EMOTION', CASE WHEN ok THEN trim(emotion) END, CASE WHEN NOT ok THEN 'QUOTE_NOT_FOUND' END FROM (SELECT *, trim(coalesce(felt, '')) <> '' AND coalesce({_mentions('felt')}, false) AS ok FROM x) WHERE trim(coalesce(emotion, '')) <> '')"""


def _read_documents(spark, d):
    """The documents as entries with what a reading of them might say: quotes and names out of their own texts, some of them changed."""
    e, t = _c("doc_id"), _c("text")
    part = F.substring(t, 5, 25)
    return tables.read(spark, d, "documents").select(
        "doc_id", "text", F.when(e % 7 == 0, " ").otherwise(_c("source")).alias("summary"), F.when(_c("n_chars") % 5 == 0, "loud").otherwise(" high").alias("signal_strength"), F.array(F.split_part(t, F.lit(" "), F.lit(1)), "source").alias("people"),
        F.array(F.when(e % 3 > 0, F.substring(t, 11, 30)).otherwise(F.concat(F.substring(t, 11, 30), F.lit("zq zq"))), F.lit(" ")).alias("quotes"), F.when(e % 4 > 0, _c("lang")).otherwise(" ").alias("context"), F.when(e % 2 == 0, F.split_part(t, F.lit(" "), F.lit(2))).alias("emotion"),
        F.when(e % 3 == 0, part).when(e % 3 == 1, F.concat(part, F.lit("zq"))).alias("emotion_quote"),
    )


@query(_READ + " SELECT * FROM ev", base=False)
def validated_events(spark, d):
    return extraction.validate_events(_read_documents(spark, d)).select("doc_id", "rule", F.array_join("people", ",").alias("people"), "grounded")


@query(_READ + f""", o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, CASE doc_id % 6 WHEN 0 THEN 'CONTEXT' WHEN 1 THEN 'EMOTION' WHEN 2 THEN 'BELIEF' WHEN 3 THEN 'CORE_WOUND' WHEN 4 THEN 'PROSODY_SIGNAL' ELSE 'ODD' END AS kind, length(text) % 4 = 0 AS thin FROM x)
    SELECT doc_id AS pos, CASE WHEN n > 150 THEN 'OVER_LIMIT' WHEN trim(coalesce(summary, '')) = '' THEN 'EMPTY_CONTENT' WHEN kind = 'ODD' THEN 'UNKNOWN_TYPE' WHEN kind = 'PROSODY_SIGNAL' THEN 'EXCLUDED_TYPE' WHEN thin AND kind NOT IN ('CONTEXT', 'EMOTION') THEN 'TYPE_NOT_ALLOWED_HERE' WHEN signal = 'loud' THEN 'UNKNOWN_ENUM_VALUE'
      WHEN kind = 'CORE_WOUND' AND length(text) % 3 = 0 THEN 'SIGNAL_FLOOR' END AS rule, kind AS type, CASE WHEN n1 <> '' AND ({_mentions('n1')} OR doc_id % 2 = 0 AND trim({_flat('n1')}) <> '') THEN n1 END AS person, {_mentions('quote')} AS grounded FROM o""", base=False)
def validated_observations(spark, d):
    """Each document as a finding of its source: type and weight by turns, its first word as a person, half of them known beforehand."""
    e, n = _c("doc_id"), F.char_length("text")
    kinds = F.array(*[F.lit(x) for x in ("context", " Emotion ", "BELIEF", "core_wound", "prosody_signal", "odd")])
    first = _c("people")[0]
    rows = _read_documents(spark, d).join(tables.read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    signal = F.when(_c("signal_strength") == "loud", "loud").when(n % 3 == 0, " standard").otherwise("high")
    rows = rows.select(_c("source").alias("entry_id"), e.alias("pos"), F.when(n % 4 == 0, "RAW_CAPTURE").otherwise("REFLECTION").alias("entry_class"), "text", _c("summary").alias("content"), F.element_at(kinds, (e % 6 + 1).cast("int")).alias("type"), F.lit("co_created").alias("provenance"), signal.alias("signal_strength"), F.lit("High").alias("confidence"), first.alias("person"), "quotes", F.when(e % 2 == 0, F.array(F.upper(first), F.lit(""))).alias("resolved"))
    out = extraction.validate_observations(rows, ["CONTEXT", "EMOTION", "BELIEF", "CORE_WOUND", "PROSODY_SIGNAL"], ["PROSODY_SIGNAL"], ["CORE_WOUND"], ["CONTEXT", "EMOTION"], each=150)
    return out.select("pos", "rule", "type", "person", "grounded")


@query(_READ + " SELECT * FROM cap", base=False)
def thin_captures(spark, d):
    return extraction.raw_captures(_read_documents(spark, d).withColumnRenamed("doc_id", "entry_id"))


@query(f"""WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN substr(text, 3, 12) ELSE 'qzqz ' || lang END AS said FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ASSISTANT' WHEN trim(said) <> '' AND {_mentions('said')} THEN 'CO_CREATED' ELSE 'USER_GENERATED' END AS provenance FROM x""", base=False)
def credited_findings(spark, d):
    """Documents credited by wording out of half of them."""
    e = _c("doc_id")
    adopted = F.array(F.when(e % 2 == 0, F.substring("text", 3, 12)).otherwise(F.concat(F.lit("qzqz "), "lang")), F.lit(""))
    return tables.read(spark, d, "documents").select("doc_id", extraction.credited(F.when(e % 5 == 0, "ASSISTANT").otherwise("USER_GENERATED"), _c("text"), adopted).alias("provenance"))


@query(" SELECT episode_id, CASE WHEN user_id % 7 = 0 OR bool_or(type = 'purchase') THEN 'SUSPENDED' ELSE 'COMPLETE' END AS status FROM w GROUP BY episode_id, user_id")
def episode_states(spark, d):
    e = _week(spark, d).groupBy("episode_id", "user_id").agg(F.count_if(_c("type") == "purchase").alias("held"))
    return e.select("episode_id", extraction.episode_status(_c("user_id") % 7 == 0, F.lit(None).cast("boolean"), _c("held")).alias("status"))


@query(_READ + ", r AS (SELECT rule FROM ev UNION ALL SELECT rule FROM cap) SELECT rule, rule IN ('UNKNOWN_TYPE', 'UNKNOWN_ENUM_VALUE', 'SIGNAL_FLOOR', 'UNKNOWN_STEP_TYPE', 'EMPTY_CONTENT') AS again, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY 1, 2", base=False)
def retryable_rules(spark, d):
    """The rules that the documents' readings broke, by whether they are worth asking about again."""
    rows = _read_documents(spark, d)
    rules = extraction.validate_events(rows).select("rule").union(extraction.raw_captures(rows.withColumnRenamed("doc_id", "entry_id")).select("rule"))
    return rules.filter("rule is not null").groupBy("rule", extraction.retryable(_c("rule")).alias("again")).agg(F.count(F.lit(1)).alias("n"))


# Text, time, jobs and erasure


@query(f"""WITH t AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'm' || item_id, 'and then again: ' || text || ' overall' FROM benchmark WHERE length(text) % 3 = 0),
    s AS (SELECT id, list_filter(list_distinct(string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), lambda x: x NOT IN ({_STOP})) AS w FROM t)
    SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) AS overlap FROM s x JOIN s y ON x.id < y.id
    WHERE len(x.w) > 0 AND len(y.w) > 0 AND 100 * len(list_intersect(x.w, y.w)) >= 80 * least(len(x.w), len(y.w))""", base=False)
def overlap_dups(spark, d):
    """Benchmark items and reworded copies of some of them: all pairs that share four fifths of the smaller one's words."""
    b = tables.read(spark, d, "benchmark")
    more = b.filter("length(text) % 3 = 0").select(F.concat(F.lit("m"), "item_id").alias("id"), F.concat(F.lit("and then again: "), "text", F.lit(" overall")).alias("text"))
    return overlap.overlap_dups(b.select(F.concat(F.lit("b"), "item_id").alias("id"), "text").unionByName(more))


@query(""" SELECT node_id, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 14 THEN days || ' days ago' WHEN days < 60 THEN days // 7 || ' weeks ago' ELSE strftime(occurred_at, '%B %Y') END AS said
    FROM (SELECT *, CAST(floor(date_diff('microsecond', occurred_at, TIMESTAMP '2024-01-16') / 86400000000.0) AS BIGINT) AS days FROM f)""")
def humanised_dates(spark, d):
    return _found(spark, d).select("node_id", text.humanise(_c("occurred_at"), F.lit("2024-01-16").cast("timestamp")).alias("said"))


@query(""" SELECT edge_type, CASE WHEN edge_type = 'mentions_obs' THEN 'person' WHEN edge_type LIKE '%_pat' OR edge_type = 'regulates_obs' THEN 'pattern' ELSE 'other' END AS kind, count(*) AS n
    FROM (SELECT CASE edge_type WHEN 'mentions_person' THEN 'mentions_obs' ELSE edge_type END AS edge_type FROM g) GROUP BY 1, 2""")
def edge_kinds(spark, d):
    edges = tables.edges(_found(spark, d)).select(F.when(_c("edge_type") == "mentions_person", "mentions_obs").otherwise(_c("edge_type")).alias("edge_type"))
    return edges.groupBy("edge_type", ids.edge_target_kind(_c("edge_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, CASE WHEN contains(text, '.') THEN regexp_replace(regexp_replace(replace(text, '.', ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') ELSE text END AS body FROM documents", base=False)
def unmarked_texts(spark, d):
    """The documents without full stops, as a marker that goes, and the lines it leaves tidied."""
    return tables.read(spark, d, "documents").select("doc_id", text.without_marker(_c("text"), ".").alias("body"))


@query(" SELECT user_id AS job FROM f GROUP BY 1 HAVING max(occurred_at) + INTERVAL 3 DAY <= TIMESTAMP '2024-02-03'")
def due_jobs(spark, d):
    runs = _found(spark, d).groupBy(_c("user_id").alias("job")).agg(F.max("occurred_at").alias("last_run")).withColumn("every_seconds", F.lit(3 * 86400))
    return sessions.jobs_due(runs, "2024-02-03").select("job")


@query(" SELECT user_id, max(occurred_at) AS last_ts FROM f GROUP BY 1 HAVING max(occurred_at) < TIMESTAMP '2024-02-01' - INTERVAL 120 MINUTE ORDER BY 2, 1 LIMIT 5")
def decayed_sessions(spark, d):
    open_ = _found(spark, d).groupBy("user_id").agg(F.max("occurred_at").alias("last_ts"), F.min("occurred_at").alias("started_at"), F.count(F.lit(1)).alias("events"))
    return sessions.decayed(open_, NOW).select("user_id", "last_ts")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END AS text FROM conversations", base=False)
def purged_messages(spark, d):
    m = tables.read(spark, d, "conversations").withColumn("session_id", _c("conv_id"))
    return erasure.purge(m, m.filter("conv_id % 3 = 0").select("session_id"), ["text"]).select("conv_id", "turn", "text")


@query(" SELECT DISTINCT pattern_id AS node_id FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'IMPORT' WHEN event_id % 4 = 1 THEN 'VOICE' ELSE 'CHAT' END AS source FROM w) WHERE source <> 'IMPORT' AND signal_strength = 'CRITICAL'")
def ours_only(spark, d):
    e = _c("event_id")
    source = F.when(e % 4 == 0, "IMPORT").when(e % 4 == 1, "VOICE").otherwise("CHAT")
    return _week(spark, d).withColumn("source", source).filter(_c("source").isin("CHAT", "VOICE") & (_c("signal_strength") == "CRITICAL")).select(_c("pattern_id").alias("node_id")).distinct()


@query(" SELECT 'person_' || user_id AS person, count(DISTINCT episode_id) AS previous_episodes FROM f WHERE event_date < DATE '2024-01-08' AND event_date >= DATE '2024-01-01' AND user_id NOT IN (SELECT user_id FROM f WHERE event_date >= DATE '2024-01-13' AND event_date < DATE '2024-01-14') GROUP BY 1")
def gone_people(spark, d):
    """People of one week that a single later day doesn't have: as disappearing patterns, with rows to show for it."""
    as_pattern = lambda rows: rows.drop("pattern_id").withColumnRenamed("person", "pattern_id")
    day = report.in_window(_found(spark, d), "2024-01-13", "2024-01-14")
    gone = report.disappearing_patterns(as_pattern(day), as_pattern(_previous(spark, d)).withColumn("_", F.lit(1)), rare=True)
    return gone.select(_c("pattern_id").alias("person"), "previous_episodes")


@query(""", s AS (SELECT pattern_id, count(*) AS n, min(event_date) AS a, max(event_date) AS b FROM f GROUP BY 1) SELECT pattern_id, n || ' instances over ' || CASE WHEN date_diff('day', a, b) >= 365 THEN format('{:.1f} years', date_diff('day', a, b) / 365.25) ELSE date_diff('day', a, b) || ' days' END AS said FROM s""")
def proof_sentences(spark, d):
    sums = _found(spark, d).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("a"), F.max("event_date").alias("b"))
    return sums.select("pattern_id", report.proof_sentence(_c("n"), _c("a"), _c("b")).alias("said"))


@query(_GATED + " SELECT status, count(*) AS n FROM (SELECT CASE WHEN action = 'EVOLVE' AND refused_by IS NULL THEN 'SUPERSEDED' WHEN action = 'REINFORCE' AND refused_by IS NULL THEN 'RESOLVED' WHEN refused_by = 'TIE' THEN 'DISMISSED' ELSE 'ACTIVE' END AS status FROM gated) GROUP BY 1")
def status_changes(spark, d):
    """Status-only updates: superseded by a change, resolved by a confirmation, dismissed where the question was let go."""
    return _gated(spark, d).groupBy(decisions.status_after(_c("action"), _c("refused_by")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
