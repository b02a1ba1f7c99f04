"""More of the catalogue: standing links, people, refusals, proofs of lessons, scripts and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans import extraction, standing
from palimpsest.queries import _found, _week, query
from palimpsest.queries_flow import _READ, _read_documents
from palimpsest.sources import tables

_c = F.col

_LINKS = """, n18 AS (SELECT ['same_as_obs_pat', 'reinforces_obs_pat', 'reinforces_obs_bel', 'reinforces_evt_pat', 'reinforces_evt_bel', 'branches_to_obs_pat', 'branches_to_obs_bel', 'branches_to_evt_pat', 'branches_to_evt_bel', 'branches_to_sess_pat', 'branches_to_sess_bel', 'regulates_obs', 'regulates_sess', 'mentions_obs', 'mentions_evt', 'mentions_sess', 'adopted_as_obs', 'adopted_as_sess', 'contains_obs', 'decided_by'] AS names),
    lk AS (SELECT names[event_id % 20 + 1] AS edge_type, node_id AS from_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE pattern_id END AS to_id, event_id % 10 = 0 AS gone, occurred_at FROM f, n18 UNION ALL SELECT CASE type WHEN 'click' THEN 'mentions_evt' WHEN 'signup' THEN 'mentions_sess' ELSE 'mentions_obs' END, node_id, person, event_id % 10 = 0, occurred_at FROM f),
    kd AS (SELECT *, CASE WHEN edge_type LIKE 'mentions%' THEN 'person' WHEN edge_type LIKE 'adopted_as%' THEN 'principle' WHEN edge_type LIKE '%bel' THEN 'belief' WHEN edge_type LIKE '%pat' OR edge_type LIKE 'regulates%' THEN 'pattern' ELSE 'other' END AS to_kind FROM lk)"""


def _links(spark, d):
    """Two links of each finding: one of the kinds by turns (two of them no standing ones), and one to its person; a tenth were withdrawn."""
    names = F.array(*[F.lit(x) for x in (*standing.STANDING, "contains_obs", "decided_by")])
    found = _found(spark, d)
    gone = F.when(_c("event_id") % 10 == 0, _c("occurred_at")).alias("invalidated_at")
    by_turns = found.select(F.element_at(names, (_c("event_id") % 20 + 1).cast("int")).alias("edge_type"), _c("node_id").alias("from_id"), F.when(_c("event_id") % 9 == 0, " ").otherwise(_c("pattern_id")).alias("to_id"), gone)
    mention = F.when(_c("type") == "click", "mentions_evt").when(_c("type") == "signup", "mentions_sess").otherwise("mentions_obs")
    return by_turns.unionByName(found.select(mention.alias("edge_type"), _c("node_id").alias("from_id"), _c("person").alias("to_id"), gone))


@query(_LINKS + " SELECT DISTINCT from_id, to_id, to_kind, edge_type FROM kd WHERE NOT gone AND edge_type NOT IN ('contains_obs', 'decided_by') AND from_id IN (SELECT node_id FROM w)")
def standing_links(spark, d):
    return standing.standing_links(_links(spark, d), _week(spark, d))


@query(_LINKS + ", k5 AS (SELECT unnest(['pattern', 'belief', 'person', 'principle', 'other']) AS to_kind) SELECT to_kind, (SELECT count(DISTINCT to_id) FROM kd WHERE kd.to_kind = k5.to_kind AND NOT gone AND trim(to_id) <> '' AND edge_type NOT IN ('contains_obs', 'decided_by') AND from_id IN (SELECT node_id FROM w)) AS targets FROM k5")
def window_targets(spark, d):
    return standing.sorted_targets(standing.standing_links(_links(spark, d), _week(spark, d)))


@query(_LINKS + """, mn AS (SELECT DISTINCT from_id, edge_type FROM lk WHERE edge_type LIKE 'mentions%' AND to_id = 'person_7'),
    r1 AS (SELECT node_id, 'EventNode' AS label, 0 AS pl FROM f WHERE type = 'click' AND node_id IN (SELECT from_id FROM mn WHERE edge_type = 'mentions_evt')), r2 AS (SELECT node_id, 'ObservationNode' AS label, 2 AS pl FROM f WHERE type NOT IN ('click', 'signup') AND node_id IN (SELECT from_id FROM mn WHERE edge_type = 'mentions_obs')),
    r3 AS (SELECT DISTINCT pattern_id AS node_id, 'PatternNode' AS label, 1 AS pl FROM f WHERE pattern_id IN (SELECT to_id FROM lk WHERE NOT gone AND edge_type IN ('branches_to_obs_pat', 'reinforces_obs_pat', 'same_as_obs_pat') AND from_id IN (SELECT from_id FROM mn))),
    r4 AS ((SELECT * FROM r1 ORDER BY node_id LIMIT 25) UNION ALL (SELECT * FROM r2 ORDER BY node_id LIMIT 25) UNION ALL (SELECT * FROM r3 ORDER BY node_id LIMIT 25)) SELECT node_id, label FROM r4 ORDER BY pl, node_id LIMIT 25""")
def person_records(spark, d):
    """Events, patterns and observations that are about a person, by the edge of each kind or through a finding."""
    found = _found(spark, d)
    label = F.when(_c("type") == "click", "EventNode").when(_c("type") == "signup", "SessionNode").otherwise("ObservationNode")
    records = found.select("node_id", label.alias("label")).union(found.select("pattern_id", F.lit("PatternNode")).distinct())
    return standing.about_person(records, _links(spark, d), "person_7", ["EventNode", "PatternNode", "ObservationNode"], 25)


@query(_READ + """, k AS (SELECT unnest(['EVENT', 'EVENT', 'CAPTURE', 'CAPTURE', 'CAPTURE']) AS stage, unnest(['EMPTY_CONTENT', 'UNKNOWN_ENUM_VALUE', 'EMPTY_CONTENT', 'QUOTE_NOT_FOUND', 'OVER_LIMIT']) AS rule),
    r AS (SELECT 'EVENT' AS stage, rule FROM ev UNION ALL SELECT 'CAPTURE', rule FROM cap) SELECT stage, rule, (SELECT count(*) FROM r WHERE r.stage = k.stage AND r.rule = k.rule) AS n FROM k""", base=False)
def refusal_tallies(spark, d):
    """How often each rule refused part of a reading of the documents, those included that never did."""
    rows = _read_documents(spark, d)
    drops = extraction.validate_events(rows).select(F.lit("EVENT").alias("stage"), "rule").union(extraction.raw_captures(rows.withColumnRenamed("doc_id", "entry_id")).select(F.lit("CAPTURE"), "rule"))
    return standing.tallies(drops, {"EVENT": ("EMPTY_CONTENT", "UNKNOWN_ENUM_VALUE"), "CAPTURE": ("EMPTY_CONTENT", "QUOTE_NOT_FOUND", "OVER_LIMIT")})


@query(""", l AS (SELECT 'les_' || user_id % 30 AS record_id, episode_id, min(event_date) AS event_date FROM f WHERE type IN ('signup', 'view') AND value < 150 GROUP BY 1, 2),
    s AS (SELECT record_id, count(*) AS instances, min(event_date) AS first_day, max(event_date) AS last_day FROM l GROUP BY 1 HAVING count(*) >= 10), k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY event_date, episode_id) AS place FROM l)
    SELECT record_id, instances, first_day, last_day, string_agg(episode_id, ',' ORDER BY place) AS samples FROM s JOIN k USING (record_id)
    WHERE place IN (1, 1 + round_even((instances - 1) * 1 / 4.0, 0), 1 + round_even((instances - 1) * 2 / 4.0, 0), 1 + round_even((instances - 1) * 3 / 4.0, 0), instances) GROUP BY 1, 2, 3, 4""")
def lesson_proofs(spark, d):
    """What proves each lesson: signups and views that were not superseded."""
    found = _found(spark, d)
    evidence = found.filter("type in ('signup', 'view')").select(F.concat(F.lit("les_"), _c("user_id") % 30).alias("record_id"), "node_id", "episode_id", "event_date")
    return standing.proofs(evidence, found.select("node_id", F.when(_c("value") >= 150, "SUPERSEDED").alias("status")))


@query("""WITH s AS (SELECT conv_id, turn, role, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system')
    SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY n) FILTER (role = 'user') AS monologue, string_agg('[' || turn || '] ' || role || ': ' || t, chr(10) ORDER BY n) AS labelled,
    string_agg('[' || n || '] ' || CASE role WHEN 'user' THEN 'ME' ELSE 'ASSISTANT' END || ': ' || t, chr(10) || chr(10) ORDER BY n) AS numbered FROM s GROUP BY 1""", base=False)
def scripts(spark, d):
    return standing.scripts(tables.read(spark, d, "conversations"))


@query(""", j AS (SELECT user_id AS job_id, event_id AS seq, ['PENDING', 'RUNNING', 'FAILED', 'RUNNING', 'COMPLETE'][event_id % 5 + 1] AS status FROM f), b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS was FROM j)
    SELECT job_id, arg_max(status, seq) AS status, count(*) FILTER (was = 'FAILED' AND status = 'RUNNING') AS retries, count(*) AS entries FROM b GROUP BY 1""")
def job_states(spark, d):
    states = F.array(*[F.lit(s) for s in ("PENDING", "RUNNING", "FAILED", "RUNNING", "COMPLETE")])
    return standing.job_states(_found(spark, d).select(_c("user_id").alias("job_id"), _c("event_id").alias("seq"), F.element_at(states, (_c("event_id") % 5 + 1).cast("int")).alias("status")))
