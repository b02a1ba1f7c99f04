"""The catalogue of questions over a data directory, and equivalent SQL for each.

Queries read the driver tables through palimpsest.sources.tables; the SQL states
the same projection as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids, scoring, temporal, text
from palimpsest.operators import graph, ranking, scans, shaping, vectors
from palimpsest.plans import decisions, erasure, report, retrieval
from palimpsest.sources import sinks, tables
from palimpsest.streaming import buffer, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WEEK, NEXT_WEEK, WEEK_BEFORE, NOW = "2024-01-08", "2024-01-15", "2024-01-01", "2024-02-01"
NEGATIVE = ["error"]
_KINDS = ["view", "signup", "error", "click", "purchase", "refund"]

_BASE = """
f AS (SELECT 'obs_' || event_id AS node_id, event_id, user_id, event_type AS type, ts AS occurred_at, CAST(ts AS DATE) AS event_date, value,
             CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 75 THEN 'HIGH' ELSE 'STANDARD' END AS signal_strength,
             'person_' || user_id AS person, 'ep_' || user_id || '_' || strftime(ts, '%Y_%m_%d') AS episode_id,
             'pat_' || (CAST(json_extract(props, '$.k') AS INT) % 20) AS pattern_id FROM events),
w AS (SELECT * FROM f WHERE event_date >= DATE '2024-01-08' AND event_date < DATE '2024-01-15'),
q AS (SELECT * FROM f WHERE event_date >= DATE '2024-01-01' AND event_date < DATE '2024-01-08'),
p AS (SELECT pattern_id, min(occurred_at) AS valid_from, max(occurred_at) AS last_reinforced_at, count(*) AS evidence_count FROM f GROUP BY 1),
g AS (SELECT e.*, occurred_at AS valid_from, CASE WHEN event_id % 10 = 0 THEN occurred_at + INTERVAL 7 DAY END AS invalidated_at FROM f, LATERAL (
        SELECT 'contains_obs' AS edge_type, episode_id AS from_id, node_id AS to_id
        UNION ALL SELECT 'reinforces_obs_pat', node_id, pattern_id UNION ALL SELECT 'mentions_person', node_id, person
        UNION ALL SELECT 'regulates_obs', node_id, pattern_id WHERE type = 'signup') e),
dec AS (SELECT 'd_' || event_id AS node_id, occurred_at AS created_at, CASE WHEN type = 'error' THEN 'CONTRADICT' ELSE 'BRANCH' END AS action,
               pattern_id AS target_node_id, node_id AS source_node_id, CASE WHEN event_id % 17 = 0 THEN 'ROLLED_BACK' ELSE 'ACTIVE' END AS status
        FROM f WHERE type IN ('error', 'purchase')),
v AS (SELECT o_custkey AS chain, 'bel_' || o_orderkey AS node_id, 'bel_' || lag(o_orderkey) OVER x AS previous_version_id,
             row_number() OVER x AS version, o_orderdate AS valid_from FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def query(sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql follows the common expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {_BASE}{sql}" if base else sql
        return f

    return add


def _found(spark: SparkSession, d: str) -> DataFrame:
    return tables.findings(spark, d)


def _week(spark: SparkSession, d: str) -> DataFrame:
    return report.in_window(_found(spark, d), WEEK, NEXT_WEEK)


def _previous(spark: SparkSession, d: str) -> DataFrame:
    return report.in_window(_found(spark, d), WEEK_BEFORE, WEEK)


_FREQ = """, freq AS (SELECT pattern_id, count(DISTINCT episode_id) AS episodes, floor(count(DISTINCT episode_id) * 1000.0 / (SELECT count(DISTINCT episode_id) FROM w) + 0.5) / 10.0 AS share,
    min(event_date) AS first_day, max(event_date) AS last_day FROM w GROUP BY 1)"""


# Reports


@query(_FREQ + " SELECT * FROM freq")
def pattern_frequency_week(spark, d):
    return report.pattern_frequency(_week(spark, d))


@query(_FREQ + " SELECT pattern_id, episodes, share FROM freq ORDER BY episodes DESC, pattern_id LIMIT 10")
def top_patterns(spark, d):
    return report.top_patterns(report.pattern_frequency(_week(spark, d))).select("pattern_id", "episodes", "share")


@query(""" SELECT p.pattern_id, valid_from, first_episode FROM p LEFT JOIN
    (SELECT pattern_id, arg_min(episode_id, (event_date, episode_id)) AS first_episode FROM f GROUP BY 1) USING (pattern_id)
    WHERE valid_from >= TIMESTAMP '2024-01-01' AND valid_from < TIMESTAMP '2024-01-08'""")
def emerging_patterns(spark, d):
    found = _found(spark, d)
    return report.emerging_patterns(found, tables.patterns(found), WEEK_BEFORE, WEEK)


@query(""", a AS (SELECT 'person_' || user_id || '_' || type AS person, count(DISTINCT episode_id) AS n FROM q GROUP BY 1), t AS (SELECT count(DISTINCT episode_id) AS n FROM q)
    SELECT person, a.n AS previous_episodes, floor(a.n * 1000.0 / t.n + 0.5) / 10.0 AS previous_share
    FROM a, t WHERE person NOT IN (SELECT 'person_' || user_id || '_' || type FROM w) AND floor(a.n * 1000.0 / t.n + 0.5) / 10.0 > 0""")
def disappearing_people(spark, d):
    """People by the kind of what they did, of one week, whom the next one doesn't have."""
    as_pattern = lambda rows: rows.withColumn("pattern_id", F.concat("person", F.lit("_"), "type"))
    return report.disappearing_patterns(as_pattern(_week(spark, d)), as_pattern(_previous(spark, d))).withColumnRenamed("pattern_id", "person")


_DELTA = """, c AS (SELECT pattern_id, count(DISTINCT episode_id) AS now FROM w GROUP BY 1), b AS (SELECT pattern_id, count(DISTINCT episode_id) AS was FROM q GROUP BY 1),
    delta AS (SELECT coalesce(c.pattern_id, b.pattern_id) AS pattern_id, coalesce(now, 0) AS now, coalesce(was, 0) AS was FROM c FULL JOIN b ON c.pattern_id = b.pattern_id)"""


@query(_DELTA + " SELECT *, now - was AS delta FROM delta")
def period_delta(spark, d):
    return report.period_delta(_week(spark, d), _previous(spark, d))


@query(_DELTA + " SELECT *, was - now AS drop FROM delta WHERE was > now AND pattern_id IN (SELECT pattern_id FROM w WHERE type = 'signup') ORDER BY 4 DESC, 1 LIMIT 1")
def growth_candidate(spark, d):
    week = _week(spark, d)
    return report.growth_candidate(week, _previous(spark, d), week.filter("type = 'signup'").select("pattern_id"))


@query(_FREQ + """, t AS (SELECT pattern_id, episodes FROM freq ORDER BY episodes DESC, pattern_id LIMIT 1)
    SELECT pattern_id, episodes, (SELECT count(*) FROM w WHERE type = 'error' AND episode_id IN (SELECT episode_id FROM w JOIN t USING (pattern_id))) AS negative_findings FROM t""")
def struggle_candidate(spark, d):
    return report.struggle_candidate(_week(spark, d), NEGATIVE)


@query(""" SELECT person, count(*) AS findings, array_to_string((list(node_id ORDER BY occurred_at, node_id))[1:3], ',') AS excerpts FROM w WHERE type = 'click' GROUP BY 1 HAVING count(*) >= 2""")
def relational_dynamics(spark, d):
    return report.relational_dynamics(_week(spark, d), "click").withColumn("excerpts", F.array_join("excerpts", ","))


@query(""", k AS (SELECT person, type, row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, type) AS r FROM w GROUP BY 1, 2)
    SELECT person, episodes, (SELECT string_agg(type, ',' ORDER BY r) FROM k WHERE k.person = a.person AND r <= 3) AS top_kinds
    FROM (SELECT person, count(DISTINCT episode_id) AS episodes FROM w GROUP BY 1 HAVING count(DISTINCT episode_id) >= 3) a""")
def relationship_arcs(spark, d):
    return report.relationship_arcs(_week(spark, d))


@query(" SELECT node_id, episode_id, signal_strength FROM w WHERE signal_strength <> 'STANDARD' ORDER BY event_date, episode_id, occurred_at, node_id LIMIT 25")
def high_signal(spark, d):
    return report.high_signal(_week(spark, d)).select("node_id", "episode_id", "signal_strength")


@query(" SELECT node_id, person, episode_id FROM w WHERE type IN ('view', 'signup')")
def environment_observations(spark, d):
    return report.of_kind(_week(spark, d), ["view", "signup"]).select("node_id", "person", "episode_id")


@query(" SELECT pattern_id, count(*) AS links FROM w WHERE type = 'error' GROUP BY 1")
def unprocessed_motifs(spark, d):
    return report.links_from_kind(_week(spark, d), "error")


_LESSONS = ", l AS (SELECT DISTINCT 'les_' || user_id % 30 AS lesson_id, episode_id, event_date FROM f WHERE type = 'signup')"


def _lessons(spark, d):
    return _found(spark, d).filter("type = 'signup'").select(F.concat(F.lit("les_"), F.col("user_id") % 30).alias("lesson_id"), "episode_id", "event_date").distinct()


@query(_LESSONS + " SELECT lesson_id, count(DISTINCT episode_id) AS episodes FROM l WHERE episode_id IN (SELECT episode_id FROM w) GROUP BY 1 HAVING count(DISTINCT episode_id) >= 3")
def repeated_lessons(spark, d):
    return report.repeated_lessons(_lessons(spark, d), _week(spark, d))


@query(_LESSONS + """ SELECT lesson_id, date_diff('day', max(event_date), DATE '2024-02-01') AS days FROM l GROUP BY 1
    HAVING NOT bool_or(episode_id IN (SELECT episode_id FROM w WHERE event_date = DATE '2024-01-13')) AND date_diff('day', max(event_date), DATE '2024-02-01') >= 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def ignored_lessons(spark, d):
    evidence = _lessons(spark, d)
    lessons = evidence.groupBy("lesson_id").agg(F.max("event_date").cast("timestamp").alias("last_seen"))
    return report.ignored_lessons(lessons, evidence, _week(spark, d).filter("event_date = '2024-01-13'"), NOW, 1)


@query(""" SELECT o.node_id AS target_node_id, n.node_id AS new_node_id, o.node_id || ' said' AS old_statement, n.node_id || ' said' AS new_statement
    FROM v n JOIN v o ON n.previous_version_id = o.node_id WHERE n.version % 5 = 0""")
def belief_changes(spark, d):
    said = tables.versions(spark, d).withColumn("statement", F.concat("node_id", F.lit(" said")))
    made = said.filter("version % 5 = 0").select(F.lit("EVOLVE").alias("action"), F.col("previous_version_id").alias("target_node_id"), F.col("node_id").alias("new_node_id"))
    return report.belief_changes(made, said).select("target_node_id", "new_node_id", "old_statement", "new_statement")


@query(""" SELECT 'loop_' || event_id AS loop_id, occurred_at AS opened_at, CAST(floor(date_diff('microsecond', occurred_at, TIMESTAMP '2024-02-01') / 86400000000.0) AS BIGINT) AS days_open
    FROM f WHERE type = 'error' AND event_id % 3 > 0 AND pattern_id NOT IN (SELECT pattern_id FROM w WHERE type = 'purchase' AND signal_strength = 'CRITICAL') ORDER BY 3 DESC, 1 LIMIT 25""")
def unresolved_open_loops(spark, d):
    loop = F.concat(F.lit("loop_"), "event_id").alias("loop_id")
    errors = _found(spark, d).filter("type = 'error'").select(loop, F.col("occurred_at").alias("opened_at"), F.when(F.col("event_id") % 3 > 0, "OPEN").otherwise("RESOLVED").alias("status"), "pattern_id")
    closing = _week(spark, d).filter("type = 'purchase' and signal_strength = 'CRITICAL'").select("pattern_id").distinct()
    return report.open_loops(errors, errors.join(closing, "pattern_id", "left_semi"), NOW).select("loop_id", "opened_at", "days_open")


@query(""" SELECT 'con_' || event_id AS node_id, 'bel_' || event_id || ' said' AS statement_a, CASE WHEN event_id % 2 = 0 THEN 'bel_' || (event_id + 1) || ' said' ELSE 'none_' || event_id END AS statement_b,
    CAST(floor(date_diff('microsecond', occurred_at, TIMESTAMP '2024-02-01') / 86400000000.0) AS BIGINT) AS days_open
    FROM f WHERE type = 'error' AND event_id % 5 > 0 AND 'bel_' || event_id IN (SELECT node_id FROM v) AND 'bel_' || (event_id + 1) IN (SELECT node_id FROM v)""")
def active_contradictions(spark, d):
    said = tables.versions(spark, d).select("node_id", F.concat("node_id", F.lit(" said")).alias("statement"))
    b = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("bel_"), F.col("event_id") + 1)).otherwise(F.concat(F.lit("none_"), "event_id"))
    rows = _found(spark, d).filter("type = 'error'").select(F.concat(F.lit("con_"), "event_id").alias("node_id"), F.concat(F.lit("bel_"), "event_id").alias("belief_a_id"), b.alias("belief_b_id"), F.when(F.col("event_id") % 5 > 0, "UNRESOLVED").otherwise("RESOLVED_USER").alias("resolution_status"), F.col("occurred_at").alias("created_at"), F.concat(F.lit("bel_"), F.col("event_id") + 1).alias("_b"))
    known = said.select("node_id")
    rows = rows.join(known.withColumnRenamed("node_id", "belief_a_id"), "belief_a_id", "left_semi").join(known.withColumnRenamed("node_id", "_b"), "_b", "left_semi")
    return report.contradictions(rows, said, NOW)


@query(""", x AS (SELECT o_custkey AS customer, max(o_orderdate) AS last_seen FROM orders GROUP BY 1),
    y AS (SELECT *, CAST(greatest(floor(date_diff('microsecond', last_seen, TIMESTAMP '2001-08-01') / 86400000000.0), 0) AS BIGINT) AS quiet_days FROM x)
    SELECT customer, quiet_days, CASE WHEN quiet_days < 30 THEN 'FRESH' WHEN quiet_days < 180 THEN 'COOLING' WHEN quiet_days < 365 THEN 'STALE' ELSE 'DORMANT' END AS band,
    CASE WHEN quiet_days < 30 THEN 1.0 WHEN quiet_days < 180 THEN 0.85 WHEN quiet_days < 365 THEN 0.7 ELSE 0.5 END::DOUBLE AS weight, quiet_days >= 365 AS ask FROM y WHERE quiet_days > 180""")
def pattern_aging(spark, d):
    seen = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max("o_orderdate").alias("last_reinforced_at"))
    return report.pattern_aging(seen, "2001-08-01").select("customer", "quiet_days", "band", "weight", "ask")


@query(_DELTA + """, t AS (SELECT *, (SELECT count(*) FROM w WHERE w.pattern_id = delta.pattern_id AND type = 'click') AS a_now, (SELECT count(*) FROM q WHERE q.pattern_id = delta.pattern_id AND type = 'click') AS a_was FROM delta),
    m AS (SELECT *, CASE WHEN now = was AND a_now > a_was THEN 'AWARENESS_INCREASING' WHEN now > was THEN 'FREQUENCY_INCREASING' WHEN now < was THEN 'FREQUENCY_DECREASING' END AS trend FROM t),
    s AS (SELECT count(*) FILTER (trend <> 'FREQUENCY_INCREASING') AS loose, count(*) FILTER (trend = 'FREQUENCY_INCREASING') AS tight FROM m)
    SELECT pattern_id, trend, now, was, greatest(loose, tight) >= 5 AS detected FROM m, s
    WHERE trend IS NOT NULL AND (greatest(loose, tight) < 5 OR (trend <> 'FREQUENCY_INCREASING') = (loose >= tight))""")
def archetype_shift(spark, d):
    return report.archetype_shift(_week(spark, d), _previous(spark, d), "click")


@query(""", r AS (SELECT * FROM dec WHERE created_at >= TIMESTAMP '2024-01-28' AND created_at < TIMESTAMP '2024-01-30' AND status <> 'ROLLED_BACK')
    SELECT count(*) >= 3 AND count(DISTINCT target_node_id) >= 2 AS detected, count(*) AS decisions, count(DISTINCT target_node_id) AS targets,
    count(*) FILTER (action = 'BRANCH') AS branches, count(*) FILTER (action = 'CONTRADICT') AS contradictions FROM r""")
def shadow_scan(spark, d):
    return report.shadow_scan(tables.decisions(_found(spark, d)), "2024-01-30")


@query(""", o AS (SELECT pattern_id, episode_id, min(event_date) AS event_date FROM f GROUP BY 1, 2),
    s AS (SELECT pattern_id, count(*) AS instances, min(event_date) AS first_day, max(event_date) AS last_day FROM o GROUP BY 1 HAVING count(*) >= 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY event_date, episode_id) AS place FROM o)
    SELECT pattern_id, instances, first_day, last_day, string_agg(episode_id, ',' ORDER BY place) AS samples FROM s JOIN k USING (pattern_id)
    WHERE place IN (1 + round_even((instances - 1) * 0 / 4.0, 0), 1 + round_even((instances - 1) * 1 / 4.0, 0), 1 + round_even((instances - 1) * 2 / 4.0, 0), 1 + round_even((instances - 1) * 3 / 4.0, 0), instances) GROUP BY 1, 2, 3, 4""")
def proof_chains(spark, d):
    return report.proof_chains(_found(spark, d))


@query(""" SELECT key, arg_max(spelling, (n, spelling)) AS spelling, CAST(sum(n) AS BIGINT) AS total FROM
    (SELECT source AS spelling, lower(source) AS key, count(*) AS n FROM documents GROUP BY 1) GROUP BY 1 ORDER BY total DESC, key LIMIT 50""")
def era_vocabulary(spark, d):
    return report.era_vocabulary(tables.read(spark, d, "documents"), "source")


@query(" SELECT person, count(*) AS findings, count(*) FILTER (signal_strength <> 'STANDARD') AS weighty, count(*) FILTER (signal_strength <> 'STANDARD') * 2 >= count(*) AS confident FROM w WHERE type = 'view' GROUP BY 1")
def environments(spark, d):
    return report.environments(_week(spark, d), "view", "person")


_DUE = """, c AS (SELECT 'WEEKLY' AS t, date_trunc('week', TIMESTAMP '2024-02-01') - to_days(CAST(7 * i AS INT)) AS s, date_trunc('week', TIMESTAMP '2024-02-01') - to_days(CAST(7 * (i - 1) AS INT)) AS e, 1 AS grace FROM range(1, 7) r(i)
    UNION ALL SELECT 'MONTHLY', TIMESTAMP '2024-02-01' - to_months(CAST(i AS INT)), TIMESTAMP '2024-02-01' - to_months(CAST(i - 1 AS INT)), 3 FROM range(1, 7) r(i)
    UNION ALL SELECT 'QUARTERLY', TIMESTAMP '2024-01-01' - to_months(CAST(3 * i AS INT)), TIMESTAMP '2024-01-01' - to_months(CAST(3 * (i - 1) AS INT)), 3 FROM range(1, 7) r(i)),
    x AS (SELECT * FROM c WHERE e + to_days(grace) <= TIMESTAMP '2024-02-01' AND NOT (t = 'WEEKLY' AND s IN (SELECT date_trunc('week', occurred_at) FROM f WHERE user_id = 5 AND type = 'purchase')))"""


@query(_DUE + " SELECT t AS report_type, s AS period_start, e AS period_end FROM x ORDER BY e DESC, e - s DESC, s DESC LIMIT 4")
def catchup_windows(spark, d):
    """Windows still to be reported on; the weeks in which a user bought something have their reports."""
    weeks = _found(spark, d).filter("user_id = 5 and type = 'purchase'").select(F.date_trunc("week", "occurred_at").cast("timestamp").alias("period_start")).distinct()
    return report.reports_due(spark, NOW, weeks.select(F.lit("WEEKLY").alias("report_type"), "period_start"))


@query(" SELECT episode_id, event_date, count(*) AS findings, arg_min(node_id, (occurred_at, node_id)) AS first_finding FROM w GROUP BY 1, 2")
def episode_facts(spark, d):
    return report.episode_facts(_week(spark, d)).select("episode_id", "event_date", F.size("findings").cast("long").alias("findings"), F.col("findings")[0]["node_id"].alias("first_finding"))


@query()
def report_bundle(spark, d):
    found = _found(spark, d)
    return report.bundle(found, tables.patterns(found), tables.decisions(found), WEEK, NEXT_WEEK, WEEK_BEFORE, NEGATIVE)


# Scans and lookups


@query(" SELECT * FROM f WHERE node_id = 'obs_17'")
def node_by_id(spark, d):
    return scans.by_id(_found(spark, d), "obs_17")


@query(" SELECT pos, f.node_id, type FROM f JOIN (SELECT min(i) AS pos, 'obs_' || (i * 7 % 50) AS node_id FROM range(0, 80) r(i) GROUP BY 2) USING (node_id)")
def nodes_in_order(spark, d):
    wanted = spark.range(80).select(F.col("id").alias("pos"), F.concat(F.lit("obs_"), F.col("id") * 7 % 50).alias("node_id"))
    return scans.by_ids(_found(spark, d), wanted).select("pos", "node_id", "type")


@query(" SELECT node_id, occurred_at, signal_strength FROM f WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at <= TIMESTAMP '2024-01-15' AND signal_strength = 'HIGH' ORDER BY occurred_at DESC, node_id LIMIT 50 OFFSET 10")
def find_nodes_page(spark, d):
    found = _found(spark, d)
    keep = scans.listing_filter(at=F.col("occurred_at"), since=WEEK, until=NEXT_WEEK, equal={"signal": (F.col("signal_strength"), "HIGH")})
    return scans.page(found.filter(keep), "occurred_at", 50, 10).select("node_id", "occurred_at", "signal_strength")


@query(" SELECT node_id FROM f WHERE node_id > 'obs_5' ORDER BY node_id LIMIT 200")
def keyset_page(spark, d):
    return scans.after(_found(spark, d).select("node_id"), "obs_5", 200)


@query(" SELECT episode_id, min(event_date) AS event_date, min(occurred_at) AS occurred_at, count(*) AS findings FROM w GROUP BY 1")
def episode_range(spark, d):
    return scans.date_range(tables.episodes(_found(spark, d)), WEEK, NEXT_WEEK).select("episode_id", "event_date", "occurred_at", "findings")


@query(" SELECT k AS type, count(event_id) AS n FROM (VALUES ('view'), ('signup'), ('error'), ('click'), ('purchase'), ('refund')) t(k) LEFT JOIN f ON type = k GROUP BY 1")
def count_by_type(spark, d):
    return scans.count_by_kind(_found(spark, d), spark.createDataFrame([(k,) for k in _KINDS], "type string"))


@query(" SELECT user_id, arg_max(signal_strength, CASE signal_strength WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END) AS strongest FROM f GROUP BY 1")
def strongest_signal(spark, d):
    return _found(spark, d).groupBy("user_id").agg(scoring.strongest(F.col("signal_strength")).alias("strongest"))


@query(" SELECT target_node_id, count(*) AS n FROM dec WHERE action = 'CONTRADICT' AND status <> 'ROLLED_BACK' GROUP BY 1")
def prior_decisions(spark, d):
    return tables.decisions(_found(spark, d)).filter("action = 'CONTRADICT' and status <> 'ROLLED_BACK'").groupBy("target_node_id").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT user_id, event_id % 7 AS stage, max(event_id % 100) + 1 AS next_attempt FROM f GROUP BY 1, 2")
def next_attempt(spark, d):
    runs = _found(spark, d).select("user_id", (F.col("event_id") % 7).alias("stage"), (F.col("event_id") % 100).alias("attempt"))
    return scans.next_attempt(runs, ["user_id", "stage"])


# Graph


@query(", ids AS (SELECT 'obs_' || (i * 11) AS id FROM range(0, 40) r(i)) SELECT DISTINCT edge_type, from_id, to_id FROM g WHERE (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '2024-01-20') AND (from_id IN (SELECT id FROM ids) OR to_id IN (SELECT id FROM ids))")
def neighbors_asof(spark, d):
    live = graph.live_edges(tables.edges(_found(spark, d)), as_of="2024-01-20")
    ids = spark.range(40).select(F.concat(F.lit("obs_"), F.col("id") * 11).alias("node_id"))
    return graph.expand(live, ids).select("edge_type", "from_id", "to_id").distinct()


@query(""", live AS (SELECT from_id AS a, to_id AS b FROM g WHERE invalidated_at IS NULL UNION SELECT to_id, from_id FROM g WHERE invalidated_at IS NULL),
    h1 AS (SELECT b FROM live WHERE a = 'obs_11'), h2 AS (SELECT b FROM live WHERE a IN (SELECT b FROM h1)),
    every AS (SELECT 'obs_11' AS node_id, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) SELECT node_id, min(hop) AS hop FROM every GROUP BY 1""")
def khop2(spark, d):
    live = graph.live_edges(tables.edges(_found(spark, d)))
    return graph.neighbourhood(live, spark.createDataFrame([("obs_11",)], "node_id string"), 2)[0]


@query(""", start AS (SELECT chain FROM v WHERE node_id = 'bel_100') SELECT node_id, previous_version_id, version FROM v JOIN start USING (chain)""")
def version_chain(spark, d):
    return graph.version_chain(spark, tables.versions(spark, d), "bel_100").select("node_id", "previous_version_id", "version")


@query(" SELECT node_id, first_value(node_id) OVER (PARTITION BY chain ORDER BY version) AS root, version - 1 AS steps FROM v")
def all_version_chains(spark, d):
    return graph.all_chains(tables.versions(spark, d))


@query(""", m AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent FROM conversations),
    walk(conv_id, turn, parent) AS (SELECT conv_id, turn, parent FROM m WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM m GROUP BY 1)
        UNION ALL SELECT m.conv_id, m.turn, m.parent FROM walk JOIN m ON m.conv_id = walk.conv_id AND m.turn = walk.parent) SELECT conv_id, turn FROM walk""")
def thread_walk(spark, d):
    t = F.col("turn")
    m = tables.read(spark, d, "conversations").select("conv_id", "turn", F.when(t == 0, None).when(t % 3 == 2, t - 2).otherwise(t - 1).alias("parent"))
    return graph.thread(m, m.groupBy("conv_id").agg(F.max("turn").alias("turn"))).select("conv_id", "turn")


@query(" SELECT pattern_id, valid_from FROM p WHERE EXISTS (SELECT 1 FROM g a JOIN g b ON a.from_id = b.from_id WHERE a.edge_type = 'mentions_person' AND a.to_id = 'person_7' AND b.edge_type = 'reinforces_obs_pat' AND b.invalidated_at IS NULL AND b.to_id = pattern_id)")
def exists_two_hop(spark, d):
    found = _found(spark, d)
    return graph.through_a_finding(tables.patterns(found), tables.edges(found), "person_7", "reinforces_obs_pat", "pattern_id").select("pattern_id", "valid_from")


@query(" SELECT node_id, type FROM f WHERE person = 'person_7'")
def linked_to_person(spark, d):
    found = _found(spark, d)
    return graph.linked_to_person(found, tables.edges(found), "person_7").select("node_id", "type")


@query(" SELECT node_id, episode_id FROM f WHERE type IN ('error', 'purchase') AND signal_strength = 'CRITICAL' AND episode_id IN (SELECT episode_id FROM f GROUP BY 1 HAVING count(*) >= 2)")
def unresolved_join(spark, d):
    found = _found(spark, d)
    pending = tables.episodes(found).filter("findings >= 2")
    return graph.unresolved(found.filter("signal_strength = 'CRITICAL'"), tables.edges(found), pending, ["error", "purchase"]).select("node_id", "episode_id")


@query(" SELECT DISTINCT edge_type, from_id, to_id FROM g WHERE invalidated_at IS NULL AND edge_type = 'reinforces_obs_pat' AND from_id IN (SELECT node_id FROM w)")
def standing_edges(spark, d):
    found = _found(spark, d)
    return graph.standing_edges(tables.edges(found), _week(spark, d), ["reinforces_obs_pat"]).select("edge_type", "from_id", "to_id")


@query(" SELECT episode_id AS node_id FROM f WHERE user_id = 5 UNION SELECT node_id FROM f WHERE user_id = 5")
def erasure_targets(spark, d):
    found = _found(spark, d)
    return graph.erasure_targets(tables.edges(found), tables.episodes(found).filter("user_id = 5").select(F.col("episode_id").alias("node_id")))


@query(" SELECT d.node_id, action, d.target_node_id, p.evidence_count, f.signal_strength FROM dec d LEFT JOIN p ON pattern_id = target_node_id LEFT JOIN f ON f.node_id = source_node_id")
def decision_outcomes(spark, d):
    found = _found(spark, d)
    made = tables.decisions(found)
    target = tables.patterns(found).select(F.col("pattern_id").alias("target_node_id"), "evidence_count")
    source = found.select(F.col("node_id").alias("source_node_id"), "signal_strength")
    return made.join(target, "target_node_id", "left").join(source, "source_node_id", "left").select("node_id", "action", "target_node_id", "evidence_count", "signal_strength")


@query(", l AS (SELECT episode_id, lag(episode_id) OVER (PARTITION BY user_id ORDER BY event_date) AS previous FROM (SELECT DISTINCT user_id, episode_id, event_date FROM f)) SELECT episode_id AS from_id, previous AS to_id FROM l WHERE previous IS NOT NULL")
def follows_from(spark, d):
    e = tables.episodes(_found(spark, d))
    back = F.lag("episode_id").over(Window.partitionBy("user_id").orderBy("event_date"))
    return e.select(F.col("episode_id").alias("from_id"), back.alias("to_id")).filter("to_id is not null")


# Vectors, ranking, budgets

_COS = "greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


def _score(df: DataFrame, c: str = "score") -> DataFrame:
    return df.withColumn(c, F.floor(F.col(c) * 1e5 + 0.5) / 1e5)


def _vector(spark, d, vec_id: int = 7) -> DataFrame:
    return tables.vectors(spark, d).filter(F.col("vec_id") == vec_id)


_NEAR = f"near AS (SELECT a.vec_id, a.label, {_COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 7)"


@query(f"WITH {_NEAR} SELECT 'vec_' || vec_id AS node_id, label AS kind, floor(s * 1e5 + 0.5) / 1e5 AS score FROM near ORDER BY s DESC, 'vec_' || vec_id LIMIT 20", base=False)
def vector_topk(spark, d):
    return _score(vectors.top_k(tables.vectors(spark, d), _vector(spark, d), 20)).select("node_id", "kind", "score")


_RERANK = f"WITH {_NEAR}, t AS (SELECT *, 'vec_' || vec_id AS node_id FROM near ORDER BY s DESC, 'vec_' || vec_id LIMIT 20), r AS (SELECT *, s * CASE WHEN label % 3 = 0 THEN 2.0 WHEN label % 3 = 1 THEN 1.5 ELSE 1.0 END AS rank FROM t WHERE vec_id <> 7)"


def _reranked(spark, d, k: int) -> DataFrame:
    signal = F.when(F.col("kind") % 3 == 0, "CRITICAL").when(F.col("kind") % 3 == 1, "HIGH").otherwise("STANDARD")
    return vectors.over_fetch(tables.vectors(spark, d), _vector(spark, d), 20, F.col("vec_id") != 7, F.col("score") * scoring.signal_weight(signal), k)


@query(_RERANK + " SELECT node_id, floor(rank * 1e5 + 0.5) / 1e5 AS rank_score FROM r ORDER BY rank DESC, node_id LIMIT 5", base=False)
def overfetch_rerank(spark, d):
    return _score(_reranked(spark, d, 5), "rank_score").select("node_id", "rank_score")


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT b.vec_id AS query_id, 'vec_' || a.vec_id AS node_id, {_COS} AS s FROM embeddings a JOIN q b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM s) SELECT query_id, node_id, rank FROM r WHERE rank <= 5""", base=False)
def vector_topk_by_kind(spark, d):
    v = tables.vectors(spark, d)
    return vectors.by_kind(v, v.filter("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id")), 5).select("query_id", "node_id", "rank")


_PASSES = """WITH s AS (SELECT vec_id % 40 AS k, CASE vec_id % 3 WHEN 0 THEN 'STRUCTURAL' WHEN 1 THEN 'SEMANTIC' ELSE 'CONTINUITY' END AS found_by, (vec_id * 37 % 101) / 100.0 AS sc FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE found_by WHEN 'STRUCTURAL' THEN 0 WHEN 'SEMANTIC' THEN 1 ELSE 2 END, sc DESC) AS n FROM s),
    m AS (SELECT 'vec_' || k AS node_id, found_by, CAST(sc AS DOUBLE) * CASE WHEN k % 4 = 0 THEN 1.3 ELSE 1.0 END AS s, k % 4 = 0 AS boosted FROM r WHERE n = 1)"""


def _passes(spark, d) -> DataFrame:
    v = F.col("vec_id")
    by = F.when(v % 3 == 0, "STRUCTURAL").when(v % 3 == 1, "SEMANTIC").otherwise("CONTINUITY")
    return tables.vectors(spark, d).select(F.concat(F.lit("vec_"), v % 40).alias("node_id"), by.alias("found_by"), ((v * 37 % 101) / 100.0).alias("rank_score"), F.lit(False).alias("boosted"))


@query(_PASSES + " SELECT node_id, found_by, floor(s * 1e5 + 0.5) / 1e5 AS rank_score, boosted FROM m ORDER BY s DESC, CASE found_by WHEN 'STRUCTURAL' THEN 0 WHEN 'SEMANTIC' THEN 1 ELSE 2 END, node_id LIMIT 12", base=False)
def boosted_topk(spark, d):
    boosts = spark.range(10).select(F.concat(F.lit("vec_"), F.col("id") * 4).alias("node_id"))
    return _score(ranking.merge_passes(_passes(spark, d), boosts, 12), "rank_score")


@query(_PASSES + " SELECT node_id, found_by, CAST(sc AS DOUBLE) AS rank_score FROM (SELECT 'vec_' || k AS node_id, * FROM r WHERE n = 1)", base=False)
def pass_merge(spark, d):
    return ranking.merge_passes(_passes(spark, d), None, 1000).select("node_id", "found_by", "rank_score")


@query(""", a AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS pos FROM w WHERE signal_strength = 'CRITICAL'), s AS (SELECT * FROM a WHERE pos <= 3), b AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS pos FROM w WHERE type = 'error')
    SELECT node_id, 'STRUCTURAL' AS source FROM s UNION ALL (SELECT node_id, 'SEMANTIC' FROM b WHERE node_id NOT IN (SELECT node_id FROM s) ORDER BY pos LIMIT 5)""")
def cap_merge(spark, d):
    week = _week(spark, d)
    ranked = lambda rows, n: rows.orderBy("node_id").limit(n).select("node_id", F.row_number().over(Window.orderBy("node_id")).alias("pos"))
    return ranking.cap_merge(ranked(week.filter("type = 'error'"), 20), ranked(week.filter("signal_strength = 'CRITICAL'"), 3), 8).select("node_id", "source")


_GATE = "CASE event_id % 5 WHEN 0 THEN 'HEALTH' WHEN 1 THEN 'CAREER' WHEN 2 THEN 'RELATIONAL' WHEN 3 THEN NULL ELSE 'FINANCIAL' END"


@query(f", x AS (SELECT node_id, signal_strength, {_GATE} AS domain FROM f) SELECT node_id, domain FROM x WHERE signal_strength = 'CRITICAL' AND domain = 'RELATIONAL'")
def gate_withheld(spark, d):
    e = F.col("event_id") % 5
    domain = F.when(e == 0, "HEALTH").when(e == 1, "CAREER").when(e == 2, "RELATIONAL").when(e == 4, "FINANCIAL")
    rows = _found(spark, d).select("node_id", "signal_strength", domain.alias("domain"))
    return rows.filter(ranking.withheld(F.col("signal_strength"), F.col("domain"), ["HEALTH"])).select("node_id", "domain")


_TURNS = "WITH t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations)"


def _turns(spark, d) -> DataFrame:
    return tables.read(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


@query(_TURNS + ", s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM t) SELECT conv_id, turn, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 700", base=False)
def suffix_budget(spark, d):
    return ranking.suffix_budget(_turns(spark, d), ["conv_id"], "turn", "tokens", 700).select("conv_id", "turn", "spent")


@query(_TURNS + ", s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM t WHERE tokens > 0) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM s WHERE used <= 400", base=False)
def section_fit(spark, d):
    return ranking.section_fit(_turns(spark, d), ["conv_id"], "turn", "tokens", 400).select("conv_id", "turn", "used")


@query()
def greedy_budget(spark, d):
    t = tables.read(spark, d, "conversations")
    rows = t.select("conv_id", F.col("turn").alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("node_id"), F.col("role").alias("kind"), text.token_estimate(F.col("text")).alias("tokens"), F.col("text").alias("preview"))
    return ranking.greedy_budget(rows, ["conv_id"], 400, 4)


@query(""", h AS (SELECT event_id AS id, user_id, event_id % 3 AS priority_rank, CASE signal_strength WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END AS signal_rank, occurred_at AS created_at FROM f WHERE type = 'error'),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority_rank, signal_rank DESC, created_at, id) AS n FROM h) SELECT id, user_id FROM r WHERE n <= 6 - user_id % 4""")
def queue_order_admit(spark, d):
    items = _queue(spark, d)
    pending = items.select("user_id", (F.col("user_id") % 4).alias("n")).distinct()
    return ranking.admit(items, pending, 6).select("id", "user_id")


def _queue(spark, d) -> DataFrame:
    return _found(spark, d).filter("type = 'error'").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 3).alias("priority_rank"), scoring.signal_rank(F.col("signal_strength")).alias("signal_rank"), F.col("occurred_at").alias("created_at"), F.when(F.col("event_id") % 4 == 0, F.timestamp_add("DAY", F.lit(2), "occurred_at")).alias("last_snoozed_at"))


@query(""", h AS (SELECT event_id AS id, user_id, event_id % 3 AS pr, CASE signal_strength WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END AS sr, occurred_at AS c, CASE WHEN event_id % 4 = 0 THEN occurred_at + INTERVAL 2 DAY END AS z FROM f WHERE type = 'error'),
    x AS (SELECT *, coalesce(z, c) + INTERVAL 7 DAY <= TIMESTAMP '2024-01-25' AS over FROM h), y AS (SELECT *, row_number() OVER (PARTITION BY user_id, over ORDER BY pr, sr DESC, c, id) AS n FROM x)
    SELECT id, CASE WHEN over THEN 'AUTO_RESOLVED' WHEN n > 3 THEN 'SUSPENDED_QUEUE_FULL' WHEN z + INTERVAL 24 HOUR > TIMESTAMP '2024-01-25' THEN 'SNOOZED' ELSE 'PENDING_HITL' END AS state FROM y""")
def queue_lifecycle(spark, d):
    return sessions.queue_state(_queue(spark, d), "2024-01-25", cap=3).select("id", "state")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, n <= 3 AS recent FROM r WHERE n <= 3 OR turn > 1", base=False)
def recent_turns(spark, d):
    return ranking.last_turns(tables.read(spark, d, "conversations"), 3, 1).select("conv_id", "turn", "recent")


# Scalars


@query(""", x AS (SELECT node_id, value, signal_strength, CAST(greatest(floor(date_diff('microsecond', occurred_at - INTERVAL 200 DAY, TIMESTAMP '2024-02-01') / 86400000000.0), 0) AS BIGINT) AS days, event_id % 7 - 1 AS hits, event_id % 4 = 0 AS unverified FROM f)
    SELECT node_id, floor((greatest(value / 100, 0) * CASE signal_strength WHEN 'CRITICAL' THEN 2.0 WHEN 'HIGH' THEN 1.5 ELSE 1.0 END * CASE WHEN days < 30 THEN 1.0 WHEN days < 180 THEN 0.85 WHEN days < 365 THEN 0.7 ELSE 0.5 END
    * CASE WHEN unverified THEN 0.5 ELSE 1.0 END * least(1 + 0.1 * greatest(hits, 0), 1.5)) * 1e4 + 0.5) / 1e4 AS score, days FROM x""")
def score_explain(spark, d):
    seen = F.timestamp_add("DAY", F.lit(-200), "occurred_at")
    hits = (F.col("event_id") % 7 - 1).cast("string")
    verified = F.when(F.col("event_id") % 4 == 0, "UNVERIFIED").otherwise("VERIFIED")
    s = scoring.final_score(F.col("value") / 100, F.col("signal_strength"), seen, verified, hits, NOW)
    return _found(spark, d).select("node_id", (F.floor(s * 1e4 + 0.5) / 1e4).alias("score"), temporal.quiet_days(seen, NOW).alias("days"))


@query("""SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normal, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS flat,
    replace(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ', '_') AS era_key FROM documents""", base=False)
def text_normalise(spark, d):
    t = F.col("text")
    return tables.read(spark, d, "documents").select("doc_id", text.normalise(t).alias("normal"), text.flatten(t).alias("flat"), text.era_key(t).alias("era_key"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+')) END AS words, left(sha256(text), 32) AS fingerprint FROM documents", base=False)
def token_estimate(spark, d):
    t = F.col("text")
    return tables.read(spark, d, "documents").select("doc_id", text.token_estimate(t).alias("tokens"), text.word_count(t).alias("words"), text.fingerprint(t).alias("fingerprint"))


_STOP = ", ".join(f"'{w}'" for w in ("", *text.STOP_WORDS))


@query(f"""WITH s AS (SELECT item_id, list_filter(list_distinct(string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), lambda x: x NOT IN ({_STOP})) AS w FROM benchmark)
    SELECT a.item_id AS left_id, b.item_id AS right_id, floor(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) * 1e5 + 0.5) / 1e5 AS score FROM s a JOIN s b ON b.item_id = a.item_id + 1 WHERE least(len(a.w), len(b.w)) > 0""", base=False)
def overlap_neighbours(spark, d):
    b = tables.read(spark, d, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("left_id"), F.col("item_id").alias("right_id"), F.col("text").alias("t"))
    pairs = b.join(after, b.item_id == after.left_id).filter((F.size(text.content_words(F.col("text"))) > 0) & (F.size(text.content_words(F.col("t"))) > 0))
    return _score(pairs.select("left_id", "right_id", text.overlap(F.col("text"), F.col("t")).alias("score")))


@query()
def filler_strip(spark, d):
    t = F.concat(F.lit("um, "), "text")
    return tables.read(spark, d, "conversations").select("conv_id", "turn", text.filler_count(t).alias("removed"), text.strip_fillers(t).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN length(t) > 80 THEN rtrim(left(t, 80)) || '…' ELSE t END AS summary FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)", base=False)
def local_summary(spark, d):
    return tables.read(spark, d, "conversations").select("conv_id", "turn", text.local_summary(F.col("text")).alias("summary"))


@query("""SELECT p_partkey, 'part_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 'part_' || p_partkey || '_v' || (p_size + 1) AS next_id, 'd_2024_01_02_' || lpad(CAST(p_size % 12 AS VARCHAR), 2, '0') || '_' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS scoped,
    CASE WHEN upper(trim(p_type)) IN ('PROMO', 'STANDARD') THEN upper(trim(p_type)) ELSE 'OTHER' END AS kind, sha256(p_name) AS hash FROM part""", base=False)
def identifiers(spark, d):
    c = F.col
    return tables.read(spark, d, "part").select(
        "p_partkey",
        ids.slug("part_", c("p_name")).alias("slug"),
        ids.versioned_id(F.concat(F.lit("part_"), "p_partkey", F.lit("_v"), "p_size"), c("p_size") + 1).alias("next_id"),
        ids.scoped_id(F.lit("d"), F.lit("2024-01-02").cast("date"), c("p_size") % 12, c("p_partkey") % 1000).alias("scoped"),
        ids.member(c("p_type"), ["PROMO", "STANDARD"], "OTHER").alias("kind"),
        ids.user_hash(c("p_name")).alias("hash"),
    )


@query(", x AS (SELECT node_id, occurred_at, date_trunc('week', occurred_at) AS s FROM f) SELECT node_id, s AS week, date_trunc('month', occurred_at) AS month, date_trunc('quarter', occurred_at) AS quarter, s + INTERVAL 8 DAY <= TIMESTAMP '2024-01-20' AS due FROM x")
def calendar_windows(spark, d):
    at = F.col("occurred_at")
    week = temporal.window_start("week", at)
    return _found(spark, d).select("node_id", week.alias("week"), temporal.window_start("month", at).alias("month"), temporal.window_start("quarter", at).alias("quarter"), temporal.due(temporal.window_shift("week", week, 1), 1, "2024-01-20").alias("due"))


# Decisions and writes

_GATED = """, x AS (SELECT 'd_' || event_id AS decision_id, node_id AS source_node_id, pattern_id || '_v1' AS target_node_id, occurred_at AS at, event_id,
      ['MERGE','REINFORCE','EVOLVE','BRANCH','CONTRADICT','DIALECTIC','REGULATE','AMBIGUOUS'][event_id % 8 + 1] AS a0, 0.7 + event_id % 31 / 100.0 AS c0,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'BRANCH' END AS r0, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.7 + event_id % 29 / 100.0 END AS rc0,
      CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PatternNode' ELSE 'BeliefNode' END AS tt, event_id % 2 = 0 AS standing,
      date_diff('microsecond', occurred_at - to_days(CAST(event_id % 300 AS INT)), TIMESTAMP '2024-02-01') / 86400000000.0 AS age,
      event_id % 11 = 0 AS breakthrough, event_id % 13 = 0 AS deviated, event_id % 5 = 0 AS extremum, event_id % 6 > 0 AS anchor, event_id % 9 > 0 AS worded FROM f),
    y AS (SELECT *, CASE WHEN a0 IN ('MERGE','REINFORCE','REGULATE','EVOLVE') THEN tt IS NOT NULL WHEN a0 IN ('BRANCH', 'AMBIGUOUS') THEN true WHEN a0 = 'CONTRADICT' THEN coalesce(tt = 'BeliefNode', false) AND standing ELSE tt IS NOT NULL AND standing END AS ok FROM x),
    z AS (SELECT *, NOT ok AND r0 IS NOT NULL AS swap, NOT ok AND r0 IS NULL AS impossible FROM y),
    s AS (SELECT * REPLACE (CASE WHEN swap THEN r0 ELSE a0 END AS a0, CASE WHEN swap THEN rc0 ELSE c0 END AS c0, CASE WHEN swap THEN a0 ELSE r0 END AS r0, CASE WHEN swap THEN c0 ELSE rc0 END AS rc0) FROM z),
    t AS (SELECT *, coalesce(r0 <> a0 AND abs(round(c0 * 100) - round(rc0 * 100)) < 5, false) AS tie FROM s),
    u AS (SELECT *, NOT impossible AND NOT tie AND a0 IN ('EVOLVE','CONTRADICT') AND floor(age) > 180 AND NOT breakthrough AND NOT deviated AND round(c0 * 100) < 98 AS trial FROM t),
    m AS (SELECT *, NOT impossible AND NOT tie AND NOT trial AND a0 = 'EVOLVE' AND extremum AS ext FROM u),
    n AS (SELECT *, CASE WHEN trial OR ext THEN a0 ELSE r0 END AS runner_up_action, CASE WHEN trial OR ext THEN c0 ELSE rc0 END AS runner_up, CASE WHEN tie AND NOT impossible THEN 'AMBIGUOUS' WHEN trial OR ext THEN 'BRANCH' ELSE a0 END AS action FROM m),
    gated AS (SELECT *, CASE WHEN impossible THEN 'IMPOSSIBLE_ACTION' WHEN tie THEN 'TIE' WHEN action = 'EVOLVE' AND NOT anchor THEN 'NO_CAUSAL_ANCHOR' WHEN action IN ('EVOLVE','CONTRADICT','DIALECTIC','REGULATE') AND NOT worded THEN 'MISSING_WORDING'
        WHEN round(c0, 2) < CASE action WHEN 'MERGE' THEN 0.88 WHEN 'REINFORCE' THEN 0.80 WHEN 'EVOLVE' THEN 0.93 WHEN 'BRANCH' THEN 0.75 WHEN 'CONTRADICT' THEN 0.85 WHEN 'DIALECTIC' THEN 0.88 WHEN 'REGULATE' THEN 0.82 ELSE 1 END THEN 'BELOW_THRESHOLD' END AS refused_by,
        CASE WHEN trial THEN 'TRIAL_NOT_TRAIT' WHEN ext THEN 'LOCAL_EXTREMUM' WHEN swap THEN 'IMPOSSIBLE_ACTION' END AS altered_by FROM n)"""


def _gated(spark, d) -> DataFrame:
    e = F.col("event_id")
    actions = F.array(*[F.lit(a) for a in ("MERGE", "REINFORCE", "EVOLVE", "BRANCH", "CONTRADICT", "DIALECTIC", "REGULATE", "AMBIGUOUS")])
    words = F.when(e % 9 > 0, "said").alias
    rows = _found(spark, d).select(
        F.concat(F.lit("d_"), "event_id").alias("decision_id"),
        F.col("node_id").alias("source_node_id"),
        F.concat("pattern_id", F.lit("_v1")).alias("target_node_id"),
        F.lit(1).alias("version"),
        F.col("occurred_at").alias("at"),
        F.element_at(actions, (e % 8 + 1).cast("int")).alias("action"),
        ((e % 31 + 70).cast("decimal(10,0)") / 100).cast("decimal(10,2)").alias("confidence"),
        F.when(e % 3 > 0, "BRANCH").alias("runner_up_action"),
        F.when(e % 3 > 0, (e % 29 + 70).cast("decimal(10,0)") / 100).cast("decimal(10,2)").alias("runner_up_confidence"),
        F.lit("ObservationNode").alias("source_type"),
        F.when(e % 4 == 1, "PatternNode").when(e % 4 > 1, "BeliefNode").alias("target_type"),
        (e % 2 == 0).alias("standing"),
        F.timestamp_add("DAY", (-(e % 300)).cast("int"), "occurred_at").alias("target_from"),
        (e % 11 == 0).alias("breakthrough"),
        (e % 13 == 0).alias("deviated"),
        (e % 5 == 0).alias("local_extremum"),
        (e % 6 > 0).alias("has_anchor"),
        words("delta_description"),
        words("contradiction_summary"),
        words("tension_summary"),
        words("regulation_summary"),
    )
    return decisions.apply_gates(rows, NOW)


@query(_GATED + " SELECT decision_id, action, refused_by, altered_by, runner_up_action, CAST(round(runner_up * 100) AS BIGINT) AS runner_up_percent FROM gated")
def decision_gates(spark, d):
    return _gated(spark, d).select("decision_id", "action", "refused_by", "altered_by", "runner_up_action", (F.col("runner_up_confidence") * 100).cast("long").alias("runner_up_percent"))


@query(_GATED + """ SELECT CASE action WHEN 'MERGE' THEN 'same_as' WHEN 'REINFORCE' THEN 'reinforces' WHEN 'EVOLVE' THEN 'evolved_from' WHEN 'BRANCH' THEN 'branches_to' WHEN 'CONTRADICT' THEN 'contradicts' WHEN 'DIALECTIC' THEN 'dialectic_with' WHEN 'REGULATE' THEN 'regulates' END AS edge_type,
    CASE action WHEN 'EVOLVE' THEN regexp_replace(target_node_id, '_v1$', '') || '_v2' WHEN 'CONTRADICT' THEN 'con_' || event_id ELSE source_node_id END AS from_id, CASE WHEN action = 'BRANCH' THEN 'pat_new_' || event_id ELSE target_node_id END AS to_id, decision_id
    FROM gated WHERE refused_by IS NULL AND action <> 'AMBIGUOUS'""")
def plan_edges(spark, d):
    return decisions.plan_edges(_gated(spark, d)).select("edge_type", "from_id", "to_id", "decision_id")


@query(_GATED + " SELECT CASE WHEN action = 'REINFORCE' THEN 'RECORD_REINFORCEMENT' ELSE 'MARK_SUPERSEDED' END AS operation, target_node_id AS node_id, count(*) AS n FROM gated WHERE refused_by IS NULL AND action IN ('REINFORCE', 'EVOLVE') GROUP BY 1, 2")
def bookkeeping(spark, d):
    return decisions.bookkeeping(_gated(spark, d)).groupBy("operation", "node_id").agg(F.count(F.lit(1)).alias("n"))


@query(_GATED + " SELECT coalesce(refused_by, 'NONE') AS refused_by, CASE WHEN refused_by IS NULL THEN 'ACTIVE' WHEN refused_by IN ('TIE', 'MISSING_WORDING', 'NO_CAUSAL_ANCHOR') THEN 'PENDING_HITL' ELSE 'BELOW_THRESHOLD' END AS status, count(*) AS n FROM gated GROUP BY 1, 2")
def audit_notes(spark, d):
    return decisions.audit_notes(_gated(spark, d)).groupBy(F.coalesce("refused_by", F.lit("NONE")).alias("refused_by"), "status").agg(F.count(F.lit(1)).alias("n"))


@query(", h AS (SELECT * FROM v QUALIFY version = max(version) OVER (PARTITION BY chain)) SELECT node_id || '_v' || (version + 1) AS node_id, version + 1 AS version, node_id AS previous_version_id, 'new' AS statement FROM h WHERE version % 2 = 0")
def next_versions(spark, d):
    v = tables.versions(spark, d)
    last = v.join(v.groupBy("chain").agg(F.max("version").alias("version")), ["chain", "version"]).select("chain", "node_id", "version", "previous_version_id", F.lit("old").alias("statement"), "valid_from")
    changes = last.filter("version % 2 = 0").select("node_id", F.lit("new").alias("statement"), F.lit(NOW).cast("timestamp").alias("at"))
    return decisions.next_versions(last, changes).select("node_id", "version", "previous_version_id", "statement")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'EMPTY_CONTENT' WHEN role = 'system' THEN 'UNKNOWN_TYPE' WHEN turn % 7 = 3 THEN 'EXCLUDED_TYPE' WHEN turn % 7 = 5 THEN 'TYPE_NOT_ALLOWED_HERE' WHEN turn % 3 = 2 THEN 'UNKNOWN_ENUM_VALUE' WHEN role = 'user' AND turn % 7 NOT IN (3, 5) AND turn % 3 = 0 THEN 'SIGNAL_FLOOR' END AS rule FROM conversations""", base=False)
def validate_findings(spark, d):
    t, role = F.col("turn"), F.col("role")
    kind = F.when(role == "system", "nonsense").when(t % 7 == 3, " emotion ").when(t % 7 == 5, "belief").when(role == "user", "core_wound").otherwise("context")
    rows = tables.read(spark, d, "conversations").select("conv_id", "turn", F.when(t % 5 == 4, " ").otherwise("x").alias("content"), kind.alias("type"), F.when(t % 3 == 0, "standard").when(t % 3 == 1, "HIGH").otherwise("loud").alias("signal_strength"))
    return decisions.validate_findings(rows, ["EMOTION", "BELIEF", "CORE_WOUND", "CONTEXT"], ["EMOTION"], ["CORE_WOUND", "CONTEXT", "EMOTION"], ["CORE_WOUND"]).select("conv_id", "turn", "rule")


@query(""", s AS (SELECT episode_id AS chain_id, row_number() OVER (PARTITION BY episode_id ORDER BY occurred_at, event_id) AS step_index, type AS kind, bool_or(type = 'click') OVER (PARTITION BY episode_id) AS bad, count(*) OVER (PARTITION BY episode_id) AS n FROM w)
    SELECT chain_id, step_index, CASE kind WHEN 'view' THEN 'TRIGGER' WHEN 'signup' THEN 'LESSON' WHEN 'error' THEN 'ACTION' ELSE 'OUTCOME' END AS kind FROM s WHERE n >= 2 AND NOT bad""")
def validate_chains(spark, d):
    kind = F.when(F.col("type") == "view", "TRIGGER").when(F.col("type") == "signup", "LESSON").when(F.col("type") == "error", "ACTION").when(F.col("type") == "purchase", "OUTCOME").otherwise("CLICK")
    steps = _week(spark, d).select(F.col("episode_id").alias("chain_id"), F.struct("occurred_at", "event_id").alias("step"), kind.alias("kind"), F.lit("x").alias("content"))
    return decisions.validate_chains(steps).select("chain_id", "step_index", "kind")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[ERASED: 2024-02-01]' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'person_' || left(sha256(trim(c_name)), 8) ELSE c_name END AS c_name FROM customer""", base=False)
def redact_rows(spark, d):
    rows = tables.read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return erasure.anonymise(rows, rows.filter("c_custkey % 3 = 0"), ["c_mktsegment"], ["c_name"], F.lit(NOW).cast("timestamp"), "c_custkey")


@query(" SELECT type, count(*) AS n FROM f WHERE user_id = 5 GROUP BY 1")
def erasure_preview(spark, d):
    found = _found(spark, d)
    return erasure.preview(found, found.filter("user_id = 5"), "type")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE n = 1", base=False)
def latest_wins(spark, d):
    o = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return sinks.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_custkey", "at").select("o_custkey", "o_orderkey")


@query(", a AS (SELECT 'unknown end' AS problem, from_id AS id FROM g WHERE edge_type = 'contains_obs' UNION SELECT 'unknown end', pattern_id FROM f UNION SELECT 'unknown end', person FROM f) SELECT * FROM a UNION ALL SELECT 'exists', node_id FROM f WHERE event_id % 9 = 0")
def plan_problems(spark, d):
    found = _found(spark, d)
    return sinks.plan_problems(found.select("node_id"), tables.edges(found), found.filter("event_id % 9 = 0").select("node_id"))


@query(" SELECT target, count(*) AS n FROM (SELECT 'GRAPH_NODE' AS target FROM w UNION ALL SELECT 'GRAPH_EDGE' FROM g WHERE from_id IN (SELECT node_id FROM w) UNION ALL SELECT 'VECTOR' FROM embeddings) GROUP BY 1")
def write_log(spark, d):
    found, week = _found(spark, d), _week(spark, d)
    edges = tables.edges(found).join(week.select(F.col("node_id").alias("from_id")), "from_id", "left_semi")
    return sinks.write_log("job", week, edges, tables.vectors(spark, d), F.lit(NOW).cast("timestamp")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


# Sessions and streams' batch form


@query(""", o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS started_at, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, k""")
def session_decay(spark, d):
    return sessions.sessions(tables.read(spark, d, "events"))


@query(" SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS events FROM events GROUP BY 1, 2")
def daily_sessions(spark, d):
    return sessions.daily(tables.read(spark, d, "events"))


@query(""", days AS (SELECT DISTINCT date_trunc('day', created_at)::TIMESTAMP - to_days(CAST(i AS INT)) AS s FROM dec, range(0, 2) r(i))
    SELECT s AS window_start, s + INTERVAL 48 HOUR AS window_end, count(*) AS decisions, count(DISTINCT target_node_id) AS targets FROM days JOIN dec ON created_at >= s AND created_at < s + INTERVAL 48 HOUR GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT target_node_id) >= 2""")
def burst_sliding(spark, d):
    made = tables.decisions(_found(spark, d)).select(F.col("created_at").alias("ts"), F.col("target_node_id").alias("target"))
    return sessions.bursts(made)


@query(" SELECT user_id AS session_id, arg_min(event_id, (ts, event_id)) AS claim_id FROM events GROUP BY 1")
def claim_once(spark, d):
    claims = tables.read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("claim_id"), "ts")
    return sessions.claim_once(claims).select("session_id", "claim_id")


@query()
def rate_limit(spark, d):
    attempts = tables.read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return sessions.rate_limited(attempts, limit=3, seconds=86400)


@query(" SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_events(spark, d):
    return sessions.ring(tables.read(spark, d, "events")).select("event_id", "ts")


@query()
def buffer_replay(spark, d):
    found = _found(spark, d)
    w = Window.partitionBy("user_id").orderBy("occurred_at", "event_id")
    offers = found.select(F.col("user_id").alias("conv_id"), F.row_number().over(w).cast("long").alias("turn"), F.lit(0).alias("pos"), F.col("pattern_id").alias("node_id"), (F.col("signal_strength") == "CRITICAL").alias("protected"))
    return buffer.replay(offers)


@query(", j AS (SELECT user_id, event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT *, ['PENDING','RUNNING','COMPLETE','FAILED','CANCELLED'][event_id % 5 + 1] AS status FROM f)) SELECT user_id AS job_id, event_id AS seq, status FROM j WHERE CASE WHEN b IS NULL THEN status <> 'PENDING' ELSE NOT ((b = 'PENDING' AND status IN ('RUNNING', 'CANCELLED')) OR (b = 'RUNNING' AND status IN ('COMPLETE', 'FAILED', 'CANCELLED')) OR (b = 'FAILED' AND status = 'RUNNING')) END")
def bad_transitions(spark, d):
    states = F.array(*[F.lit(s) for s in ("PENDING", "RUNNING", "COMPLETE", "FAILED", "CANCELLED")])
    log = _found(spark, d).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("status"))
    return decisions.bad_transitions(log).select("job_id", "seq", "status")


@query("SELECT conv_id, turn, CASE WHEN turn % 9 = 8 THEN 'SAFETY_FLOOR' WHEN turn % 4 = 1 THEN 'ACKNOWLEDGEMENT' ELSE 'CLASSIFIED' END AS path FROM conversations", base=False)
def formulation_paths(spark, d):
    t = F.col("turn")
    said = F.when(t % 9 == 8, "I can't go on anymore!").when(t % 4 == 1, "Yeah, interesting.").otherwise(F.concat(F.lit("so "), "text"))
    return tables.read(spark, d, "conversations").select("conv_id", "turn", retrieval.formulation_path(said).alias("path"))


# Row shaping


@query(" SELECT type, upper(type) AS kind, CASE type WHEN 'error' THEN 'BELIEF' WHEN 'click' THEN 'PATTERN' WHEN 'signup' THEN 'OPEN_LOOP' END AS target, count(*) AS n FROM f GROUP BY 1")
def promotions(spark, d):
    kind = F.when(F.col("type") == "error", "CORE_WOUND").when(F.col("type") == "click", "RUMINATION_LOOP").when(F.col("type") == "signup", "OPEN_LOOP").otherwise("EMOTION")
    return _found(spark, d).groupBy("type", F.upper("type").alias("kind"), shaping.promotion(kind).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(""" SELECT node_id, CASE WHEN signal_strength = 'HIGH' THEN type || ' ' || person ELSE person END AS index_text,
    CASE event_id % 3 WHEN 0 THEN 'Pattern' WHEN 1 THEN 'Belief' ELSE 'Noted' END || ': ' || type || ' (' || strftime(event_date, '%Y-%m-%d') || ')' AS line,
    left(CASE WHEN event_id % 2 = 0 THEN node_id ELSE type END, 240) AS preview FROM f""")
def renderings(spark, d):
    c = F.col
    part = F.when(c("signal_strength") == "HIGH", c("type")).otherwise("  ")
    kind = F.when(c("event_id") % 3 == 0, "PatternNode").when(c("event_id") % 3 == 1, "BeliefNode").otherwise("ObservationNode")
    blank = F.when(c("event_id") % 2 == 0, " ").otherwise(c("type"))
    return _found(spark, d).select("node_id", shaping.index_text([part, c("person")]).alias("index_text"), shaping.render_line(kind, c("type"), c("event_date")).alias("line"), text.preview([F.lit(None).cast("string"), blank], c("node_id")).alias("preview"))


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Me' ELSE 'AI' END || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS dialogue FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY 1", base=False)
def dialogues(spark, d):
    return shaping.dialogue(tables.read(spark, d, "conversations"))


@query("SELECT conv_id, coalesce(bool_and(turn % 4 = 0) FILTER (role = 'user' AND trim(text) <> ''), true) AS discard FROM conversations GROUP BY 1", base=False)
def discards(spark, d):
    return shaping.discard(tables.read(spark, d, "conversations").withColumn("operational", F.col("turn") % 4 == 0))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'RAW_CAPTURE' ELSE 'REFLECTION' END AS entry_class FROM documents LEFT JOIN labels USING (doc_id)", base=False)
def entry_classes(spark, d):
    labels = tables.read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("coherence"))
    return tables.read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", shaping.entry_class(F.col("coherence")).alias("entry_class"))


@query("""WITH s AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS segment, turn FROM conversations WHERE turn % 3 > 0 UNION ALL SELECT conv_id, 2, turn FROM conversations WHERE turn < 2),
    a AS (SELECT conv_id, turn, min(segment) AS segment FROM s GROUP BY 1, 2), l AS (SELECT conv_id, max(segment) AS last FROM s GROUP BY 1)
    SELECT conv_id, turn, coalesce(segment, coalesce(last, -1) + 1) AS segment FROM conversations LEFT JOIN a USING (conv_id, turn) LEFT JOIN l USING (conv_id)""", base=False)
def split_turns(spark, d):
    t = tables.read(spark, d, "conversations").select("conv_id", "turn")
    segments = t.filter("turn % 3 > 0").select("conv_id", F.when(F.col("turn") % 2 == 0, 0).otherwise(1).alias("segment"), "turn").union(t.filter("turn < 2").select("conv_id", F.lit(2), "turn"))
    return shaping.split_turns(t, segments).select("conv_id", "turn", "segment")


@query("""WITH e AS (SELECT conv_id, least(turn, 2) AS idx, turn, role FROM conversations)
    SELECT conv_id AS session, idx, string_agg(role, chr(10) || chr(10) ORDER BY turn) AS text, array_to_string(list_sort(list_distinct(list(role))), ',') AS themes, arg_min('era' || turn, turn) FILTER (turn % 2 = 1) AS era FROM e GROUP BY 1, 2""", base=False)
def cap_episodes(spark, d):
    t = tables.read(spark, d, "conversations")
    rows = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), F.col("role").alias("text"), F.array("role").alias("themes"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("era"), "turn")).alias("era"))
    return shaping.cap_episodes(rows, 3).withColumn("themes", F.array_join("themes", ","))


@query(" SELECT node_id, 'obs_' || strftime(event_date, '%Y_%m_%d') || '_' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') || '_' || lpad(CAST(row_number() OVER (PARTITION BY episode_id ORDER BY occurred_at, event_id) AS VARCHAR), 3, '0') AS minted_id FROM f")
def minted_ids(spark, d):
    return shaping.mint_ids(_found(spark, d), "obs", "event_date", ["episode_id"], ["occurred_at", "event_id"], F.col("user_id") % 12).select("node_id", "minted_id")


@query("""WITH b AS (SELECT p_partkey, 'part_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS s, DATE '2024-01-01' + CAST(p_partkey % 3 AS INT) AS day FROM part),
    x AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) = 1 AND s NOT LIKE '%1' AS plain FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY s, day, plain ORDER BY p_partkey) AS n FROM x)
    SELECT p_partkey, CASE WHEN plain THEN s ELSE s || strftime(day, '_%Y_%m_%d') || CASE WHEN n > 1 THEN '_' || n ELSE '' END END AS slug FROM k""", base=False)
def unique_slugs(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 3).cast("int"))
    part = tables.read(spark, d, "part").select("p_partkey", "p_brand", day.alias("day"))
    taken = part.select(ids.slug("part_", F.col("p_brand")).alias("slug")).distinct().filter("slug like '%1'")
    return shaping.unique_slugs(part, "part_", "p_brand", "day", "p_partkey", taken).select("p_partkey", "slug")


@query("SELECT c_custkey, n_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_nationkey % 2 = 1", base=False)
def people_by_name(spark, d):
    nation = tables.read(spark, d, "nation")
    rows = tables.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lower("n_name"), F.lit("! ")).alias("said"))
    known = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("name"))
    return shaping.by_name(rows, "said", known, "name").select("c_custkey", F.col("node_id").alias("nation"))


@query(" SELECT target_node_id AS pattern_id, node_id FROM dec WHERE target_node_id IN (SELECT pattern_id FROM q WHERE signal_strength = 'CRITICAL')")
def known_references(spark, d):
    found = _found(spark, d)
    refs = tables.decisions(found).select(F.col("target_node_id").alias("pattern_id"), "node_id")
    return shaping.keep_known(refs, _previous(spark, d).filter("signal_strength = 'CRITICAL'").select("pattern_id").distinct(), "pattern_id")[0]


@query(" SELECT pattern_id AS node_id, arg_min(user_id, event_id) AS job_id FROM f GROUP BY 1")
def first_writers(spark, d):
    return shaping.first_writer(_found(spark, d).select(F.col("pattern_id").alias("node_id"), F.col("user_id").alias("job_id"), F.col("event_id").alias("seq")))


@query(""", i AS (SELECT event_id AS id, episode_id, CAST(floor(date_diff('microsecond', CASE WHEN event_id % 4 = 0 THEN occurred_at + INTERVAL 2 DAY ELSE occurred_at END, TIMESTAMP '2024-02-05') / 86400000000.0) AS BIGINT) AS age_days FROM f WHERE type = 'error'),
    e AS (SELECT episode_id, count(*) AS findings FROM w GROUP BY 1)
    SELECT id, age_days, greatest(7 - age_days, 0) AS days_left, id % 3 > 0 AS stale, e.findings AS summary FROM i LEFT JOIN e USING (episode_id)""")
def queue_cards(spark, d):
    found = _found(spark, d)
    items = _queue(spark, d).join(found.select(F.col("event_id").alias("id"), "episode_id"), "id")
    proposals = items.filter("id % 3 = 0").select("id", F.lit("{}").alias("payload"))
    summaries = _week(spark, d).groupBy("episode_id").agg(F.count(F.lit(1)).alias("summary"))
    return shaping.queue_cards(items, proposals, summaries, "2024-02-05").select("id", "age_days", "days_left", "stale", "summary")


@query(" SELECT node_id, value FROM f ORDER BY value DESC, occurred_at DESC, node_id LIMIT 40")
def offer_order(spark, d):
    return shaping.offer_order(_found(spark, d).withColumn("rank_score", F.col("value"))).select("node_id", "value").limit(40)


@query(" SELECT episode_id AS node_id, 0 AS hop FROM f WHERE user_id = 5 UNION SELECT node_id, 1 FROM f WHERE user_id = 5")
def episode_contents(spark, d):
    found = _found(spark, d)
    start = tables.episodes(found).filter("user_id = 5").select(F.col("episode_id").alias("node_id"))
    inside = graph.live_edges(tables.edges(found), include_invalidated=True, types=["contains_obs"])
    return graph.neighbourhood(inside, start, 1, "out")[0]
