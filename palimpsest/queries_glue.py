"""More of the catalogue: what lies between the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import vectors
from palimpsest.plans import glue, report
from palimpsest.queries import NEXT_WEEK, WEEK, _COS, _found, _score, _vector, _week, query
from palimpsest.queries_flow import _REC, _records
from palimpsest.sources import tables
from palimpsest.streaming import sessions

_c = F.col
_CLASS = "CASE WHEN event_id % 4 = 0 THEN 'RAW_CAPTURE' ELSE 'REFLECTION' END"


def _class(e):
    return F.when(e % 4 == 0, "RAW_CAPTURE").otherwise("REFLECTION")


@query(_REC + """ SELECT label, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN type = 'click' THEN 'LessonNode' ELSE label END AS label) FROM rec)
    WHERE CASE WHEN label = 'PatternNode' THEN coalesce(status, '') <> 'SUPERSEDED' WHEN label = 'LessonNode' THEN occurred_at < TIMESTAMP '2024-01-15' ELSE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-15' END GROUP BY 1""")
def windowed_reads(spark, d):
    r = _records(spark, d).withColumn("label", F.when(_c("type") == "click", "LessonNode").otherwise(_c("label")))
    return glue.windowed_reads(r, WEEK, NEXT_WEEK).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT DISTINCT 'loop_' || pattern_id AS loop_id FROM w WHERE type = 'purchase' AND event_id % 10 > 0")
def closed_loops(spark, d):
    gone = F.when(_c("event_id") % 10 == 0, _c("occurred_at")).alias("invalidated_at")
    closes = _found(spark, d).filter("type = 'purchase'").select(F.lit("closes").alias("edge_type"), _c("episode_id").alias("from_id"), F.concat(F.lit("loop_"), "pattern_id").alias("to_id"), gone)
    week = _week(spark, d).filter("type = 'purchase' and event_id % 10 > 0")
    return glue.closed_loops(closes, week)


@query(""", l AS (SELECT type AS section, count(*) AS n, string_agg(line, chr(10) ORDER BY pattern_id) AS text FROM (SELECT type, pattern_id, pattern_id || ': ' || count(*) AS line FROM w GROUP BY 1, 2) GROUP BY 1)
    SELECT section, text FROM (SELECT *, sum(length(text)) OVER (ORDER BY section) AS used FROM l) WHERE used <= 400""")
def report_brief(spark, d):
    lines = _week(spark, d).groupBy("type", "pattern_id").agg(F.count(F.lit(1)).alias("n"))
    return glue.brief(lines.select(_c("type").alias("section"), _c("type").alias("place"), _c("pattern_id").alias("pos"), F.concat("pattern_id", F.lit(": "), _c("n").cast("string")).alias("line")), 400)


@query(" SELECT event_id AS item_id, CASE WHEN event_id % 7 = 0 THEN 'SEARCH_FAILED' ELSE 'UNREADABLE_ANSWER' END AS refused_by FROM w WHERE event_id % 7 = 0 OR event_id % 3 = 0")
def unanswered_items(spark, d):
    item = _c("event_id").alias("item_id")
    w = _week(spark, d)
    return glue.unanswered(w.select(item), w.filter("event_id % 3 > 0").select(item), w.select(item, (_c("event_id") % 7 == 0).alias("failed")))


@query(f""", c AS (SELECT event_id AS item_id, unnest([pattern_id, person, pattern_id]) AS node_id, unnest(['STRUCTURAL', 'STRUCTURAL', 'SEMANTIC']) AS found_by, unnest([0, 1, 2]) AS pos FROM w WHERE {_CLASS} <> 'RAW_CAPTURE')
    SELECT item_id, node_id, row_number() OVER (PARTITION BY item_id ORDER BY b, node_id) AS place FROM (SELECT item_id, node_id, min(CASE found_by WHEN 'SEMANTIC' THEN 0 ELSE 100 END + pos) AS b FROM c GROUP BY 1, 2)""")
def items_to_decide(spark, d):
    w = _week(spark, d).withColumn("item_id", _c("event_id"))
    found = F.explode(F.array(*[F.struct(n.alias("node_id"), F.lit(by).alias("found_by"), F.lit(i).alias("pos")) for i, (n, by) in enumerate(((_c("pattern_id"), "STRUCTURAL"), (_c("person"), "STRUCTURAL"), (_c("pattern_id"), "SEMANTIC")))]))
    return glue.to_decide(w.select("item_id", _class(_c("event_id")).alias("entry_class")), w.select("item_id", found.alias("f")).select("item_id", "f.*"))


@query(" SELECT episode_id, coalesce(arg_min(node_id, (CASE type WHEN 'signup' THEN 0 ELSE 1 END, occurred_at, node_id)) FILTER (type IN ('signup', 'click')), 'ses_' || episode_id) AS anchor_id FROM f GROUP BY episode_id")
def episode_anchors(spark, d):
    found = _found(spark, d)
    label = F.when(_c("type") == "signup", "SessionNode").when(_c("type") == "click", "EventNode").otherwise("ObservationNode")
    return glue.with_anchor(tables.episodes(found), found.select("episode_id", "node_id", label.alias("label"), _c("occurred_at").alias("pos")))


@query("""WITH m AS (SELECT conv_id, turn, role FROM conversations WHERE role <> 'user' OR length(text) % 3 > 0), s AS (SELECT conv_id, bool_or(role = 'user') AS me, bool_or(role <> 'user') AS you FROM m GROUP BY 1)
    SELECT conv_id, turn, CASE WHEN you THEN 'DIALOGUE' ELSE 'MONOLOGUE' END AS form FROM m JOIN s USING (conv_id) WHERE me""", base=False)
def rebuilt_conversations(spark, d):
    m = tables.read(spark, d, "conversations").withColumn("operational", F.char_length("text") % 3 == 0)
    return glue.rebuilt(m).select("conv_id", "turn", "form")


@query(f" SELECT DISTINCT user_id AS session_id, unnest([type, pattern_id, person]) AS prompt FROM w WHERE {_CLASS} = 'RAW_CAPTURE'")
def reflection_prompts(spark, d):
    e = _week(spark, d).select(_c("user_id").alias("session_id"), _class(_c("event_id")).alias("entry_class"), F.array("type", "pattern_id", "person", "node_id").alias("prompts"))
    return glue.prompts(e)


@query(" SELECT pattern_id, count(DISTINCT event_date) AS dates FROM w GROUP BY 1 HAVING count(DISTINCT event_date) > 1")
def sessions_of_many_dates(spark, d):
    return glue.many_dates(_week(spark, d), "pattern_id")


@query(f" SELECT node_id, CASE type WHEN 'click' THEN 'EventNode' WHEN 'signup' THEN 'SessionNode' ELSE 'ObservationNode' END AS kind, type AS text, episode_id FROM w WHERE type IN ('click', 'signup') OR {_CLASS} <> 'RAW_CAPTURE'")
def search_targets(spark, d):
    w = _week(spark, d).withColumn("entry_class", _class(_c("event_id")))
    pick = lambda cond, name: w.filter(cond).withColumn(name, _c("type"))
    return glue.searchable(pick("type not in ('click', 'signup')", "content"), pick("type = 'click'", "event_summary"), pick("type = 'signup'", "summary"))


@query("""WITH t AS (SELECT conv_id || '-' || turn AS turn_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
    l AS (SELECT conv_id || '-' || (turn - 1) AS turn_id, '- ' || string_split(text, chr(10))[1] || CASE WHEN len(string_split(text, chr(10))) > 1 THEN chr(10) || '- ' || string_split(text, chr(10))[2] ELSE '' END AS body FROM conversations WHERE role = 'assistant')
    SELECT turn_id, concat_ws(chr(10), CASE WHEN body IS NOT NULL THEN CASE WHEN turn % 4 = 0 THEN 'From the turn before:' ELSE 'What is known:' END WHEN length(text) % 5 = 0 THEN 'Nothing could be looked up.' END, body, CASE WHEN length(text) % 7 = 0 THEN 'watch out' END) AS block
    FROM t LEFT JOIN l USING (turn_id)""", base=False)
def context_blocks(spark, d):
    """What each turn of a user would be given: the first two lines of the answer to it stand for what was found."""
    t = tables.read(spark, d, "conversations")
    name, n = lambda turn: F.concat_ws("-", "conv_id", turn), F.char_length("text")
    turns = t.filter("role = 'user'").select(name(_c("turn")).alias("turn_id"), (_c("turn") % 4 == 0).alias("deferred"), (n % 5 == 0).alias("search_failed"), F.when(n % 7 == 0, "watch out").alias("alert"))
    lines = t.filter("role = 'assistant'").select(name(_c("turn") - 1).alias("turn_id"), F.posexplode(F.slice(F.split("text", "\n"), 1, 2)).alias("pos", "line"))
    return glue.context_block(lines, turns)


@query(" SELECT node_id, (SELECT string_agg(DISTINCT g2.type, ',' ORDER BY g2.type) FROM w g2 WHERE g2.user_id = w.user_id AND g2.event_date = w.event_date AND g2.event_id <= w.event_id AND g2.event_id % 3 > 0) AS open FROM w")
def unlocked_domains(spark, d):
    e = _c("event_id")
    turns = _week(spark, d).select("node_id", _c("user_id").alias("session_id"), _c("event_date").alias("day"), e.alias("turn"), F.when(e % 3 > 0, _c("type")).alias("opened"))
    return glue.unlocked(turns).select("node_id", F.nullif(F.array_join("open", ","), F.lit("")).alias("open"))


@query(" SELECT episode_id, CASE WHEN event_date >= DATE '2024-01-12' THEN 'new' ELSE 'changed' END AS state FROM w WHERE event_date >= DATE '2024-01-12' OR user_id % 2 = 0 GROUP BY 1, 2")
def saved_episodes(spark, d):
    e = tables.episodes(_week(spark, d)).withColumn("fingerprint", F.sha2("episode_id", 256))
    saved = e.filter("event_date < '2024-01-12'").withColumn("fingerprint", F.when(_c("user_id") % 2 == 0, "old").otherwise(_c("fingerprint")))
    new, changed = glue.already_saved(e, saved)
    return new.select("episode_id", F.lit("new").alias("state")).unionByName(changed.select("episode_id", F.lit("changed").alias("state")))


@query(" SELECT user_id AS batch_id, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS messages, CASE WHEN bool_and(value < 120) THEN max(occurred_at) END AS finished_at FROM w GROUP BY 1")
def import_batches(spark, d):
    w = _week(spark, d)
    return glue.batches(w.select(_c("user_id").alias("batch_id"), F.when(_c("value") < 60, "COMPLETE").when(_c("value") < 120, "FAILED").otherwise("RUNNING").alias("status"), _c("event_id").alias("messages"), _c("occurred_at").alias("finished_at")))


@query(" SELECT person AS item_id, min(event_id) AS seq FROM w WHERE user_id % 2 = 0 GROUP BY 1")
def settled_items(spark, d):
    w = _week(spark, d)
    items = w.select(_c("person").alias("item_id"), F.when(_c("user_id") % 2 == 0, "PENDING_HITL").otherwise("RESOLVED").alias("status")).distinct()
    return glue.settle(items, w.select(_c("person").alias("item_id"), _c("event_id").alias("seq"), F.lit("PRIMARY").alias("choice")))[0].select("item_id", "seq")


@query(""" SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS place FROM (SELECT user_id, event_date AS day, row_number() OVER (PARTITION BY user_id ORDER BY event_date DESC) AS r
    FROM f WHERE event_date < DATE '2024-01-20' AND event_date >= DATE '2024-01-06' GROUP BY 1, 2 HAVING count(*) > 1) WHERE r <= 3""")
def earlier_days(spark, d):
    days = sessions.daily(_found(spark, d).withColumn("ts", _c("occurred_at"))).withColumn("summary", F.when(_c("events") > 1, "told").otherwise(" "))
    return glue.earlier_days(days, "2024-01-20").select("user_id", _c("day").cast("date").alias("day"), "place")


@query(" SELECT node_id, CASE event_id % 3 WHEN 0 THEN user_id % 2 = 0 WHEN 1 THEN EXISTS (SELECT 1 FROM f WHERE type = 'purchase') ELSE true END AS grounded FROM w")
def grounded_triggers(spark, d):
    e = _c("event_id")
    raw = _week(spark, d).select("node_id", F.when(e % 3 == 0, "NAMED_PERSON").when(e % 3 == 1, "OPEN_LOOP_MATCH").otherwise("SOMATIC_MARKER").alias("kind"), _c("person").alias("person_id"))
    found = _found(spark, d)
    return glue.grounded_triggers(raw, found.filter("user_id % 2 = 0").select(_c("person").alias("node_id")), found.filter("type = 'purchase'")).select("node_id", "grounded")


@query(""" SELECT said, CASE WHEN said = ' crisis' THEN 'CRISIS' WHEN said = 'Elevated ' THEN 'ELEVATED' ELSE 'STABLE' END AS tone, count(*) AS n
    FROM (SELECT CASE signal_strength WHEN 'CRITICAL' THEN ' crisis' WHEN 'HIGH' THEN 'Elevated ' ELSE type END AS said FROM f) GROUP BY 1, 2""")
def registers(spark, d):
    """The tone that the weight of each finding says; what isn't a tone is STABLE."""
    said = F.when(_c("signal_strength") == "CRITICAL", " crisis").when(_c("signal_strength") == "HIGH", "Elevated ").otherwise(_c("type"))
    return _found(spark, d).select(said.alias("said")).groupBy("said", glue.register(_c("said")).alias("tone")).agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT 'vec_' || event_id AS node_id, event_id IN (SELECT vec_id FROM embeddings) AS has_vector FROM w")
def buffer_entries(spark, d):
    found = _week(spark, d).select(F.concat(F.lit("vec_"), "event_id").alias("node_id"))
    return glue.buffer_entries(found, tables.vectors(spark, d)).select("node_id", _c("embedding").isNotNull().alias("has_vector"))


@query(" SELECT event_id, 'erasure_' || strftime(occurred_at, '%Y_%m_%d') || '_' || lpad(CAST(row_number() OVER (PARTITION BY event_date ORDER BY occurred_at, user_id) + CASE WHEN event_date = DATE '2024-01-09' THEN 4 ELSE 0 END AS VARCHAR), 3, '0') AS audit_id FROM w WHERE type = 'error'")
def audit_ids(spark, d):
    taken = spark.createDataFrame([("erasure_2024_01_09_002",), ("erasure_2024_01_09_004",), ("other",)], "audit_id string")
    return glue.audit_ids(_week(spark, d).filter("type = 'error'").select("event_id", "user_id", _c("occurred_at").alias("at")), taken).select("event_id", "audit_id")


@query(" SELECT episode_id, NOT bool_or(event_id % 11 = 0) AND count(*) FILTER (type = 'error') = 0 AND count(*) > 1 AND NOT bool_or(value > 150) AS trusted FROM w GROUP BY 1")
def trusted_readings(spark, d):
    w = _week(spark, d)
    outcomes = w.groupBy("episode_id").agg(F.bool_or(_c("event_id") % 11 == 0).alias("fallback"), F.count_if(_c("type") == "error").alias("abandoned"), (F.count(F.lit(1)) - 1).alias("kept"))
    return glue.trustworthy(outcomes, w.select("episode_id", F.when(_c("value") > 150, "OVER_LIMIT").otherwise("EMPTY_CONTENT").alias("rule")))


@query(" SELECT node_id, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS n, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') AS at, '[\"' || type || '\"]' AS kinds FROM w")
def flat_rows(spark, d):
    rows = _week(spark, d).select("node_id", _c("occurred_at").alias("at"), F.array("type").alias("kinds"), F.when(_c("event_id") % 2 == 0, "x").alias("maybe"), F.lit("").alias("blank"))
    return glue.flat_row(rows, "node_id").select("node_id", F.size("properties").alias("n"), _c("properties")["at"].alias("at"), _c("properties")["kinds"].alias("kinds"))


@query(f"WITH s AS (SELECT a.vec_id, a.label, {_COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 7), t AS (SELECT * FROM s ORDER BY s DESC, 'vec_' || vec_id LIMIT 20) SELECT 'vec_' || vec_id AS node_id, floor(s * 1e5 + 0.5) / 1e5 AS score FROM t WHERE label <> (SELECT label FROM embeddings WHERE vec_id = 7) ORDER BY s DESC, 1 LIMIT 5", base=False)
def ingest_retrieval(spark, d):
    """What reads like a record, but isn't of its own episode (here: its label): fetched, filtered, and a few kept."""
    own = _vector(spark, d).select(_c("kind").alias("own"))
    near = vectors.top_k(tables.vectors(spark, d), _vector(spark, d), 20).withColumnRenamed("kind", "episode_id").join(F.broadcast(own))  # one row
    return _score(glue.usable(near, _c("own")).orderBy(F.desc("score"), "node_id").limit(5)).select("node_id", "score")


@query(" SELECT node_id, episode_id, event_date FROM w WHERE type = 'signup'")
def biographical_gaps(spark, d):
    return report.of_kind(_week(spark, d), ["signup"]).select("node_id", "episode_id", "event_date")


@query(" SELECT branches, contradictions, CASE WHEN branches > 0 AND contradictions > 0 THEN 'things shifted and clashed' WHEN contradictions > 0 THEN 'things clashed' WHEN branches > 0 THEN 'things shifted' ELSE 'nothing stood out' END AS said FROM (SELECT event_date, count(*) FILTER (type = 'purchase') AS branches, count(*) FILTER (type = 'error') AS contradictions FROM f WHERE user_id = 3 GROUP BY 1)")
def burst_wording(spark, d):
    days = _found(spark, d).filter("user_id = 3").groupBy("event_date").agg(F.count_if(_c("type") == "purchase").alias("branches"), F.count_if(_c("type") == "error").alias("contradictions"))
    return days.select("branches", "contradictions", report.shadow_wording(_c("branches"), _c("contradictions")).alias("said"))


