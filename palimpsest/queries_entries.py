"""More of the catalogue: from messages to episodes, and from readings of episodes to records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.plans import assembly, preprocess
from palimpsest.queries import _found, _week, query
from palimpsest.sources import tables

_c = F.col

# A third of the conversations have one side only; replies are made of the table's own texts, and some are missing or blank.
_SQL = """WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id % 3 > 0 OR role <> 'assistant'),
    side AS (SELECT conv_id, bool_or(role = 'assistant') AS dia FROM m GROUP BY 1),
    k AS (SELECT m.*, dia, role = 'user' AND (length(text) % 7 = 0 OR conv_id % 11 = 0) AS act FROM m JOIN side USING (conv_id)),
    kept AS (SELECT *, CASE WHEN role = 'user' THEN 'Me: ' ELSE 'AI: ' END || text AS line FROM k WHERE role <> 'system' AND trim(text) <> '' AND (NOT dia OR NOT act)),
    raw AS (SELECT conv_id, string_agg(CASE WHEN dia THEN line ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text FROM kept GROUP BY 1),
    head AS (SELECT conv_id, bool_or(dia) AS dia, bool_or(dia) AND coalesce(bool_and(act) FILTER (role = 'user' AND trim(text) <> ''), false) AS op FROM k GROUP BY 1),
    cl AS (SELECT conv_id, 'tidy ' || trim(min(text)) AS t FROM m WHERE conv_id % 4 > 1 AND role = 'user' GROUP BY 1),
    e1 AS (SELECT head.conv_id, dia, op, CASE WHEN dia THEN coalesce(raw.text, '') ELSE coalesce(cl.t, raw.text, '') END AS text, NOT dia AND cl.t IS NULL AS uncleaned FROM head LEFT JOIN raw USING (conv_id) LEFT JOIN cl USING (conv_id)),
    e2 AS (SELECT *, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) END AS words FROM e1),
    sg AS (SELECT conv_id, CAST(turn % 3 AS INT) AS segment, turn, ['t' || turn % 2] AS themes, CASE WHEN turn % 2 = 0 THEN 'then' END AS era FROM conversations WHERE conv_id % 5 < 2 AND turn % 4 < 3),
    sk AS (SELECT sg.* FROM sg JOIN kept USING (conv_id, turn) WHERE dia),
    tp AS (SELECT conv_id, turn AS idx, text FROM m WHERE conv_id % 5 < 3 AND role = 'user' AND trim(text) <> ''),
    rt AS (SELECT *, CASE WHEN trim(text) = '' OR op THEN 'DISCARD' WHEN words < 30 THEN 'SHORT' WHEN dia AND conv_id IN (SELECT conv_id FROM sk) THEN 'TURNS' WHEN NOT dia AND conv_id IN (SELECT conv_id FROM tp) THEN 'TOPICS' ELSE 'WHOLE' END AS route FROM e2),
    ls AS (SELECT conv_id, max(segment) AS last FROM sk GROUP BY 1), fs AS (SELECT conv_id, turn, min(segment) AS segment FROM sk GROUP BY 1, 2),
    st AS (SELECT kept.conv_id, coalesce(fs.segment, last + 1) AS seg, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS text FROM kept JOIN rt USING (conv_id) JOIN ls USING (conv_id) LEFT JOIN fs USING (conv_id, turn) WHERE route = 'TURNS' GROUP BY 1, 2),
    pc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg, text) AS i, text FROM (SELECT * FROM st UNION ALL SELECT conv_id, idx, text FROM tp WHERE conv_id IN (SELECT conv_id FROM rt WHERE route = 'TOPICS'))),
    cp AS (SELECT conv_id, least(i, 2) AS i, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM pc GROUP BY conv_id, least(i, 2) UNION ALL SELECT conv_id, 1, text FROM rt WHERE route IN ('SHORT', 'WHOLE')),
    ep AS (SELECT cp.*, route, CASE WHEN route = 'SHORT' THEN 'RAW_CAPTURE' WHEN (conv_id + i) % 4 > 0 AND (conv_id * 7 + i * 13) % 10 < 4 THEN 'RAW_CAPTURE' ELSE 'REFLECTION' END AS cls FROM cp JOIN rt USING (conv_id))"""


def _entries(spark, d):
    t = tables.read(spark, d, "conversations")
    v = _c("conv_id")
    messages = t.filter((v % 3 > 0) | (_c("role") != "assistant")).select(v.alias("session_id"), F.lit("2024-01-01").cast("date").alias("event_date"), "turn", "role", "text", F.lit(False).alias("voice"))
    acts = messages.select("session_id", "turn", ((F.char_length("text") % 7 == 0) | (_c("session_id") % 11 == 0)).alias("operational"))
    mine = messages.filter("role = 'user'")
    cleaned = mine.filter("session_id % 4 > 1").groupBy("session_id").agg(F.concat(F.lit("tidy "), F.trim(F.min("text"))).alias("text")).union(mine.filter("session_id % 4 = 1").select("session_id", F.lit(" ").alias("text")))
    segments = t.filter("conv_id % 5 < 2 and turn % 4 < 3").select(v.alias("session_id"), (_c("turn") % 3).cast("int").alias("segment"), "turn", F.array(F.concat(F.lit("t"), _c("turn") % 2)).alias("themes"), F.when(_c("turn") % 2 == 0, "then").alias("era"))
    segments = segments.unionByName(t.filter("conv_id % 5 = 2").select(v.alias("session_id"), F.lit(0).alias("segment"), (_c("turn") + 1000).alias("turn"), F.array().cast("array<string>").alias("themes"), F.lit(None).cast("string").alias("era")))
    topics = mine.filter("session_id % 5 < 3").select("session_id", _c("turn").alias("idx"), "text", F.array(F.lit("a")).alias("themes"), F.lit(None).cast("string").alias("era"))
    scores = messages.select("session_id").distinct().withColumn("episode_index", F.explode(F.array(F.lit(1), F.lit(2)))).filter("(session_id + episode_index) % 4 > 0")
    scores = scores.select("session_id", "episode_index", ((_c("session_id") * 7 + _c("episode_index") * 13) % 10 / 10).alias("coherence"), F.array(F.lit("What else?"), F.concat(F.lit("And "), _c("episode_index"), F.lit("?"))).alias("prompts"))
    return preprocess.preprocess(messages, acts, cleaned, segments, topics, scores, min_words=30, cap=2)


@query(_SQL + """ SELECT conv_id AS session_id, route, CASE WHEN route = 'DISCARD' THEN 'DISCARD' WHEN conv_id IN (SELECT conv_id FROM ep WHERE cls = 'REFLECTION') THEN 'REFLECTION' ELSE 'RAW_CAPTURE' END AS decision,
    words, (SELECT count(*) FROM ep WHERE ep.conv_id = rt.conv_id) AS episodes, uncleaned, route = 'WHOLE' AS unsplit FROM rt""", base=False)
def entry_routes(spark, d):
    """The one route that each conversation takes, and what came of it."""
    return _entries(spark, d)[0]


@query(_SQL + " SELECT conv_id AS session_id, CAST(i AS INT) AS episode_index, CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS total_episodes, cls AS entry_class, left(sha256(text), 32) AS text_hash FROM ep", base=False)
def entry_episodes(spark, d):
    return _entries(spark, d)[1].select("session_id", "episode_index", "total_episodes", "entry_class", "text_hash")


@query(_SQL + """, pr AS (SELECT conv_id, i, unnest(['What else?', 'And ' || i || '?']) AS prompt, unnest([0, 1]) AS pos FROM ep WHERE cls = 'RAW_CAPTURE' AND (conv_id + i) % 4 > 0),
    f1 AS (SELECT conv_id, prompt, min(i * 10 + pos) AS pl FROM pr GROUP BY 1, 2) SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pl) AS INT) AS pos, prompt FROM f1""", base=False)
def entry_prompts(spark, d):
    return _entries(spark, d)[2]


_ASSEMBLED = """, e AS (SELECT episode_id, min(event_date) AS day, row_number() OVER (PARTITION BY min(event_date) ORDER BY min(user_id)) AS idx, min(user_id) % 4 = 0 AS thin, min(user_id) % 3 = 0 AS adopted FROM w GROUP BY 1),
    ob AS (SELECT w.*, idx, day, thin, adopted, w.type = 'refund' AS bad, row_number() OVER (PARTITION BY w.episode_id ORDER BY CASE WHEN w.type = 'refund' THEN 1 ELSE 0 END, event_id) AS n FROM w JOIN e USING (episode_id) WHERE w.type IN ('view', 'error', 'purchase', 'refund')),
    code AS (SELECT episode_id, strftime(day, '%Y_%m_%d') || '_' || lpad(CAST(idx AS VARCHAR), CAST(greatest(2, len(CAST(idx AS VARCHAR))) AS INT), '0') AS c FROM e)"""


def _assembled(spark, d):
    """The week's findings as readings of their episodes: refunds could not be read, clicks are events, signups the steps of one chain."""
    w = _week(spark, d)
    e = w.groupBy("episode_id").agg(F.min("event_date").alias("event_date"), F.min("user_id").alias("u"), F.min("occurred_at").alias("occurred_at"))
    place = F.row_number().over(Window.partitionBy("event_date").orderBy("u"))
    episodes = e.select("episode_id", "event_date", place.alias("episode_index"), F.when(_c("u") % 4 == 0, "RAW_CAPTURE").otherwise("REFLECTION").alias("entry_class"), "occurred_at", F.lit("2024-02-01").cast("timestamp").alias("recorded_at"), F.concat(F.lit("of "), "episode_id").alias("summary"), F.when(_c("u") % 3 == 0, F.array(F.lit("View"), F.lit(" "))).alias("adopted"), F.lit("m").alias("model"))
    row = lambda kinds, *columns: w.filter(_c("type").isin(*kinds)).select("episode_id", _c("event_id").alias("pos"), *columns)
    findings = row(["view", "error", "purchase"], "type", F.concat(F.lit("a "), "type").alias("content"), F.array("pattern_id").alias("evidence"), "signal_strength", F.when(_c("event_id") % 5 == 0, "ASSISTANT").otherwise("USER_GENERATED").alias("provenance"), (_c("event_id") % 2 + 1).alias("attempt"))
    rejected = row(["refund"], F.when(_c("event_id") % 2 == 0, "type").otherwise("").alias("type"), _c("pattern_id").alias("content"), F.lit("UNKNOWN_TYPE").alias("rule"), F.when(_c("event_id") % 3 == 0, "SIGNAL_FLOOR").otherwise("UNKNOWN_TYPE").alias("last_rule"), F.lit(2).alias("attempts"))
    return assembly.assemble(episodes, findings, rejected, row(["click"], _c("pattern_id").alias("summary"), "signal_strength"), row(["signup"], F.lit(1).alias("chain"), F.lit("TRIGGER").alias("kind"), _c("pattern_id").alias("content")))


@query(_ASSEMBLED + """ SELECT 'obs_' || c || '_' || lpad(CAST(n AS VARCHAR), 3, '0') AS node_id, episode_id, CASE WHEN bad THEN 'CONTEXT' ELSE type END AS type, CASE WHEN bad THEN pattern_id ELSE 'a ' || type END AS content,
    CASE WHEN bad THEN 'STANDARD' ELSE signal_strength END AS signal_strength, CASE WHEN bad THEN 'USER_GENERATED' WHEN event_id % 5 = 0 THEN 'ASSISTANT' WHEN adopted AND type = 'view' THEN 'CO_CREATED' ELSE 'USER_GENERATED' END AS provenance,
    CASE WHEN bad THEN 'EXTRACTION_FAILED' WHEN thin THEN 'RAW_CAPTURE' ELSE 'ACTIVE' END AS status, CASE WHEN bad THEN 'extraction failed: UNKNOWN_TYPE;attempted type: ' || CASE WHEN event_id % 2 = 0 THEN 'type' ELSE 'none given' END || CASE WHEN event_id % 3 = 0 THEN ';still wrong after correcting: SIGNAL_FLOOR' ELSE '' END ELSE pattern_id END AS evidence
    FROM ob JOIN code USING (episode_id)""")
def assembled_observations(spark, d):
    """Observation rows with their ids, those that could not be read among them."""
    out = _assembled(spark, d)["observations"]
    return out.select("node_id", "episode_id", "type", "content", "signal_strength", "provenance", "status", F.array_join("raw_evidence", ";").alias("evidence"))


@query(_ASSEMBLED + """ SELECT 'evt_' || c || '_' || lpad(CAST(row_number() OVER (PARTITION BY episode_id ORDER BY event_id) AS VARCHAR), 3, '0') AS node_id, 'EVENT' AS kind, pattern_id AS said FROM w JOIN code USING (episode_id) WHERE type = 'click'
    UNION ALL SELECT 'chain_' || c || '_001', 'CHAIN', CAST(count(*) AS VARCHAR) FROM w JOIN code USING (episode_id) WHERE type = 'signup' GROUP BY c
    UNION ALL SELECT 'step_' || c || '_' || lpad(CAST(row_number() OVER (PARTITION BY episode_id ORDER BY event_id) AS VARCHAR), 3, '0'), 'STEP', 'chain_' || c || '_001' FROM w JOIN code USING (episode_id) WHERE type = 'signup'
    UNION ALL SELECT 'sess_' || c || '_001', 'SESSION', coalesce((SELECT arg_max(signal_strength, CASE signal_strength WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END) FROM w WHERE w.episode_id = code.episode_id AND type IN ('view', 'error', 'purchase')), 'STANDARD') FROM code""")
def assembled_records(spark, d):
    """Events, chains, steps and the session of every episode, with their ids."""
    out = _assembled(spark, d)
    row = lambda name, kind, said: out[name].select("node_id", F.lit(kind).alias("kind"), said.cast("string").alias("said"))
    return row("events", "EVENT", _c("event_summary")).union(row("chains", "CHAIN", _c("step_count"))).union(row("steps", "STEP", _c("chain_id"))).union(row("sessions", "SESSION", _c("signal_strength")))


_STORED = """, rec AS (SELECT node_id, CASE type WHEN 'click' THEN 'EventNode' WHEN 'view' THEN 'PatternNode' WHEN 'error' THEN 'BeliefNode' ELSE 'ObservationNode' END AS label, type, pattern_id, person, event_id, occurred_at FROM f)"""


def _stored(spark, d):
    e = _c("event_id")
    label = F.when(_c("type") == "click", "EventNode").when(_c("type") == "view", "PatternNode").when(_c("type") == "error", "BeliefNode").otherwise("ObservationNode")
    held = {"content": F.when(e % 3 == 0, " ").otherwise(F.concat(F.lit(" c "), "type")), "event_summary": F.when(e % 2 == 0, _c("person")), "pattern_name": F.when(e % 5 > 0, "").otherwise(_c("pattern_id")), "pattern_description": F.when(e % 2 == 0, _c("type")), "valid_from": F.when(e % 7 == 0, "soon").otherwise(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "era_tag": F.when(e % 4 == 0, "then")}
    return _found(spark, d).select("node_id", label.alias("label"), F.create_map(*[x for k, v in held.items() for x in (F.lit(k), v)]).alias("fields"))


@query(_STORED + """ SELECT node_id, coalesce(CASE label WHEN 'EventNode' THEN CASE WHEN event_id % 2 = 0 THEN person END WHEN 'PatternNode' THEN CASE WHEN event_id % 5 = 0 THEN pattern_id WHEN event_id % 2 = 0 THEN type END WHEN 'ObservationNode' THEN CASE WHEN event_id % 3 > 0 THEN 'c ' || type END END,
    CASE WHEN event_id % 3 > 0 THEN 'c ' || type END, CASE WHEN event_id % 5 = 0 THEN pattern_id END, CASE WHEN event_id % 2 = 0 THEN person END, '') AS said FROM rec""")
def card_previews(spark, d):
    """The words that a card shows of each record, by its kind."""
    return _stored(spark, d).select("node_id", assembly.card_preview(_c("label"), _c("fields")).alias("said"))


@query(_STORED + """ SELECT node_id, label AS node_type, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE ' c ' || type END AS preview, CASE WHEN event_id % 7 > 0 THEN date_trunc('second', occurred_at) END AS valid_from, CASE WHEN event_id % 4 = 0 THEN 'then' END AS era_tag FROM rec WHERE event_id IN (SELECT (event_id * 3) % 900 FROM w)""")
def candidate_history(spark, d):
    """The records that the week's findings were compared with, read back once each."""
    found = _week(spark, d).select(_c("event_id").alias("item_id"), F.concat(F.lit("obs_"), _c("event_id") * 3 % 900).alias("node_id"))
    return assembly.candidate_history(found, _stored(spark, d)).select("node_id", "node_type", "preview", _c("valid_from").cast("timestamp_ntz").alias("valid_from"), "era_tag")
