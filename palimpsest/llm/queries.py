"""One query per operator over the whole tables of a data directory, and the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chat_format import link_tool_calls
from palimpsest.llm.common import table
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.exact_dedup import exact_dedup
from palimpsest.llm.fill_middle import fill_middle
from palimpsest.llm.filter_audit import filter_audit
from palimpsest.llm.license_scan import PHRASES, TEMPLATES, license_scan
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.quality_pu import quality
from palimpsest.llm.simhash_dedup import hex16, simhash_dedup
from palimpsest.llm.substring_dedup import substring_dedup
from palimpsest.llm.toxicity_nb import toxicity
from palimpsest.llm.url_filter import host_of, url_filter


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, capacity=4096, digest=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


_TOOLS = [
    ("search", '{"type":"object","properties":{"query":{"type":"string","minLength":1},"thread":{"type":"object"},"turn":{"type":"integer","minimum":0}},"required":["query","turn"],"additionalProperties":false}'),
    ("configure", '{"type":"object","properties":{"instructions":{"type":"string","maxLength":200}},"required":["instructions"],"additionalProperties":false}'),
]


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as tool traffic: a user or system turn calls a tool, an assistant's turn answers the turn before."""
    turns = table(spark, sf_dir, "conversations")
    call_id = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    thread = F.when(F.col("turn") > 0, F.struct(call_id(F.lit(0)).alias("$ref")))
    search = F.to_json(F.struct(F.col("text").alias("query"), "turn", thread.alias("thread")))
    configure = F.to_json(F.struct(F.col("text").alias("instructions")))
    is_system = F.col("role") == "system"
    calls = turns.filter("role in ('user', 'system')").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.when(is_system, "configure").otherwise("search").alias("name"), F.when(is_system, configure).otherwise(search).alias("arguments")
    )
    results = turns.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    linked = link_tool_calls(calls, results, spark.createDataFrame(_TOOLS, "name string, parameters string"))
    return linked.withColumn("errors", F.array_join("errors", "; "))


#: Dated entries besides those that op7 derives from the pages.
_ENTRIES = [
    ("spam", "spam-farm.example.org", "2024-01-15", "add"),
    ("spam", "cheap-pills.example.com", "2024-02-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-11-01", "remove"),
    ("domains", "example.org", "2024-03-01", "add"),
    ("domains", "example.org", "2024-06-01", "remove"),
    ("domains", "example.org", "2024-09-15", "add"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures of 2024, one list entry or two of every host, and a few fixed ones."""
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_add("MINUTE", (F.col("page_id") * 97 % 525600).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("fetched_at"))
    hosts = captures.groupBy(host_of(F.col("url")).alias("pattern")).agg(F.min("page_id").alias("low"))
    first = (F.col("low") * 7 % 300).cast("int")
    added = hosts.select(F.lit("watch").alias("list_name"), "pattern", day(first).alias("at"), F.lit("add").alias("action"))
    removed = hosts.filter("low % 3 = 0").select(F.lit("watch").alias("list_name"), "pattern", day(first + 45).alias("at"), F.lit("remove").alias("action"))
    fixed = spark.createDataFrame(_ENTRIES, "list_name string, pattern string, at string, action string").withColumn("at", F.col("at").cast("timestamp"))
    found = url_filter(captures, added.union(removed).unionByName(fixed))
    return found.select("page_id", "host", F.array_join("lists", ",").alias("lists"), "blocked")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", hex16(F.col("f0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5, keep="largest")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle(table(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return found.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_pu": op1_quality_pu,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_decontamination": op3_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_tool_call_linking": op6_tool_call_linking,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity_nb": op8_toxicity_nb,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_fill_middle": op13_fill_middle,
}

#: Words as the contracts name them, in DuckDB.
_WORD_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents),
        b AS (SELECT item_id, {_WORD_SQL} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS s
                FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        pos AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s
                FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(i)),
        hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win USING (n, s)),
        words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS t(j) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op5_license_scan": f"""
        WITH d AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents),
        phrase(p, label) AS (VALUES {_values(PHRASES)}),
        template AS (SELECT list_distinct(string_split(p, ' ')) AS tokens, greatest(32, 2 * len(string_split(p, ' '))) AS size, label FROM (VALUES {_values(TEMPLATES)}) AS t(p, label)),
        place AS (SELECT doc_id, i - 1 AS pos, label FROM d, unnest(range(1, len(w) + 1)) AS t(i), phrase
                  WHERE w[i] = string_split(p, ' ')[1] AND array_to_string(w[i:i + len(string_split(p, ' ')) - 1], ' ') = p),
        near AS (SELECT doc_id, w, tokens, size, label FROM d, template WHERE len(list_intersect(tokens, w)) >= ceil(0.85 * len(tokens) - 1e-9)),
        block AS (SELECT doc_id, label, tokens, list_distinct(w[i:i + size - 1]) AS b FROM near, unnest(range(1, len(w) + 1)) AS t(i) WHERE list_contains(tokens, w[i])),
        hit AS (SELECT doc_id, label, len(list_intersect(tokens, b)) / len(tokens) AS share FROM block
                WHERE len(list_intersect(tokens, b)) >= ceil(0.85 * len(tokens) - 1e-9)),
        base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM place GROUP BY 1),
        best AS (SELECT doc_id, max(share) AS share FROM hit GROUP BY 1),
        every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names
                  FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM hit) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
               coalesce(base.names, '') AS base_labels, coalesce(every.names, '') AS labels,
               CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id)""",
    "op6_tool_call_linking": """
        WITH c AS (SELECT conv_id, conv_id || '-' || turn AS call_id, turn, text, role = 'system' AS sys FROM conversations WHERE role IN ('user', 'system')),
        r AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM conversations WHERE role = 'assistant'),
        j AS (SELECT c.*, r.result_turn, r.content, r.call_id IS NOT NULL AS linked,
                     turn > 0 AND NOT sys AND conv_id || '-0' IN (SELECT call_id FROM c) AS refers
              FROM c LEFT JOIN r USING (conv_id, call_id)),
        v AS (SELECT *, CASE WHEN sys AND length(text) > 200 THEN '$.instructions: length out of bounds'
                             WHEN NOT sys AND length(text) < 1 THEN '$.query: length out of bounds' ELSE '' END AS errors FROM j)
        SELECT conv_id, call_id, turn, CASE WHEN sys THEN 'configure' ELSE 'search' END AS name, 'call' AS kind,
               CASE WHEN refers THEN 1 ELSE 0 END AS level, errors = '' AS valid, errors, result_turn,
               '{"arguments":' || CASE WHEN sys THEN '{"instructions":' || to_json(text) || '}'
                   ELSE '{"query":' || to_json(text) || CASE WHEN turn > 0 THEN ',"thread":{"$ref":"' || conv_id || '-0"}' ELSE '' END || ',"turn":' || turn || '}' END
               || ',"id":"' || call_id || '","name":"' || CASE WHEN sys THEN 'configure' ELSE 'search' END || '"'
               || CASE WHEN linked THEN ',"result":' || to_json(content) ELSE '' END || ',"type":"tool_call"}' AS json
        FROM v
        UNION ALL
        SELECT conv_id, call_id, result_turn, NULL, 'result', NULL, false, 'no such call', result_turn,
               '{"id":"' || call_id || '","result":' || to_json(content) || ',"type":"tool_result"}'
        FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)""",
    "op7_url_filter": f"""
        WITH p AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1), '\\.+$', ''), '') AS host,
                          TIMESTAMP '2024-01-01' + to_minutes(page_id * 97 % 525600) AS fetched_at FROM pages),
        h AS (SELECT host, min(page_id) AS low FROM p GROUP BY 1),
        e AS (SELECT 'watch' AS list_name, host AS pattern, TIMESTAMP '2024-01-01' + to_days(CAST(low * 7 % 300 AS INT)) AS moment, 'add' AS action FROM h
              UNION ALL SELECT 'watch', host, TIMESTAMP '2024-01-01' + to_days(CAST(low * 7 % 300 + 45 AS INT)), 'remove' FROM h WHERE low % 3 = 0
              UNION ALL SELECT a, b, CAST(c AS TIMESTAMP), d FROM (VALUES {_values(_ENTRIES)}) AS t(a, b, c, d)),
        i AS (SELECT *, lead(moment) OVER (PARTITION BY list_name, pattern ORDER BY moment) AS until FROM e),
        m AS (SELECT page_id, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM p JOIN i
              ON (host = pattern OR ends_with(host, '.' || pattern)) AND action = 'add' AND moment <= fetched_at AND (until IS NULL OR fetched_at < until) GROUP BY 1)
        SELECT page_id, host, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked FROM p LEFT JOIN m USING (page_id)""",
    "op11_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        f AS (SELECT doc_id, part,
                     CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                     || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
        m AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY 1),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY 1, 2),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS ord FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT ord, step, ord[step] AS x, CASE WHEN step = 1 THEN '^$' ELSE '[' || ord[1:step - 1] || ']' END AS before FROM o, unnest(range(1, 6)) AS t(step)),
        r AS (SELECT part, ord, step, x, contains(fails, x) AS bad, step > 1 AND regexp_matches(fails, before) AS gone, fails = x AS sole, n, good, toxic FROM c, s),
        a AS (SELECT part, ord AS filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed,
                     coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM a""",
    "op12_line_dedup": """
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM t, unnest(range(1, len(lines) + 1)) AS u(i)),
        h AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT doc_id, i, line, holder IS NOT NULL AND doc_id <> holder AS gone FROM l LEFT JOIN h USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1""",
    "op13_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS s FROM documents),
        h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS y,
                     ('0x' || s[17:24])::BIGINT % 100 AS r, ('0x' || s[25:32])::BIGINT % 100 AS o FROM d),
        p AS (SELECT doc_id, text, n, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(u[greatest(x, y) + 1:], '') AS c,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
}
