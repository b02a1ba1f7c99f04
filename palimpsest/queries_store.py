"""More of the catalogue: reads over layouts that Spark writes first, which open few files or move few rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import adjacency, vector_index
from palimpsest.plans import ingest
from palimpsest.queries import _COS, _found, query
from palimpsest.sources import chat_export, keyed, sinks, tables
from palimpsest.sources.scratch import shared_folder

_c = F.col


def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _index(spark, d, **options):
    return vector_index.build(tables.vectors(spark, d), _new(spark, "index"), cells=24, **options)


def _asked(spark, d):
    return tables.vectors(spark, d).filter("vec_id % 20 = 0")


_NEAREST = f"""WITH s AS (SELECT b.vec_id AS query_id, 'vec_' || a.vec_id AS node_id, {_COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM s WHERE s > 0)"""


@query(_NEAREST + " SELECT query_id, node_id, rank FROM r WHERE rank <= 10", base=False)
def indexed_topk(spark, d):
    """The ten nearest of every twentieth vector, from the index by its exact way."""
    asked = _asked(spark, d).select(_c("vec_id").alias("query_id"), "embedding")
    return vector_index.search(_index(spark, d, asks=0), asked, 10, probes=6, exact=True).select("query_id", "node_id", "rank")


@query("SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 20 = 0", base=False)
def index_recall(spark, d):
    """Whether the cells that the index probes by itself hold nine in ten of the ten nearest, and for how many queries."""
    index = _index(spark, d)
    asked = _asked(spark, d).select(_c("vec_id").alias("query_id"), "embedding")
    want = vector_index.search(index, asked, 10, exact=True).select("query_id", "node_id")
    found = vector_index.search(index, asked, 10).select("query_id", "node_id", F.lit(1).alias("hit"))
    share = F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count(F.lit(1))
    return want.join(found, ["query_id", "node_id"], "left").agg(F.count_distinct("query_id").alias("asked"), share.alias("enough"))


@query(f"""WITH n AS (SELECT vec_id, 'vec_' || vec_id AS node_id, 'ep_' || label AS episode_id, label, embedding FROM embeddings),
    s AS (SELECT 'vec_' || b.vec_id AS target_id, 'vec_' || a.vec_id AS node_id, {_COS} AS s, 'ep_' || a.label AS its, 'ep_' || b.label AS own, a.vec_id AS v FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC, node_id) AS k FROM s WHERE s > 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s * CASE v % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 1.0 END DESC, node_id) AS pos FROM f WHERE k <= 20 AND v % 11 > 0 AND its <> own),
    an AS (SELECT 'ep_' || ((label + 1) % 10) AS episode_id, node_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM n WHERE vec_id % 13 = 0),
    two AS (SELECT 'vec_' || e.vec_id AS target_id, an.node_id, 'STRUCTURAL' AS source, pos FROM embeddings e JOIN an ON an.episode_id = 'ep_' || e.label WHERE e.vec_id % 20 = 0 AND pos <= 8
             UNION ALL SELECT target_id, node_id, 'SEMANTIC', pos FROM u WHERE pos <= 5 AND NOT EXISTS (SELECT 1 FROM an WHERE an.episode_id = u.own AND an.node_id = u.node_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY source = 'SEMANTIC', pos) AS place FROM two)
    SELECT target_id, node_id, source, place FROM p WHERE place <= 8""", base=False)
def ingest_candidates(spark, d):
    """Every twentieth vector as a finding of an episode (its label); records are the vectors, those divisible by 11 not live; anchors reach into the next episode."""
    v = tables.vectors(spark, d).withColumn("episode_id", F.concat(F.lit("ep_"), "kind"))
    signal = F.when(_c("vec_id") % 3 == 0, "CRITICAL").when(_c("vec_id") % 3 == 1, "HIGH").otherwise("STANDARD")
    records = v.filter("vec_id % 11 > 0").select("node_id", "episode_id", signal.alias("signal_strength"))
    anchors = v.filter("vec_id % 13 = 0").select(F.concat(F.lit("ep_"), (_c("kind") + 1) % 10).alias("episode_id"), "node_id", _c("vec_id").alias("pos"))
    targets = v.filter("vec_id % 20 = 0").select(_c("node_id").alias("target_id"), "episode_id", "embedding")
    return ingest.candidates(_index(spark, d, asks=0), targets, records, anchors, exact=True).select("target_id", "node_id", "source", "place")


def _lists(spark, d):
    return adjacency.build(tables.edges(_found(spark, d)), _new(spark, "lists"), buckets=8, at_most=2_000)


@query(""", live AS (SELECT from_id AS a, to_id AS b FROM g WHERE invalidated_at IS NULL UNION SELECT to_id, from_id FROM g WHERE invalidated_at IS NULL),
    h1 AS (SELECT b FROM live WHERE a = 'obs_11'), h2 AS (SELECT b FROM live WHERE a IN (SELECT b FROM h1)), h3 AS (SELECT b FROM live WHERE a IN (SELECT b FROM h2)),
    every AS (SELECT node_id, min(hop) AS hop FROM (SELECT 'obs_11' AS node_id, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2 UNION ALL SELECT b, 3 FROM h3) GROUP BY 1)
    SELECT node_id, hop, (SELECT count(*) FROM every) >= 60 AS truncated FROM every ORDER BY hop, node_id LIMIT 60""")
def khop_limited(spark, d):
    """Three hops from a finding over adjacency lists, until sixty nodes are seen."""
    nodes, _, truncated = adjacency.neighbourhood(_lists(spark, d), spark.createDataFrame([("obs_11",)], "node_id string"), 3, limit=60)
    return nodes.withColumn("truncated", F.lit(truncated))


@query(""", live AS (SELECT DISTINCT edge_type, from_id, to_id FROM g WHERE invalidated_at IS NULL), h AS (SELECT 'obs_11' AS n UNION SELECT to_id FROM live WHERE from_id = 'obs_11' UNION SELECT from_id FROM live WHERE to_id = 'obs_11')
    SELECT edge_type, from_id, to_id FROM live WHERE from_id = 'obs_11' OR to_id = 'obs_11'""")
def slice_edges(spark, d):
    """The edges that one hop walks."""
    _, edges, _ = adjacency.neighbourhood(_lists(spark, d), spark.createDataFrame([("obs_11",)], "node_id string"), 1)
    return edges.select("edge_type", "from_id", "to_id")


@query(", live AS (SELECT DISTINCT edge_type, from_id, to_id FROM g WHERE invalidated_at IS NULL OR invalidated_at > TIMESTAMP '2024-01-20') SELECT edge_type, count(*) AS n FROM live WHERE edge_type IN ('mentions_person', 'reinforces_obs_pat') AND from_id IN (SELECT node_id FROM f WHERE type = 'error') GROUP BY 1")
def hops_in_buckets(spark, d):
    """Outbound edges of two kinds of all errors: their names go to the buckets, the edges stay."""
    ids = _found(spark, d).filter("type = 'error'").select("node_id")
    found = adjacency.expand(_lists(spark, d), ids, "out", as_of="2024-01-20", types=["mentions_person", "reinforces_obs_pat"], few=20)
    return found.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(""", start AS (SELECT chain FROM v WHERE node_id = 'bel_100') SELECT node_id, previous_version_id, version FROM v JOIN start USING (chain)""")
def version_chain_lists(spark, d):
    """The versions of one record, looked up step by step."""
    v = tables.versions(spark, d)
    lists = adjacency.build(adjacency.version_links(v), _new(spark, "lists"), buckets=8)
    return adjacency.version_chain(lists, v, "bel_100").select("node_id", "previous_version_id", "version")


def _keyed(spark, d):
    return keyed.write(_found(spark, d).select("node_id", "type", "event_date"), _new(spark, "records"), rows=5_000)


@query(" SELECT node_id, type, event_date, CAST(pos AS INT) AS pos FROM f JOIN (SELECT 'obs_' || (i * 37 % 1000) AS node_id, i AS pos FROM range(0, 30) r(i)) USING (node_id)")
def records_by_key(spark, d):
    ids = spark.range(30).select(F.concat(F.lit("obs_"), _c("id") * 37 % 1000).alias("node_id"), _c("id").cast("int").alias("pos"))
    return keyed.by_ids(_keyed(spark, d), ids)


@query(" SELECT node_id, type FROM f WHERE node_id > 'obs_500' ORDER BY node_id LIMIT 200")
def keyset_pages(spark, d):
    """Two pages, the second from where the first ends."""
    table = _keyed(spark, d)
    first = keyed.after(table, spark, "obs_500", 100)
    last = first.agg(F.max("node_id")).first()[0]
    return first.unionByName(keyed.after(table, spark, last, 100)).select("node_id", "type") if last else first.select("node_id", "type")


@query("SELECT CAST(count(*) AS BIGINT) AS copied, CAST(0 AS BIGINT) AS nameless, CAST(8 AS BIGINT) AS pages FROM embeddings", base=False)
def migrated_vectors(spark, d):
    """All vectors copied to a new place, page by page, each counted."""
    v = tables.vectors(spark, d)
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    pages = sinks.migrate(v.select("node_id", "embedding"), _new(spark, "collection"), width)
    return pages.agg(F.coalesce(F.sum("copied"), F.lit(0)).alias("copied"), F.coalesce(F.sum("nameless"), F.lit(0)).alias("nameless"), F.count(F.lit(1)).alias("pages"))


@query("""WITH m AS (SELECT conv_id, count(*) FILTER (role <> 'system' AND trim(text) <> '') AS readable, count(*) FILTER (role = 'user' AND conv_id % 5 <> 3 AND trim(text) <> '') AS own FROM conversations GROUP BY 1)
    SELECT conv_id || '.json' AS filename, CASE WHEN conv_id % 10 > 2 THEN 0 END AS position, CASE WHEN conv_id % 10 = 0 THEN 'NOT_JSON' WHEN conv_id % 10 < 3 THEN 'NO_CONVERSATIONS' WHEN conv_id % 10 = 4 THEN 'NOT_AN_OBJECT' WHEN conv_id % 10 = 5 THEN 'NO_MESSAGES' WHEN conv_id % 10 = 6 OR readable = 0 THEN 'NOTHING_READABLE' ELSE 'NOTHING_OWN' END AS reason
    FROM m WHERE conv_id % 10 IN (0, 1, 2, 4, 5, 6) OR readable = 0 OR own = 0""", base=False)
def chat_rejections(spark, d):
    """The conversations as export files, some of them broken in every way: what can't be taken in, and why."""
    t, c = tables.read(spark, d, "conversations"), _c("conv_id")
    role = F.when(c % 10 == 6, "stranger").when((c % 5 == 3) & (_c("role") == "user"), "bot").otherwise(_c("role"))
    said = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), _c("text").alias("content"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))))
    files = t.groupBy("conv_id").agg(said.alias("messages"))
    whole = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "messages"))
    body = F.when(c % 10 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(c % 10 == 1, "[]").when(c % 10 == 2, "7").when(c % 10 == 4, F.concat(F.lit('["text", '), whole, F.lit("]"))).when(c % 10 == 5, '{"id": "x", "messages": []}').otherwise(F.concat(F.lit('{"chats": ['), whole, F.lit("]}")))
    return chat_export.refused(files.select(F.concat(c.cast("string"), F.lit(".json")).alias("filename"), body.alias("body"))).filter("position is null or position = 0")
