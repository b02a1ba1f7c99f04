"""Graph reads: expansion, neighbourhoods, version chains, threads and semi-joins.

Frontiers are DataFrames joined with the edges; nothing is walked on the driver.
A walk runs once for each hop asked for, so its plan is bounded by the depth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.temporal import edge_live
from palimpsest.operators.components import connected_components
from palimpsest.sources.scratch import cut, shared_folder

_TRIPLE = ["edge_type", "from_id", "to_id"]


def live_edges(edges: DataFrame, as_of: str | Column | None = None, include_invalidated: bool = False, types: list[str] | None = None) -> DataFrame:
    kept = edges.filter(edge_live(F.col("invalidated_at"), as_of, include_invalidated))
    return kept.filter(F.col("edge_type").isin(*types)) if types else kept


def expand(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Edges one hop from some ids, each once for a direction.

    Under `both`, an edge between two of the ids comes in either direction.
    """
    ids = ids.select("node_id").distinct()
    out = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").dropDuplicates(_TRIPLE).withColumn("direction", F.lit("out"))
    into = edges.join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi").dropDuplicates(_TRIPLE).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", limit: int | None = None) -> tuple[DataFrame, bool]:
    """(node_id, hop) of all that can be reached in at most `depth` hops, with the fewest (the start has 0), and whether the limit ended the walk.

    Each hop's frontier is written before the next one reads it, so the plan grows
    with the depth only and the edges are read twice for each hop. With a limit the
    walk ends as soon as that many nodes are seen, also when there are no more; the
    nearest are kept, then the smaller ids, and the start always.
    """
    seen = frontier = cut(start.select("node_id").distinct().withColumn("hop", F.lit(0)))
    n = first = seen.count() if limit is not None else 0
    for hop in range(1, depth + 1):
        if limit is not None and n >= limit:
            break
        found = expand(edges, frontier, direction)
        ends = found.select(F.when(F.col("direction") == "out", F.col("to_id")).otherwise(F.col("from_id")).alias("node_id")).distinct()
        frontier = cut(ends.join(seen, "node_id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
        if limit is not None:
            n += frontier.count()
    if limit is None or n < limit:
        return seen, False
    return seen.orderBy("hop", "node_id").limit(max(limit, first)), True


def drop_after(nodes: DataFrame, edges: DataFrame, as_of: str, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A slice as of a time: no newer nodes (but the start and undated ones), no edges that lost an end."""
    kept = nodes.join(keep.select("node_id").withColumn("_keep", F.lit(True)), "node_id", "left")
    kept = kept.filter(F.col("_keep").isNotNull() | F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(as_of).cast("timestamp"))).drop("_keep")
    ids = kept.select("node_id")
    left = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return kept, left


#: Steps that version_chain() looks up one by one, and versions that it may hold meanwhile.
_STEPS, _HELD = 32, 10_000


def version_chain(spark: SparkSession, versions: DataFrame, node_id: str) -> DataFrame:
    """All versions of a record, back and forward from one of them, however many; cycles end.

    The versions are written once. The first steps on either side are each a scan of
    two columns for the few ids that the step before found, and nothing is shuffled.
    A chain that isn't at its end by then is found as a connected component of the
    links between versions that both stand in the table, in rounds that are the
    logarithm of the longest chain.
    """
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    versions.write.parquet(path)
    versions = spark.read.schema(versions.schema).parquet(path)
    links = versions.select(F.col("node_id").alias("src"), F.col("previous_version_id").alias("dst"))
    held, asked, seen = set(), {node_id}, {node_id}
    for _ in range(_STEPS):
        some = list(asked)
        met = links.filter(F.col("src").isin(some) | F.col("dst").isin(some)).limit(_HELD + 1).distinct().collect()
        if len(held) + len(met) > _HELD:
            break
        there = {r.src for r in met} & asked  # the others are named by a pointer only, and lead nowhere
        held |= there
        ends = {r.src for r in met if r.dst in there} | {r.dst for r in met if r.src in there and r.dst is not None}
        asked = ends - seen
        seen |= asked
        if not asked:
            return versions.filter(F.col("node_id").isin(list(held))).distinct()
    found = connected_components(links.join(versions.select(F.col("node_id").alias("dst")), "dst", "left_semi"))
    same = found.join(found.filter(F.col("node") == node_id).select("component"), "component", "left_semi").select(F.col("node").alias("node_id"))
    own = spark.createDataFrame([(node_id,)], "node_id string")
    return versions.join(same.union(own), "node_id", "left_semi").distinct()


def all_chains(versions: DataFrame) -> DataFrame:
    """(node_id, root, steps): every version (node_id, previous_version_id) with the first of its chain and its distance from it.

    A version that points at itself or at none in the table is a first one. In a
    longer cycle, and behind one, there is no first: root and steps are null. Each
    round doubles the step of the rows that haven't come to a first one yet, so
    the rounds are the logarithm of the longest chain; only those rows go on.
    """
    links = versions.select("node_id", F.col("previous_version_id").alias("up")).filter("up <> node_id")
    known = versions.select(F.col("node_id").alias("up"))
    going = cut(links.join(known, "up", "left_semi").select("node_id", "up", F.lit(1).cast("long").alias("steps")).distinct())
    done = cut(versions.select("node_id").distinct().join(going, "node_id", "left_anti").select("node_id", F.col("node_id").alias("root"), F.lit(0).cast("long").alias("steps")))
    most = going.count()
    left, longest = most, 1
    while left and longest <= most:  # without a cycle no path has more steps than there are links
        ends = done.select(F.col("node_id").alias("up"), "root", F.col("steps").alias("more"))
        far = going.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("further"))
        met = cut(going.join(ends, "up", "left").join(far, "up", "left"))
        done = done.unionByName(met.filter("root is not null").select("node_id", "root", (F.col("steps") + F.col("more")).alias("steps")))
        going = met.filter("root is null").select("node_id", F.col("up2").alias("up"), (F.col("steps") + F.col("further")).alias("steps"))
        left, longest = going.count(), 2 * longest
    return done.unionByName(going.select("node_id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("steps")))


def thread(messages: DataFrame, leaf: DataFrame) -> DataFrame:
    """The active thread of each conversation (leaf: conv_id, turn): messages from the root to the leaf by their parents.

    messages: conv_id, turn, parent. Where a parent is missing all messages of the
    conversation are the thread. Parents stand before their children, so the path
    is a fold over a conversation's messages in reverse order.
    """
    m = F.array_sort(F.collect_list(F.struct("turn", "parent")))
    by_conv = messages.groupBy("conv_id").agg(m.alias("m")).join(leaf.select("conv_id", F.col("turn").alias("leaf")), "conv_id")
    start = F.struct(F.col("leaf").cast("long").alias("want"), F.array().cast("array<bigint>").alias("path"))
    step = lambda s, x: F.when(x["turn"] == s["want"], F.struct(x["parent"].cast("long").alias("want"), F.array_prepend(s["path"], x["turn"].cast("long")).alias("path"))).otherwise(s)
    walked = by_conv.withColumn("w", F.aggregate(F.reverse("m"), start, step))
    path = F.when(F.col("w.want").isNull(), F.col("w.path")).otherwise(F.transform("m", lambda x: x["turn"].cast("long")))
    return walked.select("conv_id", F.posexplode(path).alias("pos", "turn"))


def linked_to_person(findings: DataFrame, mentions: DataFrame, person: str) -> DataFrame:
    """Findings that mention a person; whether the mention was withdrawn isn't asked."""
    return findings.join(mentions.filter((F.col("edge_type") == "mentions_person") & (F.col("to_id") == person)).select(F.col("from_id").alias("node_id")), "node_id", "left_semi")


def through_a_finding(standing: DataFrame, edges: DataFrame, person: str, edge_type: str, key: str) -> DataFrame:
    """Standing records that a live edge joins with some finding that mentions a person."""
    about = edges.filter((F.col("edge_type") == "mentions_person") & (F.col("to_id") == person)).select("from_id")
    live = live_edges(edges, types=[edge_type]).join(about, "from_id", "left_semi").select(F.col("to_id").alias(key))
    return standing.join(live, key, "left_semi")


def unresolved(findings: DataFrame, edges: DataFrame, pending: DataFrame, types: list[str]) -> DataFrame:
    """Weighty findings of some types inside episodes whose review is pending."""
    held = edges.filter("edge_type = 'contains_obs'").join(pending.select(F.col("episode_id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("node_id"))
    return findings.filter(F.col("type").isin(*types)).join(held, "node_id", "left_semi")


def standing_edges(edges: DataFrame, ids: DataFrame, names: list[str] | None = None, include_invalidated: bool = False) -> DataFrame:
    """All live outbound edges of some ids, in one join."""
    return live_edges(edges, include_invalidated=include_invalidated, types=names).join(ids.select(F.col("node_id").alias("from_id")).distinct(), "from_id", "left_semi").dropDuplicates(_TRIPLE)


def erasure_targets(edges: DataFrame, entry_episodes: DataFrame) -> DataFrame:
    """Ids that an erasure of entries reaches: the episodes and what they contain, two steps deep."""
    episodes = entry_episodes.select("node_id").distinct()
    inside = edges.filter(F.col("edge_type").startswith("contains"))
    first = inside.join(episodes.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("node_id"))
    second = inside.join(first.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("node_id"))
    return episodes.union(first).union(second).distinct()
