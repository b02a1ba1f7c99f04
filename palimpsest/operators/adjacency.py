"""Adjacency lists: edges laid out by either end, so that a hop reads lists and doesn't move edges."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.graph import live_edges
from palimpsest.sources.scratch import cut

#: Edges of a list; a node with more has several, which lie in different buckets.
LIST = 100_000
#: Nodes whose lists are read by name; more of them meet the lists by a join in buckets.
FEW = 1_000
_TRIPLE = ["edge_type", "from_id", "to_id"]


@dataclass(frozen=True)
class Adjacency:
    """Tables of edges in buckets of their from_id and of their to_id, and of the nodes with several lists."""

    out: str
    into: str
    path: str

    def lists(self, spark: SparkSession, direction: str) -> DataFrame:
        return spark.table(self.out if direction == "out" else self.into)

    def hubs(self, spark: SparkSession, direction: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/hubs_{direction}")


def _list_name(node: Column, part: Column) -> Column:
    """The node's own name for its first list, and one with a number for the others."""
    return F.when(part == 0, node).otherwise(F.concat(node, F.lit("\x01"), part.cast("string")))


def build(edges: DataFrame, path: str, buckets: int = 32, at_most: int = LIST) -> Adjacency:
    """Write the edges (edge_type, from_id, to_id and any others) twice, in so many buckets, sorted by the list they are in.

    A node with more than `at_most` edges in a direction has several lists, to
    which they are dealt by the other end; its edges lie in several buckets, so
    no task reads a hub whole. Edges without an end are in no list of that end.
    """
    spark, name = edges.sparkSession, uuid.uuid4().hex
    made = Adjacency(f"lists_out_{name}", f"lists_in_{name}", path)
    for direction, table, end, other in (("out", made.out, "from_id", "to_id"), ("in", made.into, "to_id", "from_id")):
        rows = edges.filter(F.col(end).isNotNull())
        counted = rows.groupBy(F.col(end).alias("node_id")).count().filter(F.col("count") > at_most)
        counted.select("node_id", F.ceil(F.col("count") / at_most).cast("int").alias("lists")).write.parquet(f"{path}/hubs_{direction}")
        hubs = spark.read.parquet(f"{path}/hubs_{direction}")
        dealt = rows.join(hubs.withColumnRenamed("node_id", end), end, "left").withColumn("part", F.pmod(F.xxhash64(other, "edge_type"), F.coalesce("lists", F.lit(1))))
        dealt = dealt.withColumn("list", _list_name(F.col(end), F.col("part"))).drop("part", "lists")
        dealt.repartition(buckets, "list").write.bucketBy(buckets, "list").sortBy("list").option("path", f"{path}/{direction}").saveAsTable(table)
    return made


def drop(spark: SparkSession, lists: Adjacency) -> None:
    """Forget the tables; the files are the folder's to clear."""
    for table in (lists.out, lists.into):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def step(lists: Adjacency, ids: DataFrame, direction: str, few: int = FEW) -> DataFrame:
    """The edges of some nodes (node_id) in one direction, all their columns and `direction`; each triple once.

    A few nodes are looked up by name: only the buckets that their lists hash to
    are opened, and in them the row groups that can hold them. For more the names
    are shuffled to the buckets; the edges stay where they lie.
    """
    spark = ids.sparkSession
    names = ids.select("node_id").filter("node_id is not null").distinct().join(lists.hubs(spark, direction), "node_id", "left")
    names = names.select(F.explode(F.sequence(F.lit(0), F.coalesce("lists", F.lit(1)) - 1)).alias("part"), "node_id").select(_list_name(F.col("node_id"), F.col("part")).alias("list"))
    stored = lists.lists(spark, direction)
    known = names.limit(few + 1).collect()
    if len(known) <= few:
        found = stored.filter(F.col("list").isin([r.list for r in known]))
    else:
        found = stored.join(names.hint("merge"), "list")
    # Edges of one triple lie in one list, in a table that is dealt by lists.
    return found.dropDuplicates(["list", *_TRIPLE]).drop("list").withColumn("direction", F.lit(direction))


def expand(lists: Adjacency, ids: DataFrame, direction: str = "both", as_of: str | None = None, include_invalidated: bool = False, types: list[str] | None = None, few: int = FEW) -> DataFrame:
    """Live edges one hop from some nodes; under `both` an edge between two of them comes in either direction."""
    ways = ("out", "in") if direction == "both" else (direction,)
    found = [live_edges(step(lists, ids, way, few), as_of, include_invalidated, types) for way in ways]
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0]


def neighbourhood(lists: Adjacency, start: DataFrame, depth: int | None, direction: str = "both", limit: int | None = None, few: int = FEW, **live) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (node_id, hop) within `depth` hops, the edges between them that were walked, and whether the limit ended the walk.

    As graph.neighbourhood(), over lists: the nearest nodes are kept, then the
    smaller ids, the start always, and the walk ends as soon as `limit` nodes are
    seen, also when there are no more. Each hop's edges are written once, and both
    its nodes and the slice's edges come from what was written. Without a depth the
    walk goes on until it finds nothing new.
    """
    seen = frontier = cut(start.select("node_id").distinct().withColumn("hop", F.lit(0)))
    n = first = seen.count() if limit is not None else 0
    walked: DataFrame | None = None
    for hop in count(1) if depth is None else range(1, depth + 1):
        if (limit is not None and n >= limit) or (depth is None and frontier.isEmpty()):
            break
        found = cut(expand(lists, frontier, direction, few=few, **live))
        walked = found if walked is None else walked.unionByName(found)
        ends = found.select(F.when(F.col("direction") == "out", F.col("to_id")).otherwise(F.col("from_id")).alias("node_id")).filter("node_id is not null").distinct()
        frontier = cut(ends.join(seen, "node_id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
        if limit is not None:
            n += frontier.count()
    truncated = limit is not None and n >= limit
    nodes = cut(seen.orderBy("hop", "node_id").limit(max(limit, first))) if truncated else seen
    if walked is None:
        walked = expand(lists, start.limit(0), direction, few=few)
    kept = nodes.select("node_id")
    between = walked.dropDuplicates(_TRIPLE).drop("direction").join(kept.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(kept.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return nodes, between, truncated


def version_links(versions: DataFrame) -> DataFrame:
    """The edges that build() needs for chains of versions: each to the one before it."""
    return versions.filter("previous_version_id is not null").select(F.lit("previous_version").alias("edge_type"), F.col("node_id").alias("from_id"), F.col("previous_version_id").alias("to_id"), F.lit(None).cast("timestamp").alias("invalidated_at"))


def version_chain(lists: Adjacency, versions: DataFrame, node_id: str) -> DataFrame:
    """All versions of a record, back and forward from one of them, as graph.version_chain(), over lists of version_links().

    A step looks up the lists of one or two ids in the buckets that they hash to,
    so a chain of n versions takes up to n lookups, and the table of versions is
    read once, for the rows themselves. A version whose predecessor is unknown is
    the first; cycles end.
    """
    start = versions.sparkSession.createDataFrame([(node_id,)], "node_id string")
    found, _, _ = neighbourhood(lists, start, None)
    return versions.join(F.broadcast(found.select("node_id")), "node_id", "left_semi")  # one record's versions
