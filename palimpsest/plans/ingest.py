"""Candidates for each finding of an entry: what reads like it, from the index, and what its episode's anchors reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import signal_weight
from palimpsest.operators.vector_index import VectorIndex, search


def candidates(index: VectorIndex, targets: DataFrame, records: DataFrame, anchors: DataFrame, fetch: int = 20, keep: int = 5, cap: int = 8, exact: bool = False) -> DataFrame:
    """(target_id, node_id, source, similarity, place): at most `cap` candidates of each target, anchored ones first.

    targets: target_id, episode_id, embedding (null where it couldn't be embedded:
    such a target gets its anchors only). records: node_id, episode_id,
    signal_strength; only live ones. anchors: episode_id, node_id, pos: what the
    people, the era and the open questions of an episode reach, looked up once for
    an episode and shared by its targets.

    What reads like a target is fetched first and filtered then: records of its own
    episode and unknown ones aren't made up for. Ranked is by similarity times the
    record's weight, returned the similarity. A record that an anchor reaches too
    is anchored. A null episode is no one's own. Windows hold what one target has,
    bounded by fetch and by the anchors of an episode.
    """
    mine = targets.select("target_id", "episode_id")
    near = search(index, targets.select(F.col("target_id").alias("query_id"), "embedding"), fetch, exact=exact).withColumnRenamed("query_id", "target_id").withColumnRenamed(index.key, "node_id")
    known = records.select("node_id", F.col("episode_id").alias("its_episode"), "signal_strength")
    usable = near.join(known, "node_id").join(mine, "target_id").filter(~F.coalesce(F.col("its_episode") == F.col("episode_id"), F.lit(False)))
    order = Window.partitionBy("target_id").orderBy(F.desc(F.col("score") * signal_weight(F.col("signal_strength"))), "node_id")
    alike = usable.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= keep).select("target_id", "node_id", F.lit("SEMANTIC").alias("source"), F.col("score").alias("similarity"), "pos")
    first = anchors.groupBy("episode_id", "node_id").agg(F.min("pos").alias("pos"))
    first = first.withColumn("pos", F.row_number().over(Window.partitionBy("episode_id").orderBy("pos", "node_id"))).filter(F.col("pos") <= cap)
    reached = mine.join(first, "episode_id").select("target_id", "node_id", F.lit("STRUCTURAL").alias("source"), F.lit(None).cast("double").alias("similarity"), "pos")
    # An anchor beyond the cap is still no match by meaning.
    every = mine.join(anchors.select("episode_id", "node_id").distinct(), "episode_id").select("target_id", "node_id")
    both = reached.unionByName(alike.join(every, ["target_id", "node_id"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("source") == "SEMANTIC", "pos"))
    return both.withColumn("place", place).filter(F.col("place") <= cap).drop("pos")
