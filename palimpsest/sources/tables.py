"""The event, order, text and vector tables of a data directory as typed records, edges and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """One finding per event, with its episode (a user's day), person, pattern and signal."""
    e = read(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("obs_"), "event_id").alias("node_id"),
        "event_id",
        "user_id",
        F.col("event_type").alias("type"),
        F.col("ts").alias("occurred_at"),
        F.to_date("ts").alias("event_date"),
        "value",
        F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 75, "HIGH").otherwise("STANDARD").alias("signal_strength"),
        F.concat(F.lit("person_"), "user_id").alias("person"),
        F.concat(F.lit("ep_"), "user_id", F.lit("_"), F.date_format("ts", "yyyy_MM_dd")).alias("episode_id"),
        F.concat(F.lit("pat_"), k % 20).alias("pattern_id"),
    )


def episodes(found: DataFrame) -> DataFrame:
    return found.groupBy("episode_id").agg(F.min("event_date").alias("event_date"), F.min("occurred_at").alias("occurred_at"), F.first("user_id").alias("user_id"), F.count(F.lit(1)).alias("findings"))


def patterns(found: DataFrame) -> DataFrame:
    """Standing patterns: when each began and was last seen, and how often."""
    return found.groupBy("pattern_id").agg(F.min("occurred_at").alias("valid_from"), F.max("occurred_at").alias("last_reinforced_at"), F.count(F.lit(1)).alias("evidence_count"))


def edges(found: DataFrame) -> DataFrame:
    """Containment, reinforcement and regulation edges; every tenth finding's are withdrawn after a week."""
    gone = F.when(F.col("event_id") % 10 == 0, F.timestamp_add("DAY", F.lit(7), "occurred_at")).alias("invalidated_at")
    rows = [F.struct(F.lit("contains_obs").alias("edge_type"), F.col("episode_id").alias("from_id"), F.col("node_id").alias("to_id"))]
    rows.append(F.struct(F.lit("reinforces_obs_pat").alias("edge_type"), F.col("node_id").alias("from_id"), F.col("pattern_id").alias("to_id")))
    rows.append(F.struct(F.lit("mentions_person").alias("edge_type"), F.col("node_id").alias("from_id"), F.col("person").alias("to_id")))
    also = F.when(F.col("type") == "signup", F.array(F.struct(F.lit("regulates_obs").alias("edge_type"), F.col("node_id").alias("from_id"), F.col("pattern_id").alias("to_id"))))
    every = F.concat(F.array(*rows), F.coalesce(also, F.array().cast("array<struct<edge_type:string,from_id:string,to_id:string>>")))
    return found.select(F.explode(every).alias("e"), F.col("occurred_at").alias("valid_from"), gone).select("e.*", "valid_from", "invalidated_at")


def decisions(found: DataFrame) -> DataFrame:
    """Errors contradict the pattern they touch, purchases branch from it."""
    return found.filter("type in ('error', 'purchase')").select(
        F.concat(F.lit("d_"), "event_id").alias("node_id"),
        F.col("occurred_at").alias("created_at"),
        F.when(F.col("type") == "error", "CONTRADICT").otherwise("BRANCH").alias("action"),
        F.col("pattern_id").alias("target_node_id"),
        F.col("node_id").alias("source_node_id"),
        "episode_id",
        F.when(F.col("event_id") % 17 == 0, "ROLLED_BACK").otherwise("ACTIVE").alias("status"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    return e.select(F.concat(F.lit("vec_"), "vec_id").alias("node_id"), "vec_id", "embedding", F.col("label").alias("kind"))


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's orders as a version chain: each points at the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, folder, "orders")
    return o.select(
        F.col("o_custkey").alias("chain"),
        F.concat(F.lit("bel_"), "o_orderkey").alias("node_id"),
        F.concat(F.lit("bel_"), F.lag("o_orderkey").over(w)).alias("previous_version_id"),
        F.row_number().over(w).alias("version"),
        F.col("o_orderdate").alias("valid_from"),
    )
