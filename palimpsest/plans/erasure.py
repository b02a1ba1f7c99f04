"""Erasure: texts rewritten where they stand, ids, edges and dates kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import user_hash
from palimpsest.functions.text import erased, erased_person


def anonymise(rows: DataFrame, targets: DataFrame, texts: list[str], names: list[str], at: Column, key: str = "node_id") -> DataFrame:
    """Rows of which those that the targets name have texts and person names replaced; nulls stay."""
    hit = rows.join(targets.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    gone = F.col("_hit").isNotNull()
    new = {c: F.when(gone & F.col(c).isNotNull(), erased(at)).otherwise(F.col(c)) for c in texts}
    new |= {c: F.when(gone & F.col(c).isNotNull(), erased_person(F.col(c))).otherwise(F.col(c)) for c in names}
    return hit.withColumns(new).select(*rows.columns)


def preview(rows: DataFrame, targets: DataFrame, kind: str, key: str = "node_id") -> DataFrame:
    """How many records of each kind an erasure would reach."""
    return rows.join(targets.select(key), key, "left_semi").groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def audit(user: str, nodes: int, vectors: int, at: Column, spark) -> DataFrame:
    """The note an erasure leaves: what it did, the user as a hash only."""
    return spark.range(1).select(user_hash(F.lit(user)).alias("user_id_hash"), at.alias("erased_at"), F.lit(nodes).alias("nodes_anonymized"), F.lit(vectors).alias("embeddings_deleted"))


def purge(messages: DataFrame, sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Message contents of some sessions blanked."""
    hit = messages.join(sessions.select("session_id").distinct().withColumn("_hit", F.lit(True)), "session_id", "left")
    return hit.withColumns({c: F.when(F.col("_hit").isNotNull(), F.lit("")).otherwise(F.col(c)) for c in columns}).select(*messages.columns)
