"""Lookups and listings of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.temporal import moment


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The record of an id, or no row."""
    return nodes.filter(F.col("node_id") == node_id).limit(1)


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Records in the order asked for (ids: pos, node_id); repeated ids once, unknown ones left out."""
    first = ids.groupBy("node_id").agg(F.min("pos").alias("pos"))
    return nodes.join(first, "node_id").orderBy("pos")


def listing_filter(
    *,
    kind: Column | None = None,
    kinds: list[str] | None = None,
    at: Column | None = None,
    since: str | None = None,
    until: str | None = None,
    equal: dict[str, tuple[Column, str | None]] | None = None,
    answers: Column | None = None,
) -> Column:
    """Filters of a listing. What a kind of record can't answer (`answers` false) is not asked of it."""
    out = F.lit(True)
    if kind is not None and kinds:
        out &= kind.isin(*kinds)
    able = F.lit(True) if answers is None else answers
    if at is not None and since:
        out &= ~able | (at >= moment(since))
    if at is not None and until:
        out &= ~able | (at <= moment(until))
    for column, value in (equal or {}).values():
        if value is not None:
            out &= ~able | (column == value)
    return out


def active(kind: Column, status: Column, without_status: list[str]) -> Column:
    """ACTIVE; kinds that have no status always are."""
    return F.when(kind.isin(*without_status), True).otherwise(F.coalesce(status == "ACTIVE", F.lit(False)))


def page(nodes: DataFrame, recency: str, limit: int, offset: int = 0, key: str = "node_id") -> DataFrame:
    """Newest first, with the id to settle ties, from an offset on."""
    return nodes.orderBy(F.desc(recency), key).offset(offset).limit(limit)


def after(nodes: DataFrame, cursor: str | None, limit: int, key: str = "node_id") -> DataFrame:
    """Keyset page: ids above a cursor, ascending."""
    rows = nodes if cursor is None else nodes.filter(F.col(key) > cursor)
    return rows.orderBy(key).limit(limit)


def date_range(nodes: DataFrame, start: str, end: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """start <= event_date < end, in order."""
    rows = nodes.filter((F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date"))).orderBy("event_date", "occurred_at", "episode_id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def count_by_kind(nodes: DataFrame, kinds: DataFrame, kind: str = "type") -> DataFrame:
    """A count for every kind, zero included."""
    counted = nodes.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def keep_first(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_attempt(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).alias("next_attempt"))
