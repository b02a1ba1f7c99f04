"""Reads that follow records: histories, chains, maps, queues and recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import cut

# Kinds of record that are history; all else is machinery.
CONTENT = ("ObservationNode", "EventNode", "SessionNode", "PatternNode", "BeliefNode", "LessonNode", "AdoptedPrincipleNode", "OpenLoopNode")
# States of a record that is out of the live picture.
RETIRED = ("SUPERSEDED", "SUSPENDED", "EXTRACTION_FAILED")


def kind_of(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown"))


def retired(status: Column) -> Column:
    return F.coalesce(status, F.lit("")).isin(*RETIRED)


def live_content(label: Column, status: Column) -> Column:
    """History that is still in play: a kind that counts, not superseded, suspended or unreadable."""
    return F.coalesce(label.isin(*CONTENT), F.lit(False)) & ~retired(status)


def tidy_edges(edges: DataFrame, properties: list[str]) -> DataFrame:
    """Each edge as its triple and a map of the properties that are there and not blank."""
    held = F.map_filter(F.create_map(*[x for p in properties for x in (F.lit(p), F.col(p).cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))
    return edges.select("edge_type", F.col("from_id").alias("from_node_id"), F.col("to_id").alias("to_node_id"), held.alias("properties"))


def index_payload(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """(node_id, payload): the few plain facts that lie beside a vector, as JSON without the missing ones."""
    return nodes.select("node_id", F.to_json(F.struct("node_id", F.col("label").alias("node_type"), *[F.col(c).cast("string").alias(c) for c in fields])).alias("payload"))


def decision_history(edges: DataFrame, notes: DataFrame, node_id: str) -> DataFrame:
    """The audit notes that any edge of a record leads to, withdrawn ones too, newest first."""
    ends = edges.filter(F.col("from_id") == node_id).select(F.col("to_id").alias("node_id")).distinct()
    return notes.join(ends, "node_id", "left_semi").orderBy(F.desc("created_at"), "node_id")


def chain_steps(edges: DataFrame, steps: DataFrame, chain_id: str) -> DataFrame:
    """The steps (node_id, step_index) of a causal chain in their order."""
    inside = edges.filter((F.col("edge_type") == "chain_contains") & (F.col("from_id") == chain_id)).select(F.col("to_id").alias("node_id")).distinct()
    return steps.join(inside, "node_id", "left_semi").orderBy("step_index")


def by_era(records: DataFrame, era: str, kinds: list[str], limit: int) -> DataFrame:
    """Records of some kinds filed under an era, which episodes keep in another column."""
    tag = F.when(F.col("label") == "EpisodeNode", F.col("historical_era")).otherwise(F.col("era_tag"))
    return records.filter(F.col("label").isin(*kinds) & (tag == era)).orderBy("node_id").limit(limit)


def episode_of(edges: DataFrame) -> DataFrame:
    """(node_id, episode_id): each finding with the episode that contains it; of several the last one written."""
    return edges.filter(F.col("edge_type").startswith("contains")).groupBy(F.col("to_id").alias("node_id")).agg(F.max_by("from_id", F.struct("valid_from", "from_id")).alias("episode_id"))


def hydrate(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits (node_id, similarity) with the rows they stand for; hits without one go."""
    return records.join(hits.groupBy("node_id").agg(F.max("similarity").alias("similarity")), "node_id")


def follow(links: DataFrame, start: DataFrame) -> DataFrame:
    """(node_id, step): what links (from_id, to_id) lead to one after another, the start included; cycles end.

    One round for each step; only the ids of a round are written and go on.
    """
    seen = frontier = cut(start.select("node_id").distinct().withColumn("step", F.lit(0)))
    step = 0
    while not frontier.isEmpty():
        step += 1
        ahead = links.join(frontier.select(F.col("node_id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("node_id")).filter("node_id is not null").distinct()
        frontier = cut(ahead.join(seen, "node_id", "left_anti").withColumn("step", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def revoke_chain(tokens: DataFrame, token_id: str, at: str) -> DataFrame:
    """Tokens (token_id, rotated_to, revoked_at) with one and all it was rotated to revoked; those revoked before keep their time."""
    links = tokens.select(F.col("token_id").alias("from_id"), F.col("rotated_to").alias("to_id"))
    start = tokens.filter(F.col("token_id") == token_id).select(F.col("token_id").alias("node_id"))
    reached = follow(links, start).select(F.col("node_id").alias("token_id"), F.lit(True).alias("_hit"))
    new = F.when(F.col("_hit"), F.coalesce("revoked_at", F.lit(at).cast("timestamp"))).otherwise(F.col("revoked_at"))
    return tokens.join(reached, "token_id", "left").withColumn("revoked_at", new).drop("_hit")


def queue_counts(items: DataFrame) -> DataFrame:
    """For each user (status, asked_at, created_at): how many wait, how many of those were asked about, the oldest."""
    waits = F.col("status") == "PENDING_HITL"
    return items.groupBy("user_id").agg(F.count_if(waits).alias("pending"), F.count_if(waits & F.col("asked_at").isNotNull()).alias("asked"), F.min(F.when(waits, F.col("created_at"))).alias("oldest"))


def recent_days(sessions: DataFrame, before: str, limit: int, lookback_days: int = 14) -> DataFrame:
    """Each user's latest days (day, events) before a date that aren't empty, within a look-back."""
    day, end = F.col("day").cast("date"), F.lit(before).cast("date")
    kept = sessions.filter((F.col("events") > 0) & (day < end) & (day >= F.date_sub(end, lookback_days)))
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def cap_with_loss(rows: DataFrame, group: list[str], order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of each group up to a ceiling, and for the groups that lost some how many."""
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")
    lost = rows.groupBy(*group).agg((F.count(F.lit(1)) - limit).alias("dropped")).filter("dropped > 0")
    return kept, lost


def distinct_names(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """One row for each name of a group whatever its case, in the spelling that came first; blank names go."""
    trimmed = rows.withColumn(name, F.trim(name)).filter(F.col(name) != "")
    return trimmed.groupBy(*group, F.lower(name).alias("key")).agg(F.min_by(name, F.struct(*order)).alias(name))


def claim_hits(hits: DataFrame, counted: DataFrame) -> DataFrame:
    """(session_id, node_id) that weren't counted in their session yet, each once."""
    keys = ["session_id", "node_id"]
    return hits.select(*keys).distinct().join(counted.select(*keys), keys, "left_anti")


def counters(records: DataFrame, hits: DataFrame, column: str) -> DataFrame:
    """Records with a counter that is higher by their hits (node_id)."""
    n = hits.groupBy("node_id").agg(F.count(F.lit(1)).alias("_n"))
    return records.join(n, "node_id", "left").withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def revise(messages: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log (conv_id, turn, parent, text) with revisions (conv_id, turn, text) set beside what they revise, and each conversation's active leaf.

    Nothing is changed: a revision is a new turn under the same parent, and what
    followed the old one stays on its own branch. One revision for a conversation;
    a turn that isn't there is not revised.
    """
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    old = messages.select("conv_id", "turn", "parent")
    new = revisions.join(old, ["conv_id", "turn"]).join(last, "conv_id").select("conv_id", (F.col("last") + 1).alias("turn"), "parent", "text")
    leaf = last.join(new.select("conv_id", F.col("turn").alias("_new")), "conv_id", "left").select("conv_id", F.coalesce("_new", "last").alias("turn"))
    return messages.select("conv_id", "turn", "parent", "text").unionByName(new), leaf


def report_rows(findings: DataFrame, start: str, end: str, grace_days: int, forced: bool = False) -> DataFrame:
    """Findings (event_date, written_at) of a period: those written before its grace ended, or all where the report is made anew.

    A finding belongs to the period of its own date, however late it is written;
    once the grace is over the report stands, and only a forced run sees it.
    """
    inside = findings.filter((F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date")))
    return inside if forced else inside.filter(F.col("written_at") < F.timestamp_add("DAY", F.lit(grace_days), F.lit(end).cast("timestamp")))


def report_id(kind: Column, start: Column, runs_before: Column) -> Column:
    """The id of a period's report; another run of it gets _r2, _r3 and so on beside the first."""
    base = F.concat(F.lit("rep_"), F.lower(kind), F.lit("_"), F.date_format(start, "yyyy_MM_dd"))
    return F.when(runs_before > 0, F.concat(base, F.lit("_r"), (runs_before + 1).cast("string"))).otherwise(base)
