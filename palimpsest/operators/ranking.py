"""Merging of ranked lists, budgets and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import content_words

# Which pass wins when several found one record.
PRECEDENCE = {"STRUCTURAL": 0, "SEMANTIC": 1, "CONTINUITY": 2}

# Domains that need to be opened before critical records are shown.
SENSITIVE_DOMAINS = ("SELF_CONCEPT", "RELATIONAL", "HEALTH", "SPIRITUALITY")


def precedence(found_by: Column) -> Column:
    return F.when(found_by == "STRUCTURAL", 0).when(found_by == "SEMANTIC", 1).otherwise(2)


def merge_passes(found: DataFrame, boosts: DataFrame | None, cap: int, multiplier: float = 1.3) -> DataFrame:
    """The best copy of each record, boosted once where it is held already, best first up to a cap.

    found: node_id, found_by, rank_score, boosted. The pass of lower precedence
    wins, then the higher score. boosts: node_id.
    """
    w = Window.partitionBy("node_id").orderBy(precedence(F.col("found_by")), F.desc("rank_score"))
    best = found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if boosts is not None:
        best = best.join(boosts.select("node_id").distinct().withColumn("_held", F.lit(True)), "node_id", "left")
        lift = F.col("_held").isNotNull() & ~F.col("boosted")
        best = best.withColumn("rank_score", F.when(lift, F.col("rank_score") * multiplier).otherwise(F.col("rank_score"))).withColumn("boosted", F.col("boosted") | lift).drop("_held")
    return best.orderBy(F.desc("rank_score"), precedence(F.col("found_by")), "node_id").limit(cap)


def cap_merge(semantic: DataFrame, structural: DataFrame, cap: int) -> DataFrame:
    """Anchored records first: the others get what is left of the cap, in their order (pos). Bounded by the cap."""
    anchored = structural.orderBy("pos").limit(cap).withColumn("source", F.lit("STRUCTURAL"))
    others = semantic.join(structural.select("node_id"), "node_id", "left_anti").withColumn("source", F.lit("SEMANTIC"))
    both = anchored.unionByName(others.orderBy("pos").limit(cap))
    return both.orderBy(precedence(F.col("source")), "pos").limit(cap)


def withheld(signal: Column, domain: Column, opened: list[str]) -> Column:
    """Critical records of a sensitive domain that isn't open; without a domain any open one will do."""
    closed = domain.isin(*SENSITIVE_DOMAINS) & ~domain.isin(*opened) if opened else domain.isin(*SENSITIVE_DOMAINS)
    nothing_open = F.lit(not set(opened) & set(SENSITIVE_DOMAINS))
    return (signal == "CRITICAL") & F.coalesce(closed, nothing_open)


def suffix_budget(rows: DataFrame, group: list[str], newest: str, tokens: str, limit: int) -> DataFrame:
    """The newest rows of each group that fit together: the first that doesn't fit ends it."""
    w = Window.partitionBy(*group).orderBy(F.desc(newest)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(tokens).over(w)).filter(F.col("spent") <= limit)


def section_fit(rows: DataFrame, group: list[str], order: str, size: str, limit: int) -> DataFrame:
    """The first blocks of each group that fit; empty ones don't count."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.filter(F.col(size) > 0).withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= limit)


def greedy_budget(rows: DataFrame, group: list[str], max_tokens: int, max_records: int, per_kind: int = 3, duplicate: float = 0.8) -> DataFrame:
    """Work through each group's ranked rows (pos, node_id, kind, tokens, preview) once; what doesn't fit is skipped, not the end.

    A row goes for being over the count, too many of its kind, a repeat of what
    was kept, or over what is left of the tokens, in that order; `reason` says
    which, null for a kept one. A group is a ranked list of a turn, bounded by the
    cap of retrieval.
    """
    item = F.struct("pos", "node_id", "kind", "tokens", content_words(F.col("preview")).alias("words"))
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.expr("named_struct('spent', 0L, 'kept', cast(array() as array<struct<kind:string,words:array<string>>>), 'out', cast(array() as array<struct<pos:bigint,node_id:string,reason:string>>))")

    def step(s: Column, x: Column) -> Column:
        least = lambda k: F.least(F.size(k["words"]), F.size(x["words"]))
        alike = F.exists(s["kept"], lambda k: (least(k) > 0) & (F.size(F.array_intersect(k["words"], x["words"])) / least(k) >= duplicate))
        reason = (
            F.when(F.size(s["kept"]) >= max_records, "over_count")
            .when(F.size(F.filter(s["kept"], lambda k: k["kind"] == x["kind"])) >= per_kind, "too_many_of_a_kind")
            .when(alike, "duplicate")
            .when(s["spent"] + x["tokens"] > max_tokens, "over_budget")
        )
        mine = F.array(F.struct(x["kind"].alias("kind"), x["words"].alias("words")))
        return F.struct(
            F.when(reason.isNull(), s["spent"] + x["tokens"]).otherwise(s["spent"]).alias("spent"),
            F.when(reason.isNull(), F.concat(s["kept"], mine)).otherwise(s["kept"]).alias("kept"),
            F.concat(s["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), x["node_id"].alias("node_id"), reason.alias("reason")))).alias("out"),
        )

    return lists.withColumn("r", F.aggregate("items", start, step)).select(*group, F.explode("r.out").alias("o")).select(*group, "o.*")


def queue_order() -> list[Column]:
    """Priority first, then the stronger signal, then the older."""
    return [F.asc("priority_rank"), F.desc("signal_rank"), F.asc("created_at")]


def admit(parked: DataFrame, pending: DataFrame, cap: int) -> DataFrame:
    """Parked items of each user that the cap has room for, in queue order (pending: user_id, n)."""
    w = Window.partitionBy("user_id").orderBy(*queue_order(), "id")
    ranked = parked.withColumn("_n", F.row_number().over(w)).join(pending, "user_id", "left")
    return ranked.filter(F.col("_n") <= F.lit(cap) - F.coalesce("n", F.lit(0))).drop("_n", "n")


def last_turns(messages: DataFrame, n: int, summarised: Column | int = -1) -> DataFrame:
    """The last turns of each conversation, and before them those not summarised yet (`recent` false)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    back = messages.withColumn("_n", F.row_number().over(w))
    return back.withColumn("recent", F.col("_n") <= n).filter(F.col("recent") | (F.col("turn") > summarised)).drop("_n")


def align(items: DataFrame, answers: DataFrame, fallback: Column) -> DataFrame:
    """Answers matched to items by their number (items: pos; answers: index, answer, seq): the first counts, gaps are filled."""
    w = Window.partitionBy("index").orderBy("seq")
    first = answers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.col("index").alias("pos"), "answer")
    return items.join(first, "pos", "left").withColumn("answer", F.coalesce("answer", fallback))
