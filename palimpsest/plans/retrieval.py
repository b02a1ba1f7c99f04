"""Retrieval: what a turn asks for, found by meaning, by structure and by what is held already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import Scoring, final_score
from palimpsest.functions.text import in_crisis, is_trivial, token_estimate, word_overlap
from palimpsest.operators.ranking import greedy_budget, merge_passes, precedence, withheld
from palimpsest.operators.vectors import cosine

# In which order kinds of trigger count.
TRIGGERS = ("NAMED_PERSON", "HISTORICAL_ERA", "SOMATIC_MARKER", "IDENTITY_STATEMENT", "BELIEF_CHALLENGE", "PATTERN_MENTION", "PROGRESS_CLAIM", "OPEN_LOOP_MATCH")


def formulation_path(text: Column) -> Column:
    """How a turn is read: distress first, then plain acknowledgements, else the classifier."""
    return F.when(in_crisis(text), "SAFETY_FLOOR").when(is_trivial(text), "ACKNOWLEDGEMENT").otherwise("CLASSIFIED")


def ground_triggers(raw: DataFrame, cap: int = 3) -> DataFrame:
    """Of each turn's triggers (turn_id, pos, kind, grounded) the first grounded one of a kind, by precedence, up to a cap."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TRIGGERS]), F.col("kind"))
    known = raw.filter(F.col("grounded") & (rank > 0)).withColumn("precedence", rank)
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("turn_id", "kind").orderBy("pos"))).filter("_n = 1")
    w = Window.partitionBy("turn_id").orderBy("precedence")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).drop("_n", "precedence")


def weigh(rows: DataFrame, now: str, config: Scoring = Scoring()) -> DataFrame:
    """Records with rank_score: similarity by all weights."""
    return rows.withColumn("rank_score", final_score(F.col("similarity"), F.col("signal_strength"), F.col("last_seen"), F.col("verification_status"), F.col("query_frequency"), now, config))


def revisit(held: DataFrame, query: DataFrame, at_least: float = 0.35, words_at_least: float = 0.6, boost: float = 1.3) -> DataFrame:
    """Held records (node_id, embedding, text, rank_score) that still fit the turn (one row: embedding, keywords).

    By cosine where both have a vector, else by the turn's words.
    """
    q = F.broadcast(query.select(F.col("embedding").alias("_q"), F.col("keywords").alias("_k")).limit(1))
    both = held.join(q)
    by_vector = F.col("embedding").isNotNull() & F.col("_q").isNotNull()
    near = F.when(by_vector, cosine(F.col("embedding"), F.col("_q"))).otherwise(word_overlap(F.col("_k"), F.col("text")))
    kept = both.withColumn("closeness", near).filter(F.when(by_vector, F.col("closeness") >= at_least).otherwise(F.col("closeness") >= words_at_least))
    return kept.drop("_q", "_k").withColumn("rank_score", F.col("rank_score") * boost).withColumn("boosted", F.lit(True)).withColumn("found_by", F.lit("CONTINUITY"))


def carried(late: DataFrame, turn: int, weight: float = 0.9) -> DataFrame:
    """Late results of the turn before, once and a little lower; older ones go."""
    return late.filter((F.lit(turn) - F.col("fetched_for")).between(0, 1)).withColumn("rank_score", F.col("rank_score") * weight)


def retrieve(semantic: DataFrame, structural: DataFrame, continuity: DataFrame, boosts: DataFrame, opened: list[str], cap: int = 12) -> tuple[DataFrame, DataFrame]:
    """All passes joined: what is offered, and what is withheld for being too sensitive."""
    every = semantic.unionByName(structural, allowMissingColumns=True).unionByName(continuity, allowMissingColumns=True)
    closed = withheld(F.col("signal_strength"), F.col("domain"), opened)
    return merge_passes(every.filter(~closed), boosts, cap), every.filter(closed).select("node_id").distinct()


def wanted(trigger: Column, label: Column, kind: Column) -> Column:
    """Whether a record can answer a kind of trigger: those about the body and about who one is ask for certain records only."""
    observed = label == "ObservationNode"
    somatic = observed & kind.isin("PHYSIOLOGICAL_CAPACITY_STATE", "SUPPRESSED_EMOTION_SURFACING")
    identity = (label == "BeliefNode") | (observed & kind.isin("BELIEF", "META_BELIEF", "IDENTITY_FUSION_STATE"))
    return F.coalesce(F.when(trigger == "SOMATIC_MARKER", somatic).when(trigger == "IDENTITY_STATEMENT", identity).otherwise(F.lit(True)), F.lit(False))


# Kinds of record that each lookup by structure returns.
PERSON_LINKED = ("ObservationNode", "EventNode", "SessionNode", "PatternNode", "BeliefNode")
ERA_TAGGED = ("PatternNode", "BeliefNode", "EpisodeNode")
STANDING = {"PROGRESS_CLAIM": ("PatternNode", "BeliefNode"), "BELIEF_CHALLENGE": ("BeliefNode",)}


def structural(triggers: DataFrame, records: DataFrame, mentions: DataFrame, keep: int = 5, base: float = 0.6) -> DataFrame:
    """What each turn's triggers (turn_id, kind, person, era, domain) lead to without any search: at most `keep` records for a lookup.

    records: node_id, label, status, era, domain, at. mentions: node_id, person. A
    named person leads to what mentions them, an era to what is filed under it, a
    claim of progress or a doubted belief to standing records of its domain, and
    an unfinished question, like a claim of progress, to the open ones. All get
    the same base score.
    """
    c = F.col
    cut_off = lambda df, lookup: df.withColumn("lookup", F.lit(lookup)).withColumn("_n", F.row_number().over(Window.partitionBy("turn_id", "kind", "asked").orderBy(F.desc("at"), "node_id"))).filter(c("_n") <= keep).select("turn_id", "kind", "lookup", "node_id")
    by_person = triggers.filter("kind = 'NAMED_PERSON'").select("turn_id", "kind", "person", c("person").alias("asked")).distinct().join(mentions.select("person", "node_id").distinct(), "person")
    by_person = by_person.join(records.filter(c("label").isin(*PERSON_LINKED)).select("node_id", "at"), "node_id")
    tagged = records.filter(c("label").isin(*ERA_TAGGED)).select("node_id", "era", "at")
    by_era = triggers.filter("kind = 'HISTORICAL_ERA'").select("turn_id", "kind", "era", c("era").alias("asked")).distinct().join(tagged, "era")
    live = records.filter("status = 'ACTIVE'")
    found = [cut_off(by_person, "PERSON"), cut_off(by_era, "ERA")]
    for kind, labels in STANDING.items():
        asks = triggers.filter(c("kind") == kind).select("turn_id", "kind", c("domain").alias("asked")).distinct()
        stand = live.filter(c("label").isin(*labels)).select("node_id", "domain", "at")
        # The newest of each domain, or of all, do for any turn, so records are cut before they meet the turns.
        newest = stand.withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("at"), "node_id"))).filter(c("_r") <= keep)
        found.append(cut_off(asks.join(newest.withColumnRenamed("domain", "asked"), "asked"), "STANDING"))
        newest = stand.orderBy(F.desc("at"), "node_id").limit(keep)
        found.append(cut_off(asks.filter("asked is null").join(F.broadcast(newest)), "STANDING"))
    questions = live.filter("label = 'OpenLoopNode'").select("node_id", "at").orderBy(F.desc("at"), "node_id").limit(keep)
    asks = triggers.filter("kind in ('OPEN_LOOP_MATCH', 'PROGRESS_CLAIM')").select("turn_id", "kind", F.lit("").alias("asked")).distinct()
    found.append(cut_off(asks.join(F.broadcast(questions)), "OPEN_QUESTIONS"))
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every.withColumn("base_score", F.lit(base)).withColumn("found_by", F.lit("STRUCTURAL"))


def outcome(turns: DataFrame, reports: DataFrame, kept: DataFrame) -> DataFrame:
    """(turn_id, outcome) of turns (turn_id, triggers, crisis).

    RETRIEVED if anything was kept. A turn that asked for nothing is NOT_NEEDED, or
    SUPPRESSED in a crisis. Else NOTHING, but UNAVAILABLE if every search of a
    store that had work (reports: turn_id, pass, had_work, status) failed: what
    couldn't be asked is not an answer.
    """
    asked = reports.filter("had_work and pass in ('SEMANTIC', 'STRUCTURAL')").groupBy("turn_id").agg(F.bool_and(F.col("status") != "OK").alias("failed"))
    n = kept.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n"))
    out = F.when(F.col("crisis"), "SUPPRESSED").when(F.col("triggers") == 0, "NOT_NEEDED").when(F.col("n") > 0, "RETRIEVED").when(F.coalesce("failed", F.lit(False)), "UNAVAILABLE").otherwise("NOTHING")
    return turns.join(asked, "turn_id", "left").join(n, "turn_id", "left").select("turn_id", out.alias("outcome"))


def conversational(found: DataFrame, boosts: DataFrame, turns: DataFrame, reports: DataFrame, opened: list[str], cap: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All passes of many turns at once: what is offered to each (with its place), what is withheld, and how each went.

    found: turn_id, node_id, found_by, rank_score, boosted, signal_strength, domain
    of the searches by meaning and by structure, of what was held and of what came
    late. The gate comes first, for late results too; then the best copy of each
    record, lifted where it was held (boosts: turn_id, node_id), up to the cap.
    """
    closed = withheld(F.col("signal_strength"), F.col("domain"), opened)
    kept = rank_turns(found.filter(~closed), boosts, cap)
    return kept, found.filter(closed).select("turn_id", "node_id").distinct(), outcome(turns, reports, kept)


def rank_turns(found: DataFrame, boosts: DataFrame, cap: int, multiplier: float = 1.3) -> DataFrame:
    """merge_passes() for many turns: the best copy of each record of a turn, best first up to a cap (place from 1)."""
    c, keys = F.col, ["turn_id", "node_id"]
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(precedence(c("found_by")), F.desc("rank_score")))).filter("_n = 1").drop("_n")
    held = boosts.select(*keys).distinct().withColumn("_held", F.lit(True))
    lift = c("_held").isNotNull() & ~c("boosted")
    best = best.join(held, keys, "left").withColumn("rank_score", F.when(lift, c("rank_score") * multiplier).otherwise(c("rank_score"))).drop("_held")
    w = Window.partitionBy("turn_id").orderBy(F.desc("rank_score"), precedence(c("found_by")), "node_id")
    return best.withColumn("place", F.row_number().over(w)).filter(c("place") <= cap)


def assemble(kept: DataFrame, policies: dict[str, int], alert_tokens: int = 0, max_records: int = 6, per_kind: int = 3) -> DataFrame:
    """What of each turn's candidates (turn_id, node_id, kind, rank_score, occurred_at, preview, register) goes into its briefing.

    By score, the newer of two first. A register has its room in tokens, of which
    an alert takes its part first; one that isn't listed offers nothing. `reason`
    says why a row was left out.
    """
    order = Window.partitionBy("turn_id").orderBy(F.desc("rank_score"), F.desc_nulls_last("occurred_at"), "node_id")
    rows = kept.withColumn("pos", F.row_number().over(order).cast("long")).withColumn("tokens", token_estimate(F.col("preview")))
    out = rows.filter(~F.col("register").isin(*policies)).select("turn_id", "pos", "node_id", F.lit("nothing_is_offered").alias("reason"))
    for register, room in policies.items():
        mine = rows.filter(F.col("register") == register)
        out = out.unionByName(greedy_budget(mine, ["turn_id"], room - alert_tokens, max_records, per_kind).select("turn_id", "pos", "node_id", "reason"))
    return out


def shadow_alert(reports: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """The newest burst report (created_at, report_type, detected, alert), if it is young, found something and says so."""
    newest = reports.filter("report_type = 'SHADOW'").orderBy(F.desc("created_at"), "node_id").limit(1)
    young = F.timestamp_add("HOUR", F.lit(hours), "created_at") >= F.lit(now).cast("timestamp")
    return newest.filter(young & F.col("detected") & (F.trim("alert") != "")).select("alert")
