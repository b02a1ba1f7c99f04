"""From clean readings of episodes to rows of the graph: ids, credit, anchors; and candidate records read back in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ids import scoped_id
from palimpsest.functions.scoring import strongest
from palimpsest.plans.extraction import credited

_c = F.col

# Where the words of each kind of record stand, in the order in which they are asked for, and where any other's may.
PREVIEW_FIELDS = {
    "ObservationNode": ("content",),
    "EventNode": ("event_summary",),
    "SessionNode": ("session_summary",),
    "PatternNode": ("pattern_name", "pattern_description"),
    "BeliefNode": ("belief_statement",),
    "LessonNode": ("lesson_statement",),
    "AdoptedPrincipleNode": ("principle_statement",),
    "OpenLoopNode": ("loop_description",),
    "ContradictionNode": ("contradiction_summary",),
}
OTHER_FIELDS = ("content", "pattern_name", "belief_statement", "event_summary")


def card_preview(label: Column, fields: Column) -> Column:
    """The words that a card shows of a record (fields: a map of text): those of its kind first, then any, whole; empty where there are none."""
    said = lambda name: F.nullif(F.trim(F.try_element_at(fields, F.lit(name))), F.lit(""))
    own = F.lit(None).cast("string")
    for kind, names in PREVIEW_FIELDS.items():
        own = F.when(label == kind, F.coalesce(*map(said, names))).otherwise(own)
    return F.coalesce(own, *map(said, OTHER_FIELDS), F.lit(""))


def candidate_history(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """(node_id, node_type, preview, valid_from, era_tag, fields): every candidate (item_id, node_id) in full, once, however many findings it was found for.

    records: node_id, label, fields (map of text). A date that can't be read is
    none, which makes a record look recent: that unlocks nothing. Candidates
    without a record have no row.
    """
    wanted = candidates.select("node_id").filter("node_id is not null").distinct()
    one = records.groupBy("node_id").agg(F.min_by(F.struct("label", "fields"), F.to_json("fields")).alias("r")).join(wanted, "node_id", "left_semi")
    field = lambda name: F.try_element_at("r.fields", F.lit(name))
    return one.select(
        "node_id", F.coalesce(F.nullif("r.label", F.lit("")), F.lit("unknown")).alias("node_type"), F.coalesce(F.nullif(field("content"), F.lit("")), F.nullif(field("pattern_name"), F.lit("")), F.lit("")).alias("preview"),
        F.try_to_timestamp(F.replace(field("valid_from"), F.lit("Z"), F.lit("+00:00"))).alias("valid_from"), field("era_tag").alias("era_tag"), "r.fields",
    )


def assemble(episodes: DataFrame, findings: DataFrame, rejected: DataFrame, events: DataFrame, steps: DataFrame) -> dict[str, DataFrame]:
    """Rows of observations, events, chains, steps and sessions of episodes, with their ids.

    episodes: episode_id, event_date, episode_index, entry_class, occurred_at,
    recorded_at, summary, adopted (wording taken over from the assistant), model.
    findings: episode_id, pos, type, content, evidence, signal_strength, provenance,
    attempt. rejected: episode_id, pos, type, content, rule, last_rule, attempts.
    events: episode_id, pos, summary, signal_strength. steps: episode_id, chain,
    pos, kind, content.

    Ids carry the day, the episode's place in it and a number that counts up for
    each kind, so two episodes of a day never claim one name. A finding that could
    not be saved is an observation too, of type CONTEXT, with its words untouched
    and what was wrong among its evidence; it is numbered after the good ones. Of
    each episode there is a session, so that a change has something to hang on to,
    as weighty as its weightiest good finding. Steps are counted, not believed.
    Rows of episodes that aren't there are left out. Windows hold one episode.
    """
    heads = episodes.select("episode_id", "event_date", "episode_index", "entry_class", "occurred_at", "recorded_at", F.coalesce("adopted", F.array().cast("array<string>")).alias("adopted"), "model")

    def named(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("episode_id").orderBy(*order))
        return rows.join(heads, "episode_id").withColumn("node_id", scoped_id(F.lit(prefix), _c("event_date"), _c("episode_index"), n))

    none, text = F.array().cast("array<string>"), lambda c: F.coalesce(c, F.lit(""))
    good = findings.select("episode_id", F.lit(0).alias("_kind"), "pos", "type", "content", F.coalesce("evidence", none).alias("evidence"), "signal_strength", "provenance", F.lit(None).cast("string").alias("_failed"), _c("attempt").cast("int").alias("attempt"))
    still = F.when(_c("last_rule") != _c("rule"), F.concat(F.lit("still wrong after correcting: "), "last_rule"))
    notes = F.filter(F.array(F.concat(F.lit("extraction failed: "), "rule"), F.concat(F.lit("attempted type: "), F.coalesce(F.nullif("type", F.lit("")), F.lit("none given"))), still), lambda x: x.isNotNull())
    bad = rejected.select("episode_id", F.lit(1), "pos", F.lit("CONTEXT"), "content", notes, F.lit("STANDARD"), F.lit("USER_GENERATED"), F.lit("EXTRACTION_FAILED"), _c("attempts").cast("int"))
    seen = named(good.union(bad), "obs", "_kind", "pos", "content")
    shared = credited(_c("provenance"), F.concat_ws(" ", text(_c("content")), F.array_join("evidence", " ")), _c("adopted"))
    status = F.coalesce("_failed", F.when(_c("entry_class") == "RAW_CAPTURE", "RAW_CAPTURE").otherwise("ACTIVE"))
    observations = seen.select(
        "node_id", "episode_id", _c("recorded_at").alias("created_at"), _c("recorded_at").alias("valid_from"), "occurred_at", "type", "content", _c("evidence").alias("raw_evidence"), "signal_strength",
        F.when(_c("_failed").isNull(), shared).otherwise(_c("provenance")).alias("provenance"), status.alias("status"), _c("model").alias("extraction_model"), _c("attempt").alias("extraction_attempt"),
    )
    own = lambda df, *columns: df.select("node_id", "episode_id", _c("recorded_at").alias("created_at"), *columns, F.lit("ACTIVE").alias("status"))
    happened = own(named(events, "evt", "pos", "summary"), "occurred_at", _c("summary").alias("event_summary"), "signal_strength")
    chains = named(steps.groupBy("episode_id", "chain").agg(F.count(F.lit(1)).cast("int").alias("step_count")), "chain", "chain")
    place = F.row_number().over(Window.partitionBy("episode_id", "chain").orderBy("pos"))
    ordered = named(steps.withColumn("step_index", place), "step", "chain", "pos").join(chains.select("episode_id", "chain", _c("node_id").alias("chain_id")), ["episode_id", "chain"])
    weight = findings.groupBy("episode_id").agg(strongest(_c("signal_strength")).alias("signal_strength"))
    sessions = named(episodes.select("episode_id", "summary"), "sess", "episode_id").join(weight, "episode_id", "left")
    who = F.when(F.exists("adopted", lambda x: F.trim(x) != ""), F.array(F.lit("user"), F.lit("ai_facilitator"))).otherwise(F.array(F.lit("user")))
    return {
        "observations": observations,
        "events": happened,
        "chains": own(chains, "step_count"),
        "steps": ordered.select("node_id", "chain_id", "step_index", _c("kind").alias("step_type"), "content"),
        "sessions": own(sessions, "occurred_at", "event_date", _c("summary").alias("session_summary"), F.coalesce("signal_strength", F.lit("STANDARD")).alias("signal_strength"), who.alias("participant_entities")),
    }
