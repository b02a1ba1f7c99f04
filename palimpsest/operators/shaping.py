"""Row shaping: renderings, cards, episodes, minted ids and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids, text
from palimpsest.sources.scratch import cut

# What a finding of a kind can grow into; kinds not listed stay with their day.
PROMOTION = {
    "BELIEF": ("BELIEF", "META_BELIEF", "EPISTEMIC_SHIFT", "CONCEPTUAL_REFRAME", "PERSPECTIVE_SHIFT", "CORE_WOUND", "CORE_CONFLICT", "IDENTITY_AFFINITY", "IDENTITY_FUSION_STATE", "EXISTENTIAL_REFLECTION", "ACCEPTANCE_ACKNOWLEDGEMENT", "METACOGNITIVE_BREAKTHROUGH", "LESSON"),
    "PATTERN": ("PATTERN", "RUMINATION_LOOP", "COGNITIVE_DISTORTION", "COGNITIVE_DISTORTION_STATE", "COGNITIVE_DEFENSE_MECHANISM", "SELF_NARRATION_PATTERN", "SOCIAL_PERFORMANCE_STATE", "SUBPERSONALITY_ACTION", "RELATIONAL_DYNAMIC", "ENVIRONMENTAL_DEPENDENCY", "INAUTHENTICITY_STATE", "OTHER_PERSON_MODEL", "SYSTEM_DESIGN_ITERATION"),
    "OPEN_LOOP": ("OPEN_LOOP",),
}


def promotion(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for target, kinds in PROMOTION.items():
        out = F.when(kind.isin(*kinds), target).otherwise(out)
    return out


def tidy(columns: dict[str, Column]) -> list[Column]:
    """Text columns with the blank ones as null."""
    return [F.when(F.trim(c) != "", c).alias(name) for name, c in columns.items()]


def index_text(parts: list[Column]) -> Column:
    """The parts of a record that are not blank, joined; null where there is nothing to index."""
    return F.nullif(F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def render_line(kind: Column, what: Column, day: Column) -> Column:
    """A briefing line for a record."""
    lead = F.when(kind == "PatternNode", "Pattern").when(kind == "BeliefNode", "Belief").when(kind == "LessonNode", "Lesson").otherwise("Noted")
    return F.concat_ws(" ", F.concat(lead, F.lit(":")), what, F.concat(F.lit("("), F.date_format(day, "yyyy-MM-dd"), F.lit(")")))


def dialogue(messages: DataFrame, user: str = "Me", other: str = "AI") -> DataFrame:
    """(conv_id, dialogue): a conversation's turns as labelled paragraphs. A session's limit on turns bounds it."""
    line = F.concat(F.when(F.col("role") == "user", user).otherwise(other), F.lit(": "), F.col("text"))
    item = F.struct("turn", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n\n")
    return messages.filter("role <> 'system' and trim(text) <> ''").groupBy("conv_id").agg(joined.alias("dialogue"))


def discard(messages: DataFrame) -> DataFrame:
    """(conv_id, discard): no user text left, or every user turn is operational."""
    mine = (F.col("role") == "user") & (F.trim("text") != "")
    return messages.groupBy("conv_id").agg((F.coalesce(F.bool_and(F.when(mine, F.col("operational"))), F.lit(True))).alias("discard"))


def entry_class(coherence: Column, at_least: float = 0.4) -> Column:
    """Unscored entries count as reflections."""
    return F.when(coherence < at_least, "RAW_CAPTURE").otherwise("REFLECTION")


def split_turns(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Each turn with the first segment that names it (segments: conv_id, segment, turn); the rest form one more."""
    first = segments.groupBy("conv_id", "turn").agg(F.min("segment").alias("segment"))
    last = segments.groupBy("conv_id").agg(F.max("segment").alias("last"))
    both = turns.join(first, ["conv_id", "turn"], "left").join(last, "conv_id", "left")
    return both.withColumn("segment", F.coalesce("segment", F.coalesce("last", F.lit(-1)) + 1)).drop("last")


def cap_episodes(rows: DataFrame, cap: int) -> DataFrame:
    """Episodes (session, idx, text, themes, era) beyond the cap merged into the last: texts joined, themes united, first era."""
    order = F.struct("idx", "text", "themes", "era")
    merged = rows.withColumn("slot", F.least("idx", F.lit(cap - 1))).groupBy("session", "slot").agg(F.array_sort(F.collect_list(order)).alias("e"))
    eras = F.filter(F.transform("e", lambda x: x["era"]), lambda x: x.isNotNull())
    return merged.select(
        "session",
        F.col("slot").alias("idx"),
        F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("e", lambda x: x["themes"])))).alias("themes"),
        F.try_element_at(eras, F.lit(1)).alias("era"),
    )


def mint_ids(rows: DataFrame, prefix: str, day: str, group: list[str], order: list[str], episode: Column) -> DataFrame:
    """Dated ids counted up within each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("minted_id", ids.scoped_id(F.lit(prefix), F.col(day), episode, n))


def unique_slugs(rows: DataFrame, prefix: str, name: str, day: str, order: str, taken: DataFrame) -> DataFrame:
    """A slug for each row that no other row and no taken one (slug) has: the plain one, else with the day, else that with _2, _3 and so on.

    Rows choose in the order of a unique column, each the first that is free. In
    rounds every row asks for one; of those that ask for the same the first in
    order stays and the others go on to their next, which may take it from a later
    row. The rows that share a name and day are ranked in one window.
    """
    c = F.col
    base = ids.slug(prefix, c(name))
    dated = F.concat(base, F.date_format(c(day), "_yyyy_MM_dd"))
    state = cut(rows.select(c(order).alias("o"), base.alias("base"), dated.alias("dated"), F.lit(0).alias("k")).filter("base is not null"))
    gone = taken.select(c("slug")).distinct().withColumn("gone", F.lit(1))
    while True:
        asked = state.withColumn("slug", F.when(c("k") == 0, c("base")).when(c("k") == 1, c("dated")).otherwise(F.concat("dated", F.lit("_"), c("k").cast("string"))))
        place = F.row_number().over(Window.partitionBy("slug").orderBy("o"))
        same = F.row_number().over(Window.partitionBy("slug", "dated").orderBy("o"))
        asked = asked.withColumn("place", place).withColumn("same", same).join(gone, "slug", "left")
        ahead = F.when(c("gone").isNull() & (c("place") == 1), 0).when((c("k") > 0) & (c("gone").isNull()), F.greatest(c("same") - 1, F.lit(1))).otherwise(1)
        asked = cut(asked.withColumn("ahead", ahead))
        if asked.filter("ahead > 0").isEmpty():
            break
        state = asked.select("o", "base", "dated", (c("k") + c("ahead")).alias("k"))
    return rows.join(asked.select(c("o").alias(order), "slug"), order, "left")


def by_name(rows: DataFrame, name: str, known: DataFrame, canonical: str) -> DataFrame:
    """Rows joined to the record whose name has the same key; unknown names keep nulls."""
    key = text.era_key
    first = known.withColumn("_key", key(F.col(canonical))).groupBy("_key").agg(F.min(F.struct("node_id", canonical)).alias("_k"))
    return rows.withColumn("_key", key(F.col(name))).join(first, "_key", "left").withColumn("node_id", F.col("_k.node_id")).drop("_key", "_k")


def keep_known(refs: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """References to known records, and those to none."""
    return refs.join(known.select(key), key, "left_semi"), refs.join(known.select(key), key, "left_anti")


def first_writer(log: DataFrame) -> DataFrame:
    """The job that wrote each node first (seq)."""
    return log.groupBy("node_id").agg(F.min_by("job_id", "seq").alias("job_id"))


def queue_cards(items: DataFrame, proposals: DataFrame, summaries: DataFrame, now: str, resolve_days: int = 7) -> DataFrame:
    """Queue items with proposal and episode summary, their age and the days left before they resolve themselves."""
    from palimpsest.functions.temporal import quiet_days

    age = quiet_days(F.coalesce("last_snoozed_at", "created_at"), now)
    joined = items.join(proposals, "id", "left").join(summaries, "episode_id", "left")
    return joined.withColumn("age_days", age).withColumn("days_left", F.greatest(F.lit(resolve_days) - age, F.lit(0))).withColumn("stale", F.col("payload").isNull())


def offer_order(rows: DataFrame) -> DataFrame:
    """By score, the newer of two first, undated ones last."""
    return rows.orderBy(F.desc("rank_score"), F.desc_nulls_last("occurred_at"), "node_id")
