"""What a reading of an entry may keep: events, thin captures, people, grounding and who is credited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import flatten, mentions

# Rules whose breach is worth asking about once more.
RETRYABLE = ("UNKNOWN_TYPE", "UNKNOWN_ENUM_VALUE", "SIGNAL_FLOOR", "UNKNOWN_STEP_TYPE", "EMPTY_CONTENT")


def retryable(rule: Column) -> Column:
    return F.coalesce(rule.isin(*RETRYABLE), F.lit(False))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _told(quotes: Column) -> Column:
    """The quotes that aren't blank, trimmed."""
    return F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q != "")


def known_people(names: Column, text: Column) -> Column:
    """The distinct names that stand in the text; others were made up."""
    return F.array_distinct(F.filter(_told(names), lambda n: mentions(text, n)))


def quoted(quotes: Column, text: Column) -> Column:
    """Whether one of some quotes stands in the text; none at all doesn't."""
    return F.exists(_told(quotes), lambda q: mentions(text, q))


def validate_observations(rows: DataFrame, known: list[str], excluded: list[str], weighty: list[str], thin: list[str], each: int | None = None) -> DataFrame:
    """Findings of entries with the first rule each breaks (null for a good one), what stands of it, and whether it is grounded.

    rows: entry_id, pos, entry_class, text, content, type, provenance,
    signal_strength, confidence, person, quotes, resolved (names known for the
    entry). A light capture may hold the `thin` types only, any other entry all that
    are known but the excluded ones. What isn't a member of its list in capital
    letters is unknown. A person whom neither the entry's text nor its resolved
    names know goes, and `lost_person` says so; the finding stays. A finding none of
    whose quotes is in the text is marked, and stays too. Beyond `each` findings of
    an entry the others are OVER_LIMIT.
    """
    name = lambda c: F.upper(F.trim(c))
    among = lambda c, values: F.coalesce(name(F.col(c)).isin(*values), F.lit(False))
    kind = name(F.col("type"))
    permitted = F.when(F.col("entry_class") == "RAW_CAPTURE", kind.isin(*thin)).otherwise(F.lit(True))
    enums = among("provenance", ("USER_GENERATED", "CO_CREATED", "ASSISTANT")) & among("signal_strength", ("STANDARD", "HIGH", "CRITICAL")) & among("confidence", ("STANDARD", "HIGH", "LOW"))
    rule = (
        F.when(_blank(F.col("content")), "EMPTY_CONTENT").when(~among("type", known), "UNKNOWN_TYPE").when(kind.isin(*excluded), "EXCLUDED_TYPE").when(~permitted, "TYPE_NOT_ALLOWED_HERE")
        .when(~enums, "UNKNOWN_ENUM_VALUE").when(kind.isin(*weighty) & (name(F.col("signal_strength")) == "STANDARD"), "SIGNAL_FLOOR")
    )
    if each is not None:
        place = F.row_number().over(Window.partitionBy("entry_id").orderBy("pos"))
        rows, rule = rows.withColumn("_n", place), F.when(F.col("_n") > each, "OVER_LIMIT").otherwise(rule)
    there = F.exists(_told(F.col("resolved")), lambda n: (F.trim(flatten(n)) != "") & (F.trim(flatten(n)) == F.trim(flatten(F.col("person"))))) | mentions(F.col("text"), F.col("person"))
    person = F.when(~_blank(F.col("person")) & F.coalesce(there, F.lit(False)), F.trim("person"))
    return rows.select("entry_id", "pos", rule.alias("rule"), kind.alias("type"), F.trim("content").alias("content"), name(F.col("signal_strength")).alias("signal_strength"), person.alias("person"), (~_blank(F.col("person")) & person.isNull()).alias("lost_person"), quoted(F.col("quotes"), F.col("text")).alias("grounded"))


def validate_events(rows: DataFrame) -> DataFrame:
    """Events (summary, signal_strength, people, quotes, text) with the first rule broken, the people found, and whether one of the quotes is in the text.

    An event without grounding stays and is marked; a made-up person goes.
    """
    signal = F.upper(F.trim("signal_strength"))
    rule = F.when(_blank(F.col("summary")), "EMPTY_CONTENT").when(~F.coalesce(signal.isin("STANDARD", "HIGH", "CRITICAL"), F.lit(False)), "UNKNOWN_ENUM_VALUE")
    grounded = quoted(F.col("quotes"), F.col("text"))
    return rows.withColumn("rule", rule).withColumn("people", known_people(F.col("people"), F.col("text"))).withColumn("grounded", grounded)


def raw_captures(rows: DataFrame) -> DataFrame:
    """(entry_id, type, content, rule) of thin entries (entry_id, context, emotion, emotion_quote, text): the context, and a feeling only in the person's own words.

    A dropped row keeps its rule and has no content. Nothing here is asked again.
    """
    context = F.struct(F.lit("CONTEXT").alias("type"), F.when(~_blank(F.col("context")), F.trim("context")).alias("content"), F.when(_blank(F.col("context")), "EMPTY_CONTENT").alias("rule"))
    said = ~_blank(F.col("emotion_quote")) & mentions(F.col("text"), F.col("emotion_quote"))
    feeling = F.struct(F.lit("EMOTION").alias("type"), F.when(said, F.trim("emotion")).alias("content"), F.when(~said, "QUOTE_NOT_FOUND").alias("rule"))
    both = F.filter(F.array(context, F.when(~_blank(F.col("emotion")), feeling)), lambda x: x.isNotNull())
    return rows.select("entry_id", F.explode(both).alias("x")).select("entry_id", "x.*")


def credited(provenance: Column, content: Column, adopted: Column) -> Column:
    """Whose a finding is: one of the person's own that repeats wording they took over from the assistant is shared. It only ever goes that way."""
    repeats = F.exists(_told(adopted), lambda s: (F.trim(flatten(s)) != "") & F.contains(flatten(content), flatten(s)))
    return F.when((provenance == "USER_GENERATED") & repeats, "CO_CREATED").otherwise(provenance)


def failed_rows(rows: DataFrame) -> DataFrame:
    """(episode_id, node_id, status): a placeholder for each episode whose reading failed, so that it has something to hang on to."""
    return rows.filter("read_failed").select("episode_id", F.concat(F.lit("failed_"), "episode_id").alias("node_id"), F.lit("EXTRACTION_FAILED").alias("status"))


def episode_status(read_failed: Column, decided: Column, escalations: Column) -> Column:
    """COMPLETE, or SUSPENDED where the reading failed or something is held for the person; an episode that was never compared is complete."""
    return F.when(read_failed, "SUSPENDED").when(F.coalesce(decided, F.lit(True)) & (F.coalesce(escalations, F.lit(0)) == 0), "COMPLETE").otherwise("SUSPENDED")
