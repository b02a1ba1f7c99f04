"""What lies between the stages: which rows a stage gets, what it may skip, and what its rows come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.reads import retired

# How the tone of a turn is read; anything else is STABLE.
REGISTERS = ("STABLE", "ELEVATED", "LOW", "CRISIS")


def windowed_reads(records: DataFrame, start: str, end: str, lesson_days: int = 180) -> DataFrame:
    """Records (label, status, at) that a report reads: of the window, lessons from further back, and all live patterns."""
    at, first, last = F.col("at"), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    inside = (at >= first) & (at < last)
    back = (at >= F.timestamp_add("DAY", F.lit(-lesson_days), last)) & (at < last)
    return records.filter(F.when(F.col("label") == "PatternNode", ~retired(F.col("status"))).when(F.col("label") == "LessonNode", back).otherwise(inside))


def closed_loops(edges: DataFrame, window: DataFrame) -> DataFrame:
    """(loop_id) that a `closes` edge from an episode of the window leads to."""
    closing = edges.filter("edge_type = 'closes' and invalidated_at is null")
    return closing.join(window.select(F.col("episode_id").alias("from_id")).distinct(), "from_id", "left_semi").select(F.col("to_id").alias("loop_id")).distinct()


def brief(lines: DataFrame, limit: int) -> DataFrame:
    """(section, text): the lines (section, place, pos, line) of each section in order, sections in theirs as long as they fit.

    Sections and their lines are bounded by the report's caps.
    """
    texts = lines.groupBy("section", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    used = F.sum(F.length("text")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return texts.withColumn("used", used).filter(F.col("used") <= limit).select("section", "text")


def unanswered(items: DataFrame, answers: DataFrame, searches: DataFrame) -> DataFrame:
    """(item_id, refused_by): items whose search failed, and those that a reply says nothing readable about."""
    failed = searches.filter("failed").select("item_id").distinct().withColumn("_failed", F.lit(True))
    read = answers.select("item_id").distinct().withColumn("_read", F.lit(True))
    both = items.select("item_id").join(failed, "item_id", "left").join(read, "item_id", "left")
    why = F.when(F.col("_failed"), "SEARCH_FAILED").when(F.col("_read").isNull(), "UNREADABLE_ANSWER")
    return both.select("item_id", why.alias("refused_by")).filter("refused_by is not null")


def to_decide(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, node_id, place): the candidates of each finding that isn't a raw capture, those by meaning before those by structure."""
    items = findings.filter("entry_class <> 'RAW_CAPTURE'").select("item_id")
    first = candidates.groupBy("item_id", "node_id").agg(F.min(F.struct(F.when(F.col("found_by") == "SEMANTIC", 0).otherwise(1).alias("by"), "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("at", "node_id"))
    return first.join(items, "item_id", "left_semi").select("item_id", "node_id", place.alias("place"))


def anchors(children: DataFrame) -> DataFrame:
    """(episode_id, anchor_id): what may have caused a change in an episode: its first session, else its first event."""
    kinds = children.filter("label in ('SessionNode', 'EventNode')")
    rank = F.struct(F.when(F.col("label") == "SessionNode", 0).otherwise(1), "pos", "node_id")
    return kinds.groupBy("episode_id").agg(F.min_by("node_id", rank).alias("anchor_id"))


def with_anchor(episodes: DataFrame, children: DataFrame) -> DataFrame:
    """Every episode with its anchor; one without any gets a session of its own."""
    return episodes.select("episode_id").join(anchors(children), "episode_id", "left").withColumn("anchor_id", F.coalesce("anchor_id", F.concat(F.lit("ses_"), "episode_id")))


def rebuilt(messages: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, operational, text) that a reading gets: the person's own but commands, the others where there is a dialogue left.

    A conversation in which only one side speaks is a monologue.
    """
    kept = messages.filter((F.col("role") != "user") | ~F.col("operational"))
    both = Window.partitionBy("conv_id")
    sides = kept.withColumn("_me", F.max((F.col("role") == "user").cast("int")).over(both)).withColumn("_you", F.max((F.col("role") != "user").cast("int")).over(both))
    return sides.filter("_me = 1").withColumn("form", F.when(F.col("_you") == 1, "DIALOGUE").otherwise("MONOLOGUE")).drop("_me", "_you")


def prompts(episodes: DataFrame, each: int = 3) -> DataFrame:
    """(session_id, prompt): the distinct prompts of a session's raw captures, a few of each episode (prompts: array)."""
    few = episodes.filter("entry_class = 'RAW_CAPTURE'").select("session_id", F.explode(F.slice("prompts", 1, each)).alias("prompt"))
    return few.filter(F.trim("prompt") != "").distinct()


def many_dates(findings: DataFrame, group: str) -> DataFrame:
    """Sessions that hold more than one date."""
    return findings.groupBy(group).agg(F.count_distinct("event_date").alias("dates")).filter("dates > 1")


def searchable(observations: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(node_id, kind, text, episode_id) of all that a search may start from; raw captures are not among them."""
    row = lambda df, kind, text: df.select("node_id", F.lit(kind).alias("kind"), F.col(text).alias("text"), "episode_id")
    told = observations.filter("entry_class <> 'RAW_CAPTURE'")
    return row(told, "ObservationNode", "content").unionByName(row(events, "EventNode", "event_summary")).unionByName(row(sessions, "SessionNode", "summary"))


def context_block(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """(turn_id, block): what a turn's prompt is given: lines (turn_id, pos, line) under an opening, an alert, or that nothing could be looked up."""
    body = lines.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("body"))
    opening = F.when(F.col("body").isNotNull(), F.when(F.col("deferred"), "From the turn before:").otherwise("What is known:")).when(F.col("search_failed"), "Nothing could be looked up.")
    return turns.join(body, "turn_id", "left").select("turn_id", F.concat_ws("\n", opening, "body", "alert").alias("block"))


def unlocked(turns: DataFrame) -> DataFrame:
    """Each turn (session_id, day, turn, opened) with the domains opened so far that day, sorted. There are a few domains."""
    so_far = Window.partitionBy("session_id", "day").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("open", F.array_sort(F.collect_set("opened").over(so_far)))


def already_saved(episodes: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes (episode_id, fingerprint) still to be run, and those saved under another text."""
    new = episodes.join(saved.select("episode_id"), "episode_id", "left_anti")
    other = saved.select("episode_id", F.col("fingerprint").alias("_was"))
    return new, episodes.join(other, "episode_id").filter("fingerprint <> _was").drop("_was")


def batches(imports: DataFrame) -> DataFrame:
    """(batch_id, files, messages, finished_at): a batch is over when all its imports are, and then for good."""
    over = F.bool_and(F.col("status").isin("COMPLETE", "FAILED"))
    return imports.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.sum("messages").alias("messages"), F.when(over, F.max("finished_at")).alias("finished_at"))


def settle(items: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first answer (item_id, seq, choice) to each open item, and the answers to items that were settled already."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("seq"))
    ranked = answers.join(items.select("item_id", "status"), "item_id").withColumn("_n", place)
    first = (F.col("_n") == 1) & F.col("status").isin("PENDING_HITL", "SNOOZED")
    return ranked.filter(first).drop("_n", "status"), ranked.filter(~first).drop("_n", "status")


def earlier_days(days: DataFrame, before: str, keep: int = 3, lookback_days: int = 14) -> DataFrame:
    """Each user's last summarised days (user_id, day, summary) before a date, oldest first."""
    day, end = F.col("day").cast("date"), F.lit(before).cast("date")
    told = days.filter((F.trim(F.coalesce("summary", F.lit(""))) != "") & (day < end) & (day >= F.date_sub(end, lookback_days)))
    back = told.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).filter(F.col("_n") <= keep)
    return back.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))).drop("_n")


def grounded_triggers(raw: DataFrame, people: DataFrame, open_loops: DataFrame) -> DataFrame:
    """Triggers (kind, person_id) that the records bear out: a person that is known, and any open loop for what would match one."""
    known = people.select(F.col("node_id").alias("person_id")).distinct().withColumn("_known", F.lit(True))
    any_open = F.broadcast(open_loops.agg((F.count(F.lit(1)) > 0).alias("_open")))  # one row
    both = raw.join(known, "person_id", "left").join(any_open)
    there = F.when(F.col("kind") == "NAMED_PERSON", F.coalesce("_known", F.lit(False))).when(F.col("kind") == "OPEN_LOOP_MATCH", F.col("_open")).otherwise(F.lit(True))
    return both.withColumn("grounded", there).drop("_known", "_open")


def register(value: Column) -> Column:
    """The tone of a turn; what isn't known is STABLE."""
    clean = F.upper(F.trim(value))
    return F.when(clean.isin(*REGISTERS), clean).otherwise("STABLE")


def buffer_entries(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates with their stored vectors, null where there is none."""
    one = vectors.groupBy("node_id").agg(F.first("embedding").alias("embedding"))
    return candidates.join(one, "node_id", "left")


def audit_ids(erasures: DataFrame, taken: DataFrame) -> DataFrame:
    """Erasures (user_id, at) with the next free number of their day; notes (audit_id) that are there count."""
    day = F.date_format("at", "yyyy_MM_dd")
    used = taken.groupBy(F.regexp_extract("audit_id", r"^erasure_(\d{4}_\d{2}_\d{2})_\d+$", 1).alias("_day")).agg(F.max(F.regexp_extract("audit_id", r"_(\d+)$", 1).try_cast("int")).alias("_last"))
    n = F.row_number().over(Window.partitionBy("_day").orderBy("at", "user_id"))
    return erasures.withColumn("_day", day).withColumn("_n", n).join(used, "_day", "left").withColumn("audit_id", F.format_string("erasure_%s_%03d", "_day", F.col("_n") + F.coalesce("_last", F.lit(0)))).drop("_day", "_n", "_last")


def trustworthy(outcomes: DataFrame, drops: DataFrame) -> DataFrame:
    """(episode_id, trusted): not read by the fallback, nothing abandoned, nothing cut for length, and not empty."""
    cut_off = drops.groupBy("episode_id").agg(F.bool_or(F.col("rule") == "OVER_LIMIT").alias("_cut"))
    ok = ~F.col("fallback") & (F.col("abandoned") == 0) & (F.col("kept") > 0) & ~F.coalesce("_cut", F.lit(False))
    return outcomes.join(cut_off, "episode_id", "left").select("episode_id", ok.alias("trusted"))


def flat_row(df: DataFrame, key: str) -> DataFrame:
    """(key, properties): a row as a map of text, lists and structs as JSON, dates in ISO form, nulls and blanks left out."""
    kinds = dict(df.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kinds[c].startswith("timestamp") else F.col(c).cast("string")
    pairs = F.create_map(*[x for c in df.columns if c != key for x in (F.lit(c), text(c))])
    return df.select(key, F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != "")).alias("properties"))


def usable(candidates: DataFrame, own_episode: Column) -> DataFrame:
    """Candidates that aren't of the finding's own episode; one without an episode is."""
    return candidates.filter(~F.col("episode_id").eqNullSafe(own_episode))
