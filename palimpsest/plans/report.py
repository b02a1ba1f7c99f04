"""Report analytics over a window of findings.

Every function takes DataFrames with the window's bounds as arguments. Findings
carry episode_id, event_date, type, signal_strength, person and pattern_id; a
pattern counts once for each episode, however many findings point at it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import Scoring, age_band, recency_weight
from palimpsest.functions.temporal import PERIODS, due, moment, quiet_days, window_shift, window_start, within
from palimpsest.functions.text import era_key

# Decisions of these states have changed nothing.
INERT = ("ROLLED_BACK", "PENDING_HITL", "BELOW_THRESHOLD", "SUSPENDED_QUEUE_FULL", "EXTRACTION_FAILED")


def share(part: Column, whole: Column) -> Column:
    """Per cent to one place; a half goes up."""
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10.0).otherwise(0.0)


def in_window(findings: DataFrame, start: str, end: str) -> DataFrame:
    return findings.filter(within(F.col("event_date").cast("timestamp"), start, end))


def pattern_frequency(window: DataFrame) -> DataFrame:
    """Episodes of each pattern, their share of the window's, first and last day."""
    total = window.agg(F.count_distinct("episode_id").alias("total"))
    counted = window.groupBy("pattern_id").agg(F.count_distinct("episode_id").alias("episodes"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))
    joined = counted.join(F.broadcast(total))  # one row
    return joined.select("pattern_id", "episodes", share(F.col("episodes"), F.col("total")).alias("share"), "first_day", "last_day")


def top_patterns(frequency: DataFrame, n: int = 10) -> DataFrame:
    return frequency.orderBy(F.desc("episodes"), "pattern_id").limit(max(n, 1))


def emerging_patterns(window: DataFrame, patterns: DataFrame, start: str, end: str) -> DataFrame:
    """Patterns that began inside the window, with the earliest episode."""
    new = patterns.filter(within(F.col("valid_from"), start, end)).select("pattern_id", "valid_from")
    first = window.groupBy("pattern_id").agg(F.min_by("episode_id", F.struct("event_date", "episode_id")).alias("first_episode"))
    return new.join(first, "pattern_id", "left")


def disappearing_patterns(window: DataFrame, previous: DataFrame, rare: bool = False) -> DataFrame:
    """Patterns of the period before that this one doesn't have; those whose share rounds to nothing only if `rare`."""
    was = pattern_frequency(previous)
    return (was if rare else was.filter("share > 0")).join(window.select("pattern_id"), "pattern_id", "left_anti").select("pattern_id", F.col("episodes").alias("previous_episodes"), F.col("share").alias("previous_share"))


def _both(window: DataFrame, earlier: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Episodes of each pattern in either period, 0 where it has none."""
    now = window.groupBy(key).agg(F.count_distinct("episode_id").alias("now"))
    was = earlier.groupBy(key).agg(F.count_distinct("episode_id").alias("was"))
    return now.join(was, key, "full_outer").select(key, F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("was", F.lit(0)).alias("was"))


def period_delta(window: DataFrame, previous: DataFrame) -> DataFrame:
    return _both(window, previous).withColumn("delta", F.col("now") - F.col("was"))


def growth_candidate(window: DataFrame, previous: DataFrame, changed: DataFrame) -> DataFrame:
    """Of the patterns that were regulated or evolved, the one that fell most; ties by id."""
    fell = _both(window, previous).withColumn("drop", F.col("was") - F.col("now")).filter(F.col("drop") > 0)
    return fell.join(changed.select("pattern_id"), "pattern_id", "left_semi").orderBy(F.desc("drop"), "pattern_id").limit(1)


def struggle_candidate(window: DataFrame, negative: list[str]) -> DataFrame:
    """The most frequent pattern, and the findings of a negative kind in its episodes."""
    top = top_patterns(pattern_frequency(window), 1).select("pattern_id", "episodes")
    inside = window.join(F.broadcast(top), "pattern_id").select("pattern_id", "episodes", "episode_id").distinct()
    hard = window.filter(F.col("type").isin(*negative)).groupBy("episode_id").agg(F.count(F.lit(1)).alias("hard"))
    return inside.join(hard, "episode_id", "left").groupBy("pattern_id", "episodes").agg(F.coalesce(F.sum("hard"), F.lit(0)).alias("negative_findings"))


def _first_excerpts(n: int) -> Column:
    """Ids of a group's first findings in time. The aggregate holds n of them, however large the group is."""
    return F.transform(F.slice(F.array_sort(F.collect_list("_x")), 1, n), lambda x: x["node_id"])


def _excerpts(rows: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("occurred_at", "node_id")
    few = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return few.withColumn("_x", F.struct("_n", "node_id")).groupBy(key).agg(_first_excerpts(n).alias("excerpts"))


def relational_dynamics(window: DataFrame, kind: str, at_least: int = 2, excerpts: int = 3, nobody: str = "someone") -> DataFrame:
    """Findings of a kind for each person written about, with the first excerpts."""
    rows = window.filter(F.col("type") == kind).withColumn("person", F.coalesce("person", F.lit(nobody)))
    counted = rows.groupBy("person").agg(F.count(F.lit(1)).alias("findings")).filter(F.col("findings") >= at_least)
    return counted.join(_excerpts(rows, "person", excerpts), "person")


def relationship_arcs(window: DataFrame, at_least: int = 3, kinds: int = 3) -> DataFrame:
    """People in enough episodes, with the most frequent kinds of finding about them."""
    people = window.groupBy("person").agg(F.count_distinct("episode_id").alias("episodes")).filter(F.col("episodes") >= at_least)
    per_kind = window.groupBy("person", "type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("person").orderBy(F.desc("n"), "type")
    top = per_kind.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= kinds).groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "type"))), lambda x: x["type"]), ",").alias("top_kinds"))
    return people.join(top, "person")


def of_kind(window: DataFrame, kinds: list[str]) -> DataFrame:
    return window.filter(F.col("type").isin(*kinds))


def high_signal(window: DataFrame, n: int | None = 25) -> DataFrame:
    """Weighty findings in order; a report shows the first n."""
    rows = window.filter("signal_strength in ('HIGH', 'CRITICAL')").orderBy("event_date", "episode_id", "occurred_at", "node_id")
    return rows if n is None else rows.limit(n)


def links_from_kind(window: DataFrame, kind: str) -> DataFrame:
    """Findings of a kind for each pattern they point at."""
    return window.filter(F.col("type") == kind).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("links"))


def repeated_lessons(evidence: DataFrame, window: DataFrame, at_least: int = 3) -> DataFrame:
    """Lessons (lesson_id, episode_id) of which enough evidence lies in the window."""
    inside = evidence.join(window.select("episode_id"), "episode_id", "left_semi")
    return inside.groupBy("lesson_id").agg(F.count_distinct("episode_id").alias("episodes")).filter(F.col("episodes") >= at_least)


def ignored_lessons(lessons: DataFrame, evidence: DataFrame, window: DataFrame, now: str, quiet: int, n: int = 10) -> DataFrame:
    """Lessons (lesson_id, last_seen) without evidence in the window, quiet long enough; the quietest first."""
    used = evidence.join(window.select("episode_id"), "episode_id", "left_semi").select("lesson_id")
    idle = lessons.join(used, "lesson_id", "left_anti").withColumn("days", quiet_days(F.col("last_seen"), now)).filter(F.col("days") >= quiet)
    return idle.orderBy(F.desc("days"), "lesson_id").limit(n).select("lesson_id", "days")


def belief_changes(decisions: DataFrame, versions: DataFrame) -> DataFrame:
    """EVOLVE decisions with the old and the new wording; one of them must be known."""
    old = versions.select(F.col("node_id").alias("target_node_id"), F.col("statement").alias("old_statement"))
    new = versions.select(F.col("node_id").alias("new_node_id"), F.col("statement").alias("new_statement"))
    return decisions.filter("action = 'EVOLVE'").join(old, "target_node_id", "left").join(new, "new_node_id", "left").filter("old_statement is not null or new_statement is not null")


def open_loops(loops: DataFrame, closed: DataFrame, now: str, n: int = 25) -> DataFrame:
    """OPEN loops (loop_id, opened_at, status) that the window didn't close, the oldest first."""
    still = loops.filter("status = 'OPEN'").join(closed.select("loop_id"), "loop_id", "left_anti")
    return still.withColumn("days_open", quiet_days(F.col("opened_at"), now)).orderBy(F.desc("days_open"), "loop_id").limit(n)


def contradictions(rows: DataFrame, statements: DataFrame, now: str) -> DataFrame:
    """Unresolved contradictions with both statements, the id where one is unknown."""
    a = statements.select(F.col("node_id").alias("belief_a_id"), F.col("statement").alias("a"))
    b = statements.select(F.col("node_id").alias("belief_b_id"), F.col("statement").alias("b"))
    both = rows.filter("resolution_status = 'UNRESOLVED'").join(a, "belief_a_id", "left").join(b, "belief_b_id", "left")
    return both.select("node_id", F.coalesce("a", "belief_a_id").alias("statement_a"), F.coalesce("b", "belief_b_id").alias("statement_b"), quiet_days(F.col("created_at"), now).alias("days_open"))


def pattern_aging(patterns: DataFrame, now: str, config: Scoring = Scoring(), quiet: int = 180) -> DataFrame:
    """Patterns quiet for longer than that, with band, weight and whether to ask about them."""
    days = quiet_days(F.col("last_reinforced_at"), now)
    rows = patterns.select("*", days.alias("quiet_days"), age_band(days, config).alias("band"), recency_weight(F.col("last_reinforced_at"), now, config).alias("weight"))
    return rows.filter(F.col("quiet_days") > quiet).withColumn("ask", F.col("band") == "DORMANT")


def archetype_shift(window: DataFrame, earlier: DataFrame, awareness: str, at_least: int = 5) -> DataFrame:
    """How each pattern moved between two stretches, whether it belongs to the leading direction, and whether enough did.

    A pattern of equal frequency moves when more findings of the awareness kind
    point at it; steady ones are left out. Falling and better noticed patterns
    loosen, rising ones tighten; loosening leads when there are as many.
    """
    noticed = lambda rows, name: rows.filter(F.col("type") == awareness).groupBy("pattern_id").agg(F.count(F.lit(1)).alias(name))
    both = _both(window, earlier).join(noticed(window, "a_now"), "pattern_id", "left").join(noticed(earlier, "a_was"), "pattern_id", "left").fillna(0, ["a_now", "a_was"])
    trend = (
        F.when((F.col("now") == F.col("was")) & (F.col("a_now") > F.col("a_was")), "AWARENESS_INCREASING")
        .when(F.col("now") > F.col("was"), "FREQUENCY_INCREASING")
        .when(F.col("now") < F.col("was"), "FREQUENCY_DECREASING")
    )
    moved = both.withColumn("trend", trend).filter("trend is not null").withColumn("loosening", F.col("trend") != "FREQUENCY_INCREASING")
    sides = moved.agg(F.count_if("loosening").alias("loose"), F.count_if(~F.col("loosening")).alias("tight"))
    threshold = max(at_least, 2)
    joined = moved.join(F.broadcast(sides))  # one row
    detected = F.greatest("loose", "tight") >= threshold
    return joined.filter(~detected | (F.col("loosening") == (F.col("loose") >= F.col("tight")))).select("pattern_id", "trend", "now", "was", detected.alias("detected"))


def shadow_scan(decisions: DataFrame, now: str, hours: int = 48, min_decisions: int = 3, min_targets: int = 2) -> DataFrame:
    """One row: whether recent branching and contradicting decisions make a burst. Inert ones don't count, dismissed ones do."""
    start = F.timestamp_add("HOUR", F.lit(-hours), moment(now))
    recent = decisions.filter((F.col("created_at") >= start) & (F.col("created_at") < moment(now)) & F.col("action").isin("BRANCH", "CONTRADICT") & ~F.col("status").isin(*INERT))
    target = F.coalesce(F.nullif("target_node_id", F.lit("")), F.nullif("source_node_id", F.lit("")))
    sums = recent.agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct(target).alias("targets"), F.count_if(F.col("action") == "BRANCH").alias("branches"), F.count_if(F.col("action") == "CONTRADICT").alias("contradictions"))
    return sums.select(((F.col("decisions") >= max(min_decisions, 1)) & (F.col("targets") >= max(min_targets, 1))).alias("detected"), "*")


def shadow_wording(branches: Column, contradictions: Column) -> Column:
    """What a burst is called without a model."""
    return F.when((branches > 0) & (contradictions > 0), "things shifted and clashed").when(contradictions > 0, "things clashed").when(branches > 0, "things shifted").otherwise("nothing stood out")


def spread_picks(n: Column, keep: int) -> Column:
    """Evenly spread 1-based places among n, half-even rounded and distinct; all of them where there are no more."""
    last = n - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: (F.bround(last * i / (keep - 1)) + 1).cast("int"))
    return F.when(n <= keep, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array_distinct(picks))


def proof_chains(findings: DataFrame, at_least: int = 10, keep: int = 5) -> DataFrame:
    """Patterns with enough instances, one per episode: count, span, and evenly spread episodes.

    The instances of a pattern are counted by day, the picked places looked up in
    those counts, and only the days they fall on ranked, so no task sorts a pattern
    whole and nothing gathers it.
    """
    one = findings.groupBy("pattern_id", "episode_id").agg(F.min("event_date").alias("event_date"))
    days = one.groupBy("pattern_id", "event_date").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0))
    sums = days.groupBy("pattern_id").agg(F.sum("n").alias("instances"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day")).filter(F.col("instances") >= at_least)
    picks = sums.select("*", F.explode(spread_picks(F.col("instances"), keep)).alias("place"))
    there = days.withColumn("upto", upto).join(picks, "pattern_id").filter("place > upto - n and place <= upto").withColumn("_n", F.col("place") - F.col("upto") + F.col("n"))
    inside = one.join(there.select("pattern_id", "event_date").distinct(), ["pattern_id", "event_date"], "left_semi")
    ranked = inside.withColumn("_n", F.row_number().over(Window.partitionBy("pattern_id", "event_date").orderBy("episode_id")).cast("long"))
    found = there.join(ranked, ["pattern_id", "event_date", "_n"])
    return found.groupBy("pattern_id", "instances", "first_day", "last_day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "episode_id"))), lambda x: x["episode_id"]), ",").alias("samples"))


def proof_sentence(instances: Column, first_day: Column, last_day: Column) -> Column:
    days = F.datediff(last_day, first_day)
    years = F.format_string("%.1f years", days / 365.25)
    return F.concat(instances.cast("string"), F.lit(" instances over "), F.when(days >= 365, years).otherwise(F.concat(days.cast("string"), F.lit(" days"))))


def era_vocabulary(rows: DataFrame, column: str, n: int = 50) -> DataFrame:
    """Spellings grouped by their key; the most used spelling of the most used keys."""
    spelled = rows.filter(F.trim(column) != "").groupBy(F.col(column).alias("spelling")).agg(F.count(F.lit(1)).alias("n")).withColumn("key", era_key(F.col("spelling")))
    grouped = spelled.groupBy("key").agg(F.sum("n").alias("total"), F.max_by("spelling", F.struct("n", "spelling")).alias("spelling"))
    return grouped.orderBy(F.desc("total"), "key").limit(n).select("key", "spelling", "total")


def environments(window: DataFrame, kind: str, group: str) -> DataFrame:
    """Groups of findings of a kind; confident where at least half are weighty."""
    rows = window.filter(F.col("type") == kind).groupBy(group).agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("signal_strength").isin("HIGH", "CRITICAL")).alias("weighty"))
    return rows.withColumn("confident", F.col("weighty") * 2 >= F.col("findings"))


def reports_due(spark, now: str, existing: DataFrame | None = None, periods: int = 6, runs: int = 4) -> DataFrame:
    """The latest overdue windows without a report (report_type, period_start), a few of them, oldest first."""
    rows = []
    for kind, unit, grace in PERIODS:
        current = window_start(unit, moment(now))
        back = spark.range(1, periods + 1).select(F.lit(kind).alias("report_type"), window_shift(unit, current, -F.col("id").cast("int")).alias("period_start"), window_shift(unit, current, (1 - F.col("id")).cast("int")).alias("period_end"), F.lit(grace).alias("grace"))
        rows.append(back)
    every = rows[0].union(rows[1]).union(rows[2]).filter(due(F.col("period_end"), F.col("grace"), now)).drop("grace")
    if existing is not None:
        every = every.join(existing.select("report_type", "period_start"), ["report_type", "period_start"], "left_anti")
    longest = F.unix_seconds("period_end") - F.unix_seconds("period_start")
    return every.orderBy(F.desc("period_end"), F.desc(longest), F.desc("period_start")).limit(max(runs, 1)).orderBy("period_start", "report_type")


def episode_facts(findings: DataFrame) -> DataFrame:
    """Each episode with its findings as one nested record. A user's day bounds what is gathered."""
    item = F.struct("occurred_at", "node_id", "type", "signal_strength")
    return findings.groupBy("episode_id", "event_date").agg(F.array_sort(F.collect_list(item)).alias("findings"))


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, body): every row of every part as one JSON line under its section's name."""
    out = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body")) for name, df in parts.items()]
    whole = out[0]
    for df in out[1:]:
        whole = whole.union(df)
    return whole


def section_sizes(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, n): how many lines sections() has under each name, also where there are none."""
    told = [sections({name: df}).agg(F.count("body").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in parts.items()]
    return reduce(DataFrame.union, told)


def bundle(findings: DataFrame, patterns: DataFrame, decisions: DataFrame, start: str, end: str, previous_start: str, negative: list[str]) -> DataFrame:
    """All sections of a report as (section, body): one JSON line for each row of a section."""
    now, was = in_window(findings, start, end), in_window(findings, previous_start, start)
    return sections({
        "top_patterns": top_patterns(pattern_frequency(now)),
        "emerging": emerging_patterns(now, patterns, start, end),
        "disappearing": disappearing_patterns(now, was),
        "struggle": struggle_candidate(now, negative),
        "arcs": relationship_arcs(now),
        "high_signal": high_signal(now).select("node_id", "episode_id", "signal_strength"),
        "shadow": shadow_scan(decisions, end),
    })
