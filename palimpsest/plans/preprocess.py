"""Sessions to episodes as one flow: every session takes one route, and what a reply lacks is made up for without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import fingerprint, local_summary, strip_fillers, word_count
from palimpsest.operators.shaping import cap_episodes, entry_class, split_turns
from palimpsest.sources.scratch import cut

#: Routes: nothing left to read; too little to take apart; split by turns or by topics; kept whole as the reply said nothing.
ROUTES = ("DISCARD", "SHORT", "TURNS", "TOPICS", "WHOLE")

_c = F.col


def _joined(order: str, line: Column, sep: str = "\n\n") -> Column:
    """Lines of a group in order; a session's limit on turns bounds it."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), sep)


def _said(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "Me").otherwise("AI"), F.lit(": "), text)


def read(messages: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, event_date, voice, dialogue, operational, text) and the turns of the dialogues that are kept.

    A session in which the other side speaks is a dialogue: its text is the turns
    as they were written, without the person's requests (acts: session_id, turn,
    operational; a turn without a reply is no request). Else the text is what the
    person wrote, in order. `operational` says that they wrote nothing but requests.
    """
    asked = acts.groupBy("session_id", "turn").agg(F.bool_and("operational").alias("_act"))
    rows = messages.join(asked, ["session_id", "turn"], "left").withColumn("_act", F.coalesce("_act", F.lit(False)) & (_c("role") == "user"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_blank", F.trim("text") == "")
    told = ~_c("_blank") & (_c("role") != "system")
    mine = (_c("role") == "user") & ~_c("_blank")
    sides = Window.partitionBy("session_id")
    rows = rows.withColumn("dialogue", F.max(F.coalesce((_c("role") == "assistant").cast("int"), F.lit(0))).over(sides) == 1)
    kept = rows.filter(told & (~_c("dialogue") | ~_c("_act")))
    line = F.when(_c("dialogue"), _said(_c("role"), _c("text"))).when(_c("role") == "user", _c("text"))
    texts = kept.filter(_c("dialogue") | (_c("role") == "user")).groupBy("session_id").agg(_joined("turn", line).alias("text"))
    heads = rows.groupBy("session_id").agg(
        F.min("event_date").alias("event_date"), F.max(F.coalesce("voice", F.lit(False))).alias("voice"), F.max("dialogue").alias("dialogue"),
        (F.max("dialogue") & F.coalesce(F.bool_and(F.when(mine, _c("_act"))), F.lit(False))).alias("operational"),
    )
    sessions = heads.join(texts, "session_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return sessions, kept.filter("dialogue").select("session_id", "turn", _said(_c("role"), _c("text")).alias("line"))


def route(sessions: DataFrame, cleaned: DataFrame, segments: DataFrame, topics: DataFrame, turns: DataFrame, min_words: int = 30) -> DataFrame:
    """Each session with its clean text, its words, its route, and whether cleaning or splitting had to do without a reply.

    A dialogue isn't cleaned. A monologue is by its reply (cleaned: session_id,
    text); where there is none, or a blank one, it stays as it is, a spoken one
    without hesitations. A session is discarded when nothing is left or nothing but
    requests was written, which is counted, not asked.
    """
    reply = cleaned.groupBy("session_id").agg(F.min(F.when(F.trim("text") != "", F.trim("text"))).alias("_clean"))
    plain = F.when(_c("voice"), strip_fillers(_c("text"))).otherwise(_c("text"))
    out = sessions.join(reply, "session_id", "left").withColumn("_plain", plain)
    out = out.withColumn("text", F.when(_c("dialogue"), _c("text")).otherwise(F.coalesce("_clean", "_plain"))).withColumn("uncleaned", ~_c("dialogue") & _c("_clean").isNull()).drop("_clean", "_plain")
    named = segments.join(turns, ["session_id", "turn"], "left_semi").select("session_id").distinct().withColumn("_turns", F.lit(True))
    told = topics.filter(F.trim("text") != "").select("session_id").distinct().withColumn("_topics", F.lit(True))
    out = out.join(named, "session_id", "left").join(told, "session_id", "left").withColumn("words", word_count(_c("text")))
    way = (
        F.when((F.trim("text") == "") | _c("operational"), "DISCARD").when(_c("words") < min_words, "SHORT")
        .when(_c("dialogue") & _c("_turns"), "TURNS").when(~_c("dialogue") & _c("_topics"), "TOPICS").otherwise("WHOLE")
    )
    return out.withColumn("route", way).drop("_turns", "_topics")


def _pieces(routed: DataFrame, segments: DataFrame, topics: DataFrame, turns: DataFrame, cap: int) -> DataFrame:
    """(session, idx from 0, text, themes, era): by turns, by topics, or whole."""
    none = F.array().cast("array<string>").alias("themes")
    on = lambda *ways: routed.filter(_c("route").isin(*ways)).select("session_id")
    known = segments.join(turns, ["session_id", "turn"], "left_semi").join(on("TURNS"), "session_id", "left_semi")
    mine = turns.join(on("TURNS"), "session_id", "left_semi").withColumnRenamed("session_id", "conv_id")
    split = split_turns(mine, known.select(_c("session_id").alias("conv_id"), "segment", "turn"))
    about = known.groupBy(_c("session_id").alias("conv_id"), "segment").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("themes")))).alias("themes"), F.min("era").alias("era"))
    by_turn = split.groupBy("conv_id", "segment").agg(_joined("turn", _c("line")).alias("text")).join(about, ["conv_id", "segment"], "left")
    by_turn = by_turn.select(_c("conv_id").alias("session"), _c("segment").cast("long").alias("key"), "text", F.coalesce("themes", none).alias("themes"), "era")
    by_topic = topics.filter(F.trim("text") != "").join(on("TOPICS"), "session_id", "left_semi").select(_c("session_id").alias("session"), _c("idx").cast("long").alias("key"), "text", F.coalesce("themes", none).alias("themes"), "era")
    pieces = by_turn.unionByName(by_topic)
    place = F.row_number().over(Window.partitionBy("session").orderBy("key", "text")) - 1
    capped = cap_episodes(pieces.withColumn("idx", place).drop("key"), cap)
    whole = routed.filter(_c("route").isin("SHORT", "WHOLE")).select(_c("session_id").alias("session"), F.lit(0).alias("idx"), "text", none, F.lit(None).cast("string").alias("era"))
    return capped.unionByName(whole)


def preprocess(messages: DataFrame, acts: DataFrame, cleaned: DataFrame, segments: DataFrame, topics: DataFrame, scores: DataFrame, min_words: int = 30, cap: int = 12, coherent: float = 0.4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes, one for each session; episodes; and the prompts that the thin ones ask.

    messages: session_id, event_date, turn, role, text, voice. The others are
    replies, of which any may be missing: acts (session_id, turn, operational),
    cleaned (session_id, text), segments (session_id, segment, turn, themes, era)
    of dialogues, topics (session_id, idx, text, themes, era) of monologues, scores
    (session_id, episode_index from 1, coherence, prompts).

    outcomes: session_id, route, decision, words, episodes, uncleaned, unsplit.
    episodes: session_id, episode_id, episode_index, total_episodes, text,
    entry_class, coherence, themes, era, summary, text_hash. A turn that no
    segment names is in a last one, episodes beyond the cap are one, a short entry
    is a light capture, and an episode that wasn't scored is read closely with
    0.0. A session counts as a reflection if one of its episodes does.
    prompts: session_id, pos, prompt; of light captures, each once, in order.
    """
    sessions, turns = read(messages, acts)
    turns = cut(turns)
    routed = cut(route(sessions, cleaned, segments, topics, turns, min_words))
    score = scores.groupBy("session_id", "episode_index").agg(F.min_by(F.struct("coherence", "prompts"), F.struct("coherence", "prompts")).alias("s"))
    pieces = _pieces(routed, segments, topics, turns, cap).select(_c("session").alias("session_id"), (_c("idx") + 1).cast("int").alias("episode_index"), "text", "themes", "era")
    every = pieces.join(routed.select("session_id", "event_date", "route"), "session_id").join(score, ["session_id", "episode_index"], "left")
    short = _c("route") == "SHORT"
    total = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    episodes = cut(every.select(
        "session_id", F.concat(F.lit("ep_"), F.date_format("event_date", "yyyy_MM_dd"), F.format_string("_%03d", "episode_index")).alias("episode_id"), "episode_index", total.cast("int").alias("total_episodes"), "text",
        F.when(short, "RAW_CAPTURE").otherwise(entry_class(_c("s.coherence"), coherent)).alias("entry_class"), F.when(short, 0.0).otherwise(F.coalesce("s.coherence", F.lit(0.0))).alias("coherence"),
        "themes", "era", local_summary(_c("text")).alias("summary"), fingerprint(_c("text")).alias("text_hash"), "s.prompts",
    ))
    judged = episodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("episodes"), F.max((_c("entry_class") == "REFLECTION").cast("int")).alias("_close"))
    decision = F.when(_c("route") == "DISCARD", "DISCARD").when(_c("_close") == 1, "REFLECTION").otherwise("RAW_CAPTURE")
    outcomes = routed.join(judged, "session_id", "left").select("session_id", "route", decision.alias("decision"), "words", F.coalesce("episodes", F.lit(0)).alias("episodes"), "uncleaned", (_c("route") == "WHOLE").alias("unsplit"))
    asked = episodes.filter("entry_class = 'RAW_CAPTURE'").select("session_id", "episode_index", F.posexplode("prompts").alias("pos", "prompt")).filter(F.trim("prompt") != "")
    first = asked.groupBy("session_id", "prompt").agg(F.min(F.struct("episode_index", "pos")).alias("at"))
    prompts = first.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).alias("pos"), "prompt")
    return outcomes, episodes.drop("prompts"), prompts
