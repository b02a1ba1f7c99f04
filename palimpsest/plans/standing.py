"""What findings turned into, who they are about, what was refused, and the proofs of lessons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ids import edge_target_kind
from palimpsest.operators.graph import standing_edges
from palimpsest.operators.reads import retired
from palimpsest.plans.report import proof_chains

_c = F.col

# The links from findings to standing records that a report follows.
STANDING = (
    "same_as_obs_pat", "reinforces_obs_pat", "reinforces_obs_bel", "reinforces_evt_pat", "reinforces_evt_bel", "branches_to_obs_pat", "branches_to_obs_bel", "branches_to_evt_pat", "branches_to_evt_bel",
    "branches_to_sess_pat", "branches_to_sess_bel", "regulates_obs", "regulates_sess", "mentions_obs", "mentions_evt", "mentions_sess", "adopted_as_obs", "adopted_as_sess",
)
# The edge by which each kind of finding mentions a person, and those by which a finding became a standing record.
MENTIONS = {"ObservationNode": "mentions_obs", "EventNode": "mentions_evt", "SessionNode": "mentions_sess"}
THROUGH = {"PatternNode": ("branches_to_obs_pat", "reinforces_obs_pat", "same_as_obs_pat"), "BeliefNode": ("branches_to_obs_bel", "reinforces_obs_bel")}
# The kinds that a window's links are sorted into.
TARGET_KINDS = ("pattern", "belief", "person", "principle", "other")


def standing_links(edges: DataFrame, window: DataFrame) -> DataFrame:
    """(from_id, to_id, to_kind, edge_type): what a window's findings (node_id) turned into, by live links of the eighteen kinds; the kind of the far end is read off the link's name."""
    return standing_edges(edges, window, list(STANDING)).select("from_id", "to_id", edge_target_kind(_c("edge_type")).alias("to_kind"), "edge_type")


def sorted_targets(links: DataFrame) -> DataFrame:
    """(to_kind, targets): how many distinct records of each kind the links reach; every kind has a row, blank ids are none."""
    kinds = links.sparkSession.createDataFrame([(k,) for k in TARGET_KINDS], "to_kind string")
    found = links.filter(F.trim(F.coalesce("to_id", F.lit(""))) != "").groupBy("to_kind").agg(F.count_distinct("to_id").alias("targets"))
    return kinds.join(found, "to_kind", "left").withColumn("targets", F.coalesce("targets", F.lit(0)))


def about_person(records: DataFrame, edges: DataFrame, person: str, kinds: list[str], limit: int = 10) -> DataFrame:
    """Records (node_id, label) of some kinds that are about a person, each once, the kinds in the order asked for, then by id; `limit` in all.

    Findings mention a person by the edge of their kind, withdrawn or not. A
    pattern or a belief names none: it is about a person if a finding that
    mentions them became it by a link that is still live.
    """
    mine = edges.filter(_c("edge_type").isin(*MENTIONS.values()) & (_c("to_id") == person)).select("from_id", "edge_type").distinct()
    out = None
    for place, kind in enumerate(kinds):
        if kind in MENTIONS:
            ids = mine.filter(_c("edge_type") == MENTIONS[kind]).select(_c("from_id").alias("node_id"))
        elif kind in THROUGH:
            became = edges.filter(_c("edge_type").isin(*THROUGH[kind]) & _c("invalidated_at").isNull())
            ids = became.join(mine.select("from_id").distinct(), "from_id", "left_semi").select(_c("to_id").alias("node_id"))
        else:
            continue
        few = records.filter(_c("label") == kind).join(ids.distinct(), "node_id", "left_semi").select("node_id", "label", F.lit(place).alias("_place")).orderBy("node_id").limit(limit)
        out = few if out is None else out.unionByName(few)
    if out is None:
        return records.select("node_id", "label").filter("false")
    first = out.groupBy("node_id").agg(F.min_by("label", "_place").alias("label"), F.min("_place").alias("_place"))
    return first.orderBy("_place", "node_id").limit(limit).drop("_place")


def tallies(drops: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """(stage, rule, n): how often each rule of each stage refused something (drops: stage, rule), also those that never did; a rule that isn't known counts as itself."""
    known = drops.sparkSession.createDataFrame([(s, r) for s, names in rules.items() for r in names], "stage string, rule string")
    counted = drops.filter("rule is not null").groupBy("stage", "rule").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, ["stage", "rule"], "full").select("stage", "rule", F.coalesce("n", F.lit(0)).alias("n"))


def proofs(evidence: DataFrame, records: DataFrame, at_least: int = 10, keep: int = 5) -> DataFrame:
    """proof_chains() of any standing record: (record_id, instances, first_day, last_day, samples).

    evidence: record_id, node_id, episode_id, event_date. records: node_id, status
    of the findings. Findings that were retired, or that aren't there, prove nothing.
    """
    live = records.filter(~retired(_c("status"))).select("node_id").distinct()
    return proof_chains(evidence.join(live, "node_id", "left_semi").withColumnRenamed("record_id", "pattern_id"), at_least, keep).withColumnRenamed("pattern_id", "record_id")


def scripts(messages: DataFrame) -> DataFrame:
    """(conv_id, monologue, labelled, numbered): a conversation (conv_id, turn, role, text) as one piece of writing, as a script with its messages' numbers, and with turns counted.

    Blank messages leave no gap; the monologue is the user's alone, and null where
    they said nothing. System messages are in none. A session's limit on turns
    bounds what is gathered.
    """
    said = messages.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> '' and role <> 'system'")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    who = F.when(_c("role") == "user", "ME").otherwise("ASSISTANT")
    rows = said.withColumn("n", n).select("conv_id", F.struct("n", F.when(_c("role") == "user", _c("text")).alias("own"), F.concat(F.lit("["), "turn", F.lit("] "), "role", F.lit(": "), "text").alias("labelled"), F.concat(F.lit("["), "n", F.lit("] "), who, F.lit(": "), "text").alias("numbered")).alias("x"))
    one = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    line = lambda name, sep: F.array_join(F.transform("x", lambda x: x[name]), sep)
    return one.select("conv_id", F.nullif(line("own", "\n\n"), F.lit("")).alias("monologue"), line("labelled", "\n").alias("labelled"), line("numbered", "\n\n").alias("numbered"))


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, status, retries, entries): where each job of a log (job_id, seq, status) stands; going from FAILED to RUNNING is a retry."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    moved = log.withColumn("_again", ((before == "FAILED") & (_c("status") == "RUNNING")).cast("int"))
    return moved.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.coalesce(F.sum("_again"), F.lit(0)).alias("retries"), F.count(F.lit(1)).alias("entries"))
