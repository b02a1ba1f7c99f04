"""From answers to rows: reading a model's answer, standing records, people, frozen variants and an episode's plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.operators.shaping import promotion
from palimpsest.plans.decisions import ACTION_EDGES, THRESHOLDS, possible

ACTIONS = (*THRESHOLDS, "AMBIGUOUS")


def read_action(name: Column) -> Column:
    """A known action in upper case, else null."""
    clean = F.upper(F.trim(name))
    return F.when(clean.isin(*ACTIONS), clean)


def clamp(confidence: Column) -> Column:
    return F.greatest(F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def interpret(proposals: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers (item_id, action, confidence, target) as decisions, read but not judged.

    A second opinion (verdicts: item_id, confirmed, action, confidence, target)
    that doesn't confirm the first replaces it whole, confidence too. An action
    that isn't known is refused and recorded as a BRANCH. A target counts only if
    it was offered (candidates: item_id, node_id, node_type).
    """
    v = verdicts.select("item_id", "confirmed", *[F.col(c).alias(f"_{c}") for c in ("action", "confidence", "target")])
    both = proposals.join(v, "item_id", "left").withColumn("escalated", F.col("confirmed").isNotNull())
    second = F.coalesce(~F.col("confirmed"), F.lit(False))
    both = both.select("item_id", "escalated", *[F.when(second, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("action", "confidence", "target")])
    offered = candidates.select("item_id", F.col("node_id").alias("target"), "node_type").distinct()
    read = both.join(offered, ["item_id", "target"], "left")
    action = read_action(F.col("action"))
    return read.select(
        "item_id", "escalated", F.coalesce(action, F.lit("BRANCH")).alias("action"), clamp(F.col("confidence")).alias("confidence"),
        F.when(F.col("node_type").isNotNull(), F.col("target")).alias("target_node_id"), F.col("node_type").alias("target_type"),
        F.when(action.isNull(), "UNKNOWN_ACTION").alias("refused_by"),
    )


def standing_records(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, label, node_id, text): the lasting record that an item (item_id, kind, text, at) has earned; most have none.

    A belief or a pattern follows from its kind; an open question is kept only if
    something like it was found before (candidates: item_id).
    """
    target = promotion(F.col("kind"))
    again = candidates.select("item_id").distinct().withColumn("_again", F.lit(True))
    label = F.when(target == "BELIEF", "BeliefNode").when(target == "PATTERN", "PatternNode").when((target == "OPEN_LOOP") & F.col("_again"), "OpenLoopNode")
    prefix = F.when(label == "BeliefNode", "bel_").when(label == "PatternNode", "pat_").otherwise("loop_")
    return items.join(again, "item_id", "left").withColumn("label", label).filter("label is not null").select("item_id", "label", F.concat(prefix, ids.slug("", F.col("text"))).alias("node_id"), "text", "at")


def contradicting_belief(belief: DataFrame, contradiction_id: Column) -> DataFrame:
    """The newer half of a clash: written knowing of it, while the older record stays as it is."""
    return belief.withColumn("is_contradicted", F.lit(True)).withColumn("contradiction_node_id", contradiction_id)


def people(mentions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New people, people to touch, and mention edges of an entry's findings (entry_id, pos, node_id, name, at).

    Spellings that differ in case are one person, in the spelling that came first;
    each finding and person are linked once.
    """
    named = mentions.withColumn("name", F.trim("name")).filter("name <> ''").withColumn("key", F.lower("name"))
    first = named.groupBy("entry_id", "key").agg(F.min_by("name", F.struct("pos", "node_id")).alias("name"), F.min("at").alias("at"))
    one = first.withColumn("node_id", ids.slug("person_", F.col("name"))).filter("node_id is not null")
    there = known.select("node_id").distinct()
    new = one.join(there, "node_id", "left_anti").groupBy("node_id").agg(F.min_by("name", F.struct("at", "entry_id")).alias("canonical_name"), F.min("at").alias("first_mentioned_at"))
    touched = one.join(there, "node_id", "left_semi").groupBy("node_id").agg(F.max("at").alias("at"))
    ends = one.select("entry_id", "key", F.col("node_id").alias("to_id"))
    edges = named.join(ends, ["entry_id", "key"]).select(F.lit("mentions_person").alias("edge_type"), F.col("node_id").alias("from_id"), "to_id").distinct()
    return new, touched, edges


def decided_by(notes: DataFrame) -> DataFrame:
    """An edge from each record of a decision to its audit note (decision_id, source_node_id, target_node_id), each once."""
    end = F.explode(F.array_distinct(F.filter(F.array("source_node_id", "target_node_id"), lambda x: x.isNotNull())))
    return notes.select(F.lit("decided_by").alias("edge_type"), end.alias("from_id"), F.col("decision_id").alias("to_id"))


def frozen(held: DataFrame) -> DataFrame:
    """(decision_id, worth_asking, primary, runner_up, fallback): what each answer to a held decision would write, as JSON.

    The fallback records the finding apart. A question is worth asking only if one
    of its answers adds an edge.
    """
    name = lambda action: F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_EDGES.items() for x in kv]), action)
    one = lambda action: F.when(action.isNotNull() & possible(action, F.col("source_type"), F.col("target_type"), F.col("standing")), F.to_json(F.struct(action.alias("action"), name(action).alias("edge_type"), F.col("source_node_id").alias("from_id"), F.col("target_node_id").alias("to_id"))))
    tied = F.coalesce(F.col("tied_action"), F.col("action"))
    variants = held.select("decision_id", one(tied).alias("primary"), one(F.col("runner_up_action")).alias("runner_up"), F.to_json(F.struct(F.lit("BRANCH").alias("action"), F.col("source_node_id").alias("from_id"))).alias("fallback"))
    return variants.withColumn("worth_asking", F.col("primary").isNotNull() | F.col("runner_up").isNotNull())


def resolve(proposals: DataFrame, choices: DataFrame, records: DataFrame) -> DataFrame:
    """Held decisions with the variant that was chosen (choices: decision_id, choice, at), and whether it still holds.

    A choice is PRIMARY, RUNNER_UP or NEITHER (the fallback). One whose records
    were superseded meanwhile (records: node_id, status) is stale and writes nothing.
    """
    picked = F.when(F.col("choice") == "PRIMARY", F.col("primary")).when(F.col("choice") == "RUNNER_UP", F.col("runner_up")).otherwise(F.col("fallback"))
    chosen = proposals.join(choices, "decision_id").withColumn("variant", picked)
    target = F.get_json_object("variant", "$.to_id")
    gone = records.filter("status in ('SUPERSEDED', 'SUSPENDED')").select(F.col("node_id").alias("_to")).distinct()
    out = chosen.withColumn("_to", target).join(gone.withColumn("_gone", F.lit(True)), "_to", "left")
    stale = F.coalesce("_gone", F.lit(False))
    return out.select("decision_id", "choice", stale.alias("stale"), F.when(~stale, F.col("variant")).alias("variant"), F.when(~stale, F.concat(F.lit("note_"), "decision_id")).alias("note_id"), "at")


def compose(episodes: DataFrame, children: DataFrame, steps: DataFrame, failed: DataFrame) -> DataFrame:
    """The edges of episodes (episode_id, user_id, seq, at, committed): containment, chain steps, failed readings and order.

    children: episode_id, node_id, label. steps: episode_id, chain_id, node_id; a
    step of a chain that its episode doesn't have is dropped. failed: episode_id,
    node_id. An episode follows the last one of its user that was committed.
    """
    c = F.col
    row = lambda df, name, a, b: df.select(F.lit(name).alias("edge_type") if isinstance(name, str) else name.alias("edge_type"), c(a).alias("from_id"), c(b).alias("to_id"))
    kind = F.when(c("label") == "CausalChainNode", "contains_chain").when(c("label") == "EventNode", "contains_event").when(c("label") == "SessionNode", "contains_session").otherwise("contains_obs")
    chains = children.filter("label = 'CausalChainNode'").select("episode_id", c("node_id").alias("chain_id"))
    before = F.last(F.when(c("committed"), c("episode_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    order = episodes.withColumn("previous", before).filter("previous is not null")
    return (
        row(children, kind, "episode_id", "node_id")
        .unionByName(row(steps.join(chains, ["episode_id", "chain_id"], "left_semi"), "chain_contains", "chain_id", "node_id"))
        .unionByName(row(failed, "failed_extraction", "episode_id", "node_id"))
        .unionByName(row(order, "follows_from", "episode_id", "previous"))
        .distinct()
    )
