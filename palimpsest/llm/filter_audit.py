"""Audit of five filters: what each removes at each place of each order, from one CUBE over their failure flags."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import fill_partitions
from palimpsest.sources.scratch import cut

FILTERS = "ABCDE"
#: A set of filters is a number, one bit for each.
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
_ALL = (1 << len(FILTERS)) - 1


def failures(text: Column) -> dict[str, Column]:
    """Whether a text that isn't null fails the filters that look at it alone: A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A to E, n, good, toxic): how many documents of a part have these failures, and the labels among them.

    E: the text, known by its SHA-256, stands under a smaller id anywhere in the
    table. Texts stay in the scan: what is shuffled are ids, hashes and flags.
    Rows are counted by hash, part and flags before the hashes come together, so
    a text that makes up a third of all rows is a few rows by then; of each count
    the rows of its smallest id are known, and those of the smallest id of all pass.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    flags = list(FILTERS[:-1])
    rows = fill_partitions(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), part.alias("part")))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), *(x.alias(f) for f, x in failures(F.col("text")).items()))
    rows = rows.groupBy("id", "sha", "part", *flags).agg(F.count(F.lit(1)).alias("k"))
    # Rows without an id have no label; they are spread by their hash.
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.max((F.col("quality") == 1).cast("int")) == 1).alias("good"), (F.max((F.col("toxic") == 1).cast("int")) == 1).alias("toxic"))
    known = known.withColumn("label_key", F.struct(F.col("label_id").alias("id"), F.lit(None).cast("binary").alias("sha")))
    rows = rows.join(known, F.struct("id", F.when(F.col("id").isNull(), F.col("sha")).alias("sha")) == F.col("label_key"), "left")
    label = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    groups = rows.select("id", "sha", "part", *flags, "k", *label).groupBy("sha", "part", *flags, "good", "toxic")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k"))
    groups = groups.agg(F.sum("k").alias("n"), first.alias("first")).withColumn("who", F.struct("first.none", "first.id"))
    least = F.min("who").over(Window.partitionBy("sha"))
    alone = F.when(F.col("who") == least, F.col("first.k")).otherwise(F.lit(0).cast("long"))
    split = groups.withColumn("alone", alone).select("part", *flags, "good", "toxic", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("alone").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("alone")).alias("n")))).alias("x"))
    split = split.select("part", *flags, "x.E", "x.n", "good", "toxic").filter("n > 0")
    return split.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, tested, n, good, toxic): the documents of a part that pass all filters of the set `tested`, zeros included.

    CUBE gives the sum of every choice of flags; one whose chosen flags are all
    false counts what passes the filters that were chosen.
    """
    cube = counts.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.grouping("part").alias("whole"), *(F.grouping(f).alias(f"no_{f}") for f in FILTERS))
    passed = cube.filter("whole = 0")
    for f in FILTERS:
        passed = passed.filter(~F.coalesce(F.col(f), F.lit(False)))
    tested = sum((1 - F.col(f"no_{f}")) * bit for f, bit in _BIT.items()).cast("int")
    passed = passed.select("part", tested.alias("tested"), "n", "good", "toxic")
    sets = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("tested"))
    return sets.join(passed, ["part", "tested"], "left").fillna(0, ["n", "good", "toxic"])


def _orders(spark) -> DataFrame:
    rows = [("".join(order), k + 1, f, sum(_BIT[x] for x in order[:k])) for order in itertools.permutations(FILTERS) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, tested int")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Step k of an order applies its k-th filter to what the ones before left. What a
    step removes is the difference between the survivors of two sets of filters, so
    the 32 sets of each part are joined in pairs (a set, and it with one filter
    more: 80 of them), and the 120 orders only look pairs up. shapley sums the
    removals over the orders: a set of s filters comes before a given one in
    s! (4 - s)! of them. The documents are read once; beyond flag_counts() rows
    are bounded by the number of parts.

    labels: doc_id, quality, toxic; repeated labels of an id count as 1 if one of
    them is 1, and ids without a document count nowhere. A null text is empty and
    fails A; a null part is the empty one. Rows of one id are documents of their
    own and no copies of each other, though of any smaller id; a null id is larger
    than any other and has no label. Texts of any length are judged whole. An empty
    table gives an empty result; other columns are not read.
    """
    sets = cut(survivors(cut(flag_counts(docs, labels, id_col, text_col, part_col))))
    after = sets.select("part", F.col("tested").alias("after"), *(F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")))
    more = F.explode(F.array([F.struct(F.lit(f).alias("filter"), F.lit(bit).alias("bit")) for f, bit in _BIT.items()]))
    pairs = sets.withColumn("x", more).filter("tested & x.bit = 0").select("*", "x.filter", F.expr("tested | x.bit").alias("after")).join(after, ["part", "after"])
    times = F.element_at(F.array([F.lit(math.factorial(s) * math.factorial(4 - s)) for s in range(5)]), F.bit_count("tested") + 1)
    removed = F.col("n") - F.col("n_after")
    pairs = pairs.select("part", "tested", "after", "filter", F.col("n_after").alias("kept"), removed.alias("removed"), (F.col("good") - F.col("good_after")).alias("good_lost"), (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"), (removed * times).alias("share"))
    one = Window.partitionBy("part", "filter")
    fails = F.max(F.when(F.col("tested") == 0, F.col("removed"))).over(one)
    pairs = pairs.withColumn("redundant", fails - F.col("removed")).withColumn("unique_fails", F.max(F.when(F.col("after") == _ALL, F.col("removed"))).over(one)).withColumn("shapley", F.sum("share").over(one))
    out = pairs.join(F.broadcast(_orders(docs.sparkSession)), ["filter", "tested"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
