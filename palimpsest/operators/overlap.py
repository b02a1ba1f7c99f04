"""Texts that repeat each other: a prefix-filtered join on content words."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import content_words
from palimpsest.sources.scratch import cut


def overlap_dups(rows: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, overlap): pairs of rows (id, text), a below b, whose distinct content words overlap so far: shared words over the smaller set.

    Words are ordered by the number of rows that have them. The smaller set of a
    pair that reaches the threshold must share one of its rarest words, its prefix,
    so those are joined with all words of sets as large or larger, and only pairs
    that meet there are compared. A frequent word is in no prefix but of sets that
    have no rarer ones. Rows without content words are in no pair.
    """
    hundredths = math.ceil(100 * at_least - 1e-9)
    sets = cut(rows.select("id", content_words(F.col("text")).alias("words")).withColumn("size", F.size("words")).filter("size > 0"))
    words = sets.select("id", "size", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.join(often, "word").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("n", "word")))
    prefix = ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * hundredths / 100) + 1).select(F.col("id").alias("small"), F.col("size").alias("least"), "word")
    met = prefix.join(words, "word").filter("least < size or (least = size and small < id)").select("small", F.col("id").alias("large")).distinct()
    a, b = (sets.select(F.col("id").alias(end), F.col("words").alias(f"{end}_words")) for end in ("small", "large"))
    shared = F.size(F.array_intersect("small_words", "large_words"))
    found = met.join(a, "small").join(b, "large").withColumn("overlap", shared / F.size("small_words")).filter(100 * shared >= hundredths * F.size("small_words"))
    return found.select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"), "overlap")
