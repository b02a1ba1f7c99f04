"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import id_and_text, keep_rows, keyed
from palimpsest.sources.scratch import cut

#: Runs of ASCII white space that are not one space already; a single space needs no change.
_UNEVEN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: Hashes of groups that may be sent to every executor (32 MB as plain numbers); more of them are joined by a shuffle.
SENT_GROUPS = 2_000_000


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def md5_key(text: Column) -> Column:
    """The 128-bit content hash, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=md5_key, sent_groups: int = SENT_GROUPS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Rows are grouped by the
    128-bit hash alone, about a hundred bytes a row; most hashes stand for one row
    and are settled by that. Only of hashes with more rows the texts themselves
    are fetched, in a second scan, and grouped by hash and bytes, so that two
    texts that share a hash form two groups. Copies of a text collapse on the map
    side, so a text that makes up a third of all rows crosses the shuffle once per
    task. What goes back to the rows is one narrow row for each such text, joined
    on hash and SHA-256; a hot hash is a skewed join side, which adaptive
    execution splits. Up to `sent_groups` hashes are sent to the second scan as a
    filter; beyond that they meet the texts by a shuffle.

    A null text equals the empty one; the length of a text is not bounded. Of rows
    that share the smallest id (a repeated row), all are `kept`: ids, not rows, are
    told apart. A null id never wins against another; a group of null ids only has
    a null keep_id and keeps nothing. An empty table gives an empty result; other
    columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    body = normalised(F.col("text")).alias("body")
    rows = cut(texts.select("doc_id", body).select("doc_id", key(F.col("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")))
    several = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.xxhash64("h").alias("mark")).distinct())
    several = F.broadcast(several) if several.count() <= sent_groups else several
    # Equal marks only bring more texts than needed: what is grouped below is the bytes.
    found = texts.join(several, F.xxhash64(key(normalised(texts["text"]))) == several["mark"], "left_semi")
    compared = found.select("doc_id", body).select("doc_id", "body", key(F.col("body")).alias("h"))
    groups = (
        compared.groupBy("h", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    found = rows.join(groups, ["h", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text and any others) of equal texts the one with the smallest id, with all its columns.

    Exactly one row of each text stays: of rows that share the smallest id one of
    those of the smallest hash of their bytes, where no row has an id too. Null and
    empty texts are equal. Another text under the id of a copy stays. An empty
    table gives an empty result; clashing column names don't matter.
    """
    return keep_rows(docs, exact_dedup(keyed(docs)))
