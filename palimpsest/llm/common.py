"""Small helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scratch import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_partitions(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when a source has fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column, a few of them in memory at once; null gives no bytes.

    At the end Arrow gives back what it keeps of batches that are gone: a worker
    holds it as long as it lives, whatever runs there later.
    """
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        kind = pa.large_binary() if pa.types.is_large_string(chunk.type) else pa.binary()
        for at in range(0, len(chunk), 256):
            for x in chunk.slice(at, 256).cast(kind).to_pylist():
                yield x or b""
    pa.default_memory_pool().release_unused()


def in_pieces(batch: pa.RecordBatch, column: int | str, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many bytes in a text column each, or of one row that has more: what a task holds at once doesn't follow from the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + n_bytes, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; all others stay unread."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def held_out(doc_id):
    """Rows kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def by_hash(rows: DataFrame, key: str, total: int, at_most: int) -> DataFrame:
    """About at_most of total rows, the same ones each time, by a hash of the key; all where there are no more."""
    if total <= at_most:
        return rows
    share = int(at_most / total * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < share)


def bounded(rows: DataFrame, at_most: int) -> DataFrame:
    """Rows that a hash of ids chose, thinned again where more than twice as many came: many rows may share an id, or have none.

    What is left doesn't depend on which rows are equal, so a third of all rows
    under one id, with one text or many, are a part of the sample and not all of it.
    """
    n = rows.count()
    return rows if n <= 2 * at_most else rows.sample(at_most / n, seed=7)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int) -> DataFrame:
    """(label, text) of labelled documents that aren't held out; docs has doc_id and text.

    The sample is bounded, so its ids can be broadcast to one scan of the documents;
    and so are its rows, about 2 * at_most of them, whatever ids repeat.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    few = by_hash(known, "doc_id", known.count(), at_most)
    return bounded(docs.join(F.broadcast(few), "doc_id").select("label", "text"), at_most)


#: Row keys that may be sent to every executor (about 20 MB as rows); more of them are joined by a shuffle.
SENT_ROWS = 200_000


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: the id and the hash of the text. It is never null and sorts like the id, a null one last."""
    return F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), F.coalesce(F.md5(docs[text_col].cast("binary")), F.lit("")).alias("md5"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the rows with their key for an id."""
    return docs.select(row_key(docs, id_col, text_col).alias("doc_id"), docs[text_col].alias("text"))


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = F.broadcast(keys) if keys.count() <= SENT_ROWS else keys
    return docs.join(keys, row_key(docs) == keys["doc_id"], how)


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text and any others) that `found` keeps, one of each key.

    found has a row (doc_id: the key that keyed() gives, kept) for each row of
    docs. What goes is a row, not an id: other rows of the same id stay, and a null
    id is an id like any other. Of rows of one id and text one stays.
    """
    found = cut(found.select("doc_id", "kept"))
    left = _matched(docs, cut(found.filter("not kept").select("doc_id").distinct()), "left_anti")
    again = cut(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return _matched(left, again, "left_anti").unionByName(_matched(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))
