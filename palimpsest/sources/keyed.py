"""Records sorted by their key, with bounds of every file, so that a lookup or a page opens few of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, and bytes of a row group.
ROWS, GROUP = 1_000_000, 8 << 20
#: Ids that are looked up one by one; more of them meet the records by a join.
FEW = 1_000


@dataclass(frozen=True)
class Keyed:
    """A folder of records sorted by a key, and the table of its files: name, least and greatest key, rows."""

    path: str
    key: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/files")


def write(records: DataFrame, path: str, key: str = "node_id", rows: int = ROWS, group: int = GROUP) -> Keyed:
    """Write records in ranges of their key, about so many rows a file, each sorted and with a Bloom filter of its keys.

    The key has no null; repeated keys are kept, and may lie in two files that
    follow each other. The table of files is written last.
    """
    spark = records.sparkSession
    n = max(1, -(-records.count() // rows))
    sorted_ = records.repartitionByRange(n, key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(rows), "parquet.block.size": str(group)}
    sorted_.write.options(**options).parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file"))
    written.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/files")
    return Keyed(path, key)


def _read(spark: SparkSession, table: Keyed, files: list[str]) -> DataFrame:
    return spark.read.schema(table.rows(spark).schema).parquet(*files) if files else table.rows(spark).filter("false")


def by_ids(table: Keyed, ids: DataFrame, few: int = FEW) -> DataFrame:
    """Records in the order asked for (ids: pos, and the key); repeated ids once, unknown ones left out.

    A few ids open the files whose bounds hold one of them, and in those the row
    groups and pages that may, by bounds and Bloom filters. More ids than that are
    joined with all records.
    """
    spark, key = ids.sparkSession, table.key
    first = ids.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias("pos"))
    known = [r[key] for r in first.limit(few + 1).collect()]
    if len(known) > few:
        return table.rows(spark).join(first, key).orderBy("pos")
    wanted = spark.createDataFrame([(x,) for x in known], first.select(key).schema)
    holding = table.files(spark).join(F.broadcast(wanted), F.col(key).between(F.col("low"), F.col("high"))).select("file").distinct()  # few ids
    rows = _read(spark, table, [r.file for r in holding.collect()])
    return rows.filter(F.col(key).isin(known)).join(F.broadcast(first), key).orderBy("pos")


def by_id(table: Keyed, spark: SparkSession, value) -> DataFrame:
    """The record of an id, or no row."""
    files = table.files(spark).filter((F.col("low") <= value) & (F.col("high") >= value)).select("file").collect()
    return _read(spark, table, [r.file for r in files]).filter(F.col(table.key) == value).limit(1)


def after(table: Keyed, spark: SparkSession, cursor, limit: int) -> DataFrame:
    """Keyset page: records with keys above a cursor (or from the first), ascending.

    Files are opened from the one that the cursor is in, until those that begin
    above it hold as many rows as the page; the others aren't.
    """
    ahead = table.files(spark) if cursor is None else table.files(spark).filter(F.col("high") > cursor)
    chosen, sure = [], 0
    for f in ahead.orderBy("low", "high").toLocalIterator():
        chosen.append(f.file)
        sure += f.n if cursor is None or f.low > cursor else 0
        if sure >= limit:
            break
    rows = _read(spark, table, chosen)
    return (rows if cursor is None else rows.filter(F.col(table.key) > cursor)).orderBy(table.key).limit(limit)
