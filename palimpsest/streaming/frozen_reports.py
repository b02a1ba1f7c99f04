"""Reports of tumbling periods from a stream: written once when the grace is over, late rows kept beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FrozenReports:
    """One report for each period of a stream, never changed by what comes late.

    A period is closed when a row has been seen that is newer than its end by the
    grace. Rows of closed periods go to `late`, all others to `arrived`, in folders
    of their batch and period; a period's report is computed from what has arrived
    when it closes, by `report` (rows with period_start to one row for each
    period_start), and a period without rows between the first and the last comes
    out as EMPTY_WINDOW. A batch is written under its number and its clock last:
    one that is run again overwrites what it left, and readers take batches with a
    clock only. What reaches the driver of a batch are two times.
    """

    def __init__(self, path: str, report: Callable[[DataFrame], DataFrame], report_type: str = "WEEKLY", period: str = "7 days", offset: str = "4 days", grace: str = "1 day", at: str = "ts") -> None:
        self.path, self.report, self.report_type = path, report, report_type
        self.period, self.offset, self.grace, self.at = period, offset, grace, at

    def _end(self, start: Column) -> Column:
        return start + F.expr(f"interval {self.period}")

    def _closed(self, start: Column, clock: Column) -> Column:
        return F.coalesce(self._end(start) + F.expr(f"interval {self.grace}") <= clock, F.lit(False))

    def _written(self, spark: SparkSession, name: str, schema: str, upto: int | None = None) -> DataFrame:
        """Rows of a folder's batches: all with a clock, and the one that is being written."""
        rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        done = spark.read.schema("clock timestamp, first timestamp, batch long").parquet(f"{self.path}/clock").select("batch")
        known = rows.join(F.broadcast(done), "batch", "left_semi")  # one row for each batch
        return known if upto is None else known.filter(F.col("batch") < upto).unionByName(rows.filter(F.col("batch") == upto))

    def _id(self, start: Column) -> Column:
        return F.concat(F.lit(f"macro_{self.report_type.lower()}_"), F.date_format(start, "yyyy_MM_dd"))

    def start(self, rows: DataFrame, checkpoint: str):
        """Run over a stream of rows (the time, and any others) as far as it goes now."""
        spark = rows.sparkSession
        self.schema = rows._jdf.schema().toDDL()
        empty = spark.createDataFrame([], f"{self.schema}, period_start timestamp")
        for name in ("arrived", "late"):
            empty.write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1")
        self._outcome(self.report(empty), empty.select("period_start")).write.mode("overwrite").parquet(f"{self.path}/reports/batch=-1")
        spark.createDataFrame([(None, None)], "clock timestamp, first timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/batch=-1")
        return rows.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    def _outcome(self, reports: DataFrame, periods: DataFrame) -> DataFrame:
        own = [c for c in reports.columns if c != "period_start"]
        found = periods.join(reports.withColumn("_told", F.lit(True)), "period_start", "left")
        status = F.when(F.col("_told"), "WRITTEN").otherwise("EMPTY_WINDOW")
        return found.select(F.when(F.col("_told"), self._id(F.col("period_start"))).alias("report_id"), F.lit(self.report_type).alias("report_type"), "period_start", status.alias("status"), *own)

    def batch(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema("clock timestamp, first timestamp, batch long").parquet(f"{self.path}/clock").filter(F.col("batch") < number).agg(F.max("clock").alias("clock"), F.min("first").alias("first"))
        placed = rows.filter(F.col(self.at).isNotNull()).withColumn("period_start", F.window(self.at, self.period, startTime=self.offset)["start"]).persist()
        was = F.broadcast(before.select(F.col("clock").alias("_clock")))  # one row
        told = placed.join(was).withColumn("_late", self._closed(F.col("period_start"), F.col("_clock"))).drop("_clock")
        for name, part in (("late", told.filter("_late")), ("arrived", told.filter("not _late"))):
            part.drop("_late").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        now = placed.agg(F.max(self.at).alias("clock"), F.min("period_start").alias("first"))
        moved = before.unionByName(now).agg(F.max("clock").alias("clock"), F.min("first").alias("first"))
        old, (clock, first) = before.first()[0], moved.first()
        placed.unpersist()
        # The periods that this batch closes, from the first one on.
        periods = spark.createDataFrame([(old, clock, first)], "old timestamp, clock timestamp, first timestamp").filter("first is not null and first <= clock")
        periods = periods.withColumn("period_start", F.explode(F.sequence(F.col("first"), F.col("clock"), F.expr(f"interval {self.period}"))))
        periods = periods.filter(self._closed(F.col("period_start"), F.col("clock")) & ~self._closed(F.col("period_start"), F.col("old"))).select("period_start")
        arrived = self._written(spark, "arrived", f"{self.schema}, period_start timestamp", number).drop("batch")
        found = self.report(arrived.join(F.broadcast(periods), "period_start", "left_semi"))  # a row for each closed period
        self._outcome(found, periods).write.mode("overwrite").parquet(f"{self.path}/reports/batch={number}")
        spark.createDataFrame([(clock, first)], "clock timestamp, first timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/batch={number}")

    def reports(self, spark: SparkSession) -> DataFrame:
        """All outcomes so far; of a period that was forced, each of its reports."""
        schema = spark.read.parquet(f"{self.path}/reports/batch=-1")._jdf.schema().toDDL()
        return self._written(spark, "reports", schema).drop("batch")

    def late(self, spark: SparkSession) -> DataFrame:
        return self._written(spark, "late", f"{self.schema}, period_start timestamp").drop("batch")

    def run(self, spark: SparkSession, period_start: str, force: bool = False) -> str:
        """Report on a period by hand: SKIPPED_EXISTING if it has a report, unless forced; then a second one (_r2, _r3) with what came late."""
        start = F.lit(period_start).cast("timestamp")
        existing = self.reports(spark).filter((F.col("period_start") == start) & (F.col("status") == "WRITTEN")).count()
        if existing and not force:
            return "SKIPPED_EXISTING"
        schema = f"{self.schema}, period_start timestamp"
        every = self._written(spark, "arrived", schema).unionByName(self._written(spark, "late", schema)).drop("batch").filter(F.col("period_start") == start)
        if every.isEmpty():
            return "EMPTY_WINDOW"
        number = -2 - spark.read.schema("clock timestamp, first timestamp, batch long").parquet(f"{self.path}/clock").filter("batch < -1").count()
        again = F.lit("" if not existing else f"_r{existing + 1}")
        out = self._outcome(self.report(every), every.select("period_start").distinct()).withColumn("report_id", F.concat("report_id", again))
        out.write.mode("overwrite").parquet(f"{self.path}/reports/batch={number}")
        spark.createDataFrame([(None, None)], "clock timestamp, first timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/batch={number}")
        return "WRITTEN"
