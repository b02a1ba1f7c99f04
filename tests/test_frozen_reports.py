"""Reports that a late file doesn't change, and runs by hand."""

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.streaming.frozen_reports import FrozenReports

DAY = lambda n: datetime(2024, 1, n)


def count(rows):
    return rows.groupBy("period_start").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def told(frozen, spark):
    return sorted((r.period_start.day, r.status, r.report_id, r.n) for r in frozen.reports(spark).collect())


def test_late_rows_do_not_change_a_report(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/x"
    add = lambda *rows: spark.createDataFrame(list(rows), "ts timestamp, v long").coalesce(1).write.mode("append").parquet(f"{path}/in")
    frozen = FrozenReports(f"{path}/reports", count)
    run = lambda: frozen.start(spark.readStream.schema("ts timestamp, v long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    add((DAY(1), 1), (DAY(3), 2), (None, 9))
    add((DAY(15), 3), (DAY(7), 4))  # the seventh still counts: the week closes with this batch
    run()
    assert told(frozen, spark) == [(1, "WRITTEN", "macro_weekly_2024_01_01", 3)]
    add((DAY(2), 50), (DAY(12), 6))  # the second is late, the twelfth isn't
    add((DAY(23), 7))
    run()
    first = [(1, "WRITTEN", "macro_weekly_2024_01_01", 3), (8, "WRITTEN", "macro_weekly_2024_01_08", 1)]
    assert told(frozen, spark) == [*first, (15, "WRITTEN", "macro_weekly_2024_01_15", 1)]
    assert [(r.ts, r.v) for r in frozen.late(spark).collect()] == [(DAY(2), 50)]
    assert frozen.run(spark, "2024-01-01") == "SKIPPED_EXISTING"
    assert frozen.run(spark, "2024-01-01", force=True) == "WRITTEN" == frozen.run(spark, "2024-01-01", force=True)
    assert frozen.run(spark, "2023-01-02", force=True) == "EMPTY_WINDOW"
    assert [x for x in told(frozen, spark) if x[0] == 1] == [first[0], (1, "WRITTEN", "macro_weekly_2024_01_01_r2", 4), (1, "WRITTEN", "macro_weekly_2024_01_01_r3", 4)]


def test_a_batch_that_is_run_again_and_empty_periods(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/x"
    frozen = FrozenReports(f"{path}/reports", count)
    rows = lambda *r: spark.createDataFrame(list(r), "ts timestamp, v long")
    rows((DAY(1), 1)).coalesce(1).write.parquet(f"{path}/in")
    frozen.start(spark.readStream.schema("ts timestamp, v long").parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    batch = rows((DAY(2), 2), (DAY(24), 3))
    for _ in range(2):
        frozen.batch(batch, 1)
        assert told(frozen, spark) == [(1, "WRITTEN", "macro_weekly_2024_01_01", 2), (8, "EMPTY_WINDOW", None, None), (15, "EMPTY_WINDOW", None, None)]
    frozen.batch(rows(), 2)
    frozen.batch(rows((None, 1)), 3)
    assert len(told(frozen, spark)) == 3 and frozen.late(spark).isEmpty()
