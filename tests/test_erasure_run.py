"""Erasure that stops and goes on, and leaves what it doesn't hit alone."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.erasure_run import CONTENTS, Erasure

AT = "2024-03-01 10:00:00"


@pytest.fixture
def store(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).withColumn("bucket", F.expr("cast(at % 4 as int)")).write.partitionBy("bucket").parquet(str(tmp_path / name))
    put("nodes", [(f"n{i}", "secret" if i % 5 else None, "Ann" if i % 2 else None, i) for i in range(12)], "node_id string, content string, person string, at int")
    put("vectors", [(f"n{i}", [1.0], i) for i in range(12)], "node_id string, embedding array<double>, at int")
    put("messages", [(f"s{i % 3}", f"word {i}", i) for i in range(9)], "session_id string, content string, at int")
    put("sessions", [(f"s{i}", "sum", i) for i in range(3)], "session_id string, rolling_summary string, at int")
    put("coreferences", [(f"s{i}", "he", i) for i in range(3)], "session_id string, ref string, at int")
    put("imports", [(f"s{i}", "title", None, i) for i in range(3)], "session_id string, title string, filename string, at int")
    put("queue", [(f"u{i % 2}", "about", i) for i in range(6)], "user_id string, context_summary string, at int")
    put("settings", [("u0", "k", 0), ("u1", "k", 1), (None, "k", 2)], "user_id string, name string, at int")
    targets = {
        "nodes": spark.createDataFrame([("n0",), ("n1",), ("n5",), ("n9",), (None,), ("n1",)], "node_id string"),
        "sessions": spark.createDataFrame([("s1",)], "session_id string"),
        "users": spark.createDataFrame([("u0",)], "user_id string"),
    }
    return Erasure(str(tmp_path)), targets, tmp_path


def rows(spark, root, name, *columns):
    return sorted(map(tuple, spark.read.parquet(str(root / name)).select(*columns).collect()), key=repr)


def test_everything_of_a_person(spark, store):
    erasure, targets, root = store
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(str(root / "nodes" / "bucket=[23]" / "*.parquet"))}
    audit = erasure.run(spark, "u0", AT, targets)
    assert audit == "erasure_2024_03_01_001"
    assert tuple(erasure.status(spark).first()) == (audit, "COMPLETE", 4, 4, 3 + 1 + 1 + 1 + 3 + 1)
    nodes = {r.node_id: r for r in spark.read.parquet(str(root / "nodes")).collect()}
    assert len(nodes) == 12 and nodes["n0"].content is None and nodes["n0"].person is None and nodes["n2"].content == "secret"
    assert nodes["n1"].content != "secret" and nodes["n1"].person == nodes["n9"].person != "Ann" and nodes["n3"].person == "Ann"
    assert before and all(os.stat(f).st_mtime_ns == t for f, t in before.items())  # partitions without a hit are the same files
    assert [r[0] for r in rows(spark, root, "vectors", "node_id")] == sorted(f"n{i}" for i in range(12) if i not in (0, 1, 5, 9))
    assert {r[1] for r in rows(spark, root, "messages", "session_id", "content") if r[0] == "s1"}.isdisjoint({"word 1", "word 4", "word 7"})
    assert rows(spark, root, "sessions", "session_id", "rolling_summary") == [("s0", "sum"), ("s1", None), ("s2", "sum")]
    assert rows(spark, root, "coreferences", "session_id") == [("s0",), ("s2",)] and not os.path.exists(root / "coreferences" / "bucket=1")
    assert rows(spark, root, "settings", "user_id") == sorted([("u1",), (None,)], key=repr)
    opened = erasure.entries(spark).filter("status = 'OPEN'").first()
    assert opened.entry_ids == ["s1"] and opened.seq == 0 and "u0" not in opened.user_id_hash


def test_one_entry_leaves_queue_and_settings(spark, store):
    erasure, targets, root = store
    erasure.run(spark, "u0", AT, targets, whole=False)
    assert len(rows(spark, root, "settings", "user_id")) == 3 and {r[0] for r in rows(spark, root, "queue", "context_summary")} == {"about"}
    assert erasure.run(spark, "u0", AT, targets, whole=False) == "erasure_2024_03_01_002"


def test_a_run_that_failed_goes_on(spark, store):
    erasure, targets, root = store
    shutil.move(root / "imports", root / "aside")
    audit = erasure.run(spark, "u0", AT, targets)
    state = lambda: {r.step: r.status for r in erasure.entries(spark).orderBy("seq").collect() if r.step}
    assert erasure.status(spark).first().status == "FAILED"
    assert {k for k, v in state().items() if v == "FAILED"} == {"uploads"} and len(state()) == 8
    placeholders = rows(spark, root, "nodes", "person")
    shutil.move(root / "aside", root / "imports")
    assert erasure.run(spark, "u0", "2030-01-01", targets, audit_id=audit) == audit
    assert erasure.status(spark).first().status == "COMPLETE" and set(state().values()) == {"DONE"}
    assert erasure.entries(spark).filter("step = 'graph'").count() == 1
    assert rows(spark, root, "nodes", "person") == placeholders
    marker = [r[0] for r in rows(spark, root, "imports", "title") if r[0] != "title"]
    assert len(marker) == 1 and "2030" not in marker[0]
    with pytest.raises(ValueError):
        erasure.run(spark, "u0", AT, targets, audit_id="erasure_2024_03_01_009")


def test_a_step_that_is_run_again_changes_nothing(spark, store):
    _, targets, root = store
    erasure = Erasure(str(root), CONTENTS[:2])
    erasure.run(spark, "u0", AT, targets)
    once = rows(spark, root, "nodes", "node_id", "content", "person")
    erasure.run(spark, "u0", AT, targets)
    assert rows(spark, root, "nodes", "node_id", "content", "person") == once
    none = {k: df.limit(0) for k, df in targets.items()}
    last = erasure.run(spark, "u9", AT, none)
    assert tuple(erasure.status(spark).filter(F.col("audit_id") == last).first()) == (last, "COMPLETE", 0, 0, 0)
