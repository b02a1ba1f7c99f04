"""Erasure as a run that can stop and go on: a record first, steps apart from each other, and only the partitions that are hit rewritten."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ids import user_hash
from palimpsest.functions.text import erased, erased_person
from palimpsest.sources.scratch import cut

_c = F.col
#: Ids of entries that a record names.
MOST_NAMED = 100


@dataclass(frozen=True)
class Content:
    """What one kind of content loses: `texts` become the marker, `names` placeholders, `blank` null, or its rows go.

    `by` names the column that the targets of the step's `scope` (nodes, sessions
    or users) are matched with; `partition` the column that its folders are made
    of. `whole_only`: left alone where one entry is erased.
    """

    name: str
    folder: str
    scope: str
    by: str
    partition: str
    texts: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    blank: tuple[str, ...] = ()
    rows_go: bool = False
    whole_only: bool = False


#: Everything that holds a person's words, in the order in which it goes.
CONTENTS = (
    Content("graph", "nodes", "nodes", "node_id", "bucket", texts=("content",), names=("person",)),
    Content("index", "vectors", "nodes", "node_id", "bucket", rows_go=True),
    Content("messages", "messages", "sessions", "session_id", "bucket", texts=("content",)),
    Content("summaries", "sessions", "sessions", "session_id", "bucket", blank=("rolling_summary",)),
    Content("coreference notes", "coreferences", "sessions", "session_id", "bucket", rows_go=True),
    Content("uploads", "imports", "sessions", "session_id", "bucket", texts=("title", "filename")),
    Content("review queue", "queue", "users", "user_id", "bucket", texts=("context_summary",), whole_only=True),
    Content("settings", "settings", "users", "user_id", "bucket", rows_go=True, whole_only=True),
)

_LOG = "audit_id string, user_id_hash string, scope string, step string, status string, rows long, reason string, entry_ids array<string>, erased_at timestamp, seq long"


def _placeholder(name: Column) -> Column:
    """The same however often it is asked for: a step that stopped halfway is run again over what it wrote."""
    return F.when(name.rlike("^person_[0-9a-f]{8}$"), name).otherwise(erased_person(name))


def _folder(spark: SparkSession, name: str):
    """A folder's path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class Erasure:
    """Erasures of a store: folders of Parquet, partitioned, under one root, and a log that is only added to.

    The log's first row of a run is OPEN, written before any of the work; a step
    that did its work adds DONE with the rows it changed, one that didn't FAILED
    with the reason, and the run ends COMPLETE, or FAILED if a step did. A failed
    step keeps none of the others from running. run() with the id of a run that
    failed, or was cut off, does the steps that aren't DONE, under the moment the
    erasure was asked for.

    A step reads the partitions in which something is hit, writes them to the
    shared folder, and overwrites those alone; one that is left without rows is
    removed. Keys, edges and dates stay, and nulls stay null. Targets are
    DataFrames of any size; what reaches the driver are names of partitions.
    """

    root: str
    contents: tuple[Content, ...] = CONTENTS

    def _note(self, spark: SparkSession, **row) -> None:
        names = [c.split()[0] for c in _LOG.split(", ")]
        spark.createDataFrame([tuple(row.get(n) for n in names)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_erasures")

    def entries(self, spark: SparkSession) -> DataFrame:
        """The log, in no order (seq has it)."""
        path, there = _folder(spark, f"{self.root}/_erasures")
        return spark.read.schema(_LOG).parquet(f"{self.root}/_erasures") if there.exists(path) else spark.createDataFrame([], _LOG)

    def _next_id(self, spark: SparkSession, at: str) -> str:
        day = at[:10].replace("-", "_")
        last = self.entries(spark).filter(_c("audit_id").startswith(f"erasure_{day}_")).agg(F.max(F.regexp_extract("audit_id", r"_(\d+)$", 1).cast("int"))).first()[0]
        return f"erasure_{day}_{(last or 0) + 1:03d}"

    def run(self, spark: SparkSession, user_id: str, at: str, targets: dict[str, DataFrame], whole: bool = True, audit_id: str | None = None) -> str:
        """Erase and say how it ended; targets: nodes (node_id), sessions (session_id) and users (user_id)."""
        mine = self.entries(spark).filter(_c("audit_id") == audit_id).collect() if audit_id else []  # a row for each step
        if audit_id and not mine:
            raise ValueError(f"no such erasure: {audit_id}")
        if mine:
            at, whole = min(str(r.erased_at) for r in mine), mine[0].scope == "ALL"
        else:
            audit_id = self._next_id(spark, at)
        seq = count(self.entries(spark).count())
        row = {"audit_id": audit_id, "user_id_hash": spark.range(1).select(user_hash(F.lit(user_id))).first()[0], "scope": "ALL" if whole else "ENTRY", "erased_at": spark.sql(f"SELECT TIMESTAMP '{at}'").first()[0]}
        if not mine:
            named = [str(r[0]) for r in targets["sessions"].select("session_id").distinct().orderBy("session_id").limit(MOST_NAMED).collect()]
            self._note(spark, **row, seq=next(seq), status="OPEN", entry_ids=named)
        done, failed = {r.step for r in mine if r.status == "DONE"}, 0
        for content in self.contents:
            if content.name in done or (content.whole_only and not whole):
                continue
            try:
                self._note(spark, **row, seq=next(seq), step=content.name, status="DONE", rows=self._step(spark, content, targets[content.scope], at))
            except Exception as e:  # one step that can't be done keeps no other from its work, and the log says why
                failed += 1
                self._note(spark, **row, seq=next(seq), step=content.name, status="FAILED", reason=f"{type(e).__name__}: {e}"[:200])
        status = "FAILED" if failed else "COMPLETE"
        self._note(spark, **row, seq=next(seq), status=status)
        return audit_id

    def _step(self, spark: SparkSession, content: Content, targets: DataFrame, at: str) -> int:
        path, part = f"{self.root}/{content.folder}", content.partition
        rows = spark.read.parquet(path)
        asked = targets.select(_c(targets.columns[0]).alias("_t")).filter("_t is not null").distinct()
        told = rows.join(asked.withColumn("_hit", F.lit(True)), rows[content.by] == _c("_t"), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).drop("_t")
        counts = told.groupBy(part).agg(F.count_if("_hit").alias("n"), F.count(F.lit(1)).alias("total")).filter("n > 0").collect()  # one row for each partition that is hit
        if not counts:
            return 0
        touched = told.filter(_c(part).isin([r[part] for r in counts]))
        mark = F.lit(at).cast("timestamp")
        if content.rows_go:
            left = touched.filter("not _hit")
        else:
            gone = lambda c: _c("_hit") & _c(c).isNotNull()
            new = {c: F.when(gone(c), erased(mark)).otherwise(_c(c)) for c in content.texts}
            new |= {c: F.when(gone(c), _placeholder(_c(c))).otherwise(_c(c)) for c in content.names}
            new |= {c: F.when(~_c("_hit"), _c(c)) for c in content.blank}
            left = touched.withColumns(new)
        left = cut(left.select(*rows.columns))
        left.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        for r in counts:
            if content.rows_go and r.n == r.total:
                folder, there = _folder(spark, f"{path}/{part}={r[part]}")
                there.delete(folder, True)
        return sum(r.n for r in counts)

    def status(self, spark: SparkSession) -> DataFrame:
        """(audit_id, status, records_anonymized, embeddings_deleted, other_rows): each run as its last row says; OPEN if none does."""
        e = self.entries(spark)
        done = lambda *steps: F.coalesce(F.sum(F.when((_c("status") == "DONE") & _c("step").isin(*steps), _c("rows"))), F.lit(0))
        every = F.coalesce(F.sum(F.when((_c("status") == "DONE") & ~_c("step").isin("graph", "index"), _c("rows"))), F.lit(0))
        return e.groupBy("audit_id").agg(F.max_by(F.when(_c("step").isNull(), _c("status")), F.when(_c("step").isNull(), _c("seq"))).alias("status"), done("graph").alias("records_anonymized"), done("index").alias("embeddings_deleted"), every.alias("other_rows"))
