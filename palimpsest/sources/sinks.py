"""Append-only writes: nodes, edges, vectors, plans, reports and the log of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Kinds of record that can be written.
KINDS = ("EpisodeNode", "SessionNode", "EventNode", "ObservationNode", "CausalChainNode", "CausalStepNode", "PatternNode", "BeliefNode", "LessonNode", "AdoptedPrincipleNode", "OpenLoopNode", "ContradictionNode", "PersonEntityNode", "DecisionAuditNode", "MacroextractionReportNode")


def write_nodes(nodes: DataFrame, path: str, kinds: tuple[str, ...] = KINDS) -> None:
    """Append records, a folder for each kind (label); lists and structs as JSON. A kind that isn't known is refused, and nothing is written."""
    odd = nodes.filter(~F.coalesce(F.col("label").isin(*kinds), F.lit(False))).select("label").limit(1).collect()
    if odd:
        raise ValueError(f"no such kind of record: {odd[0].label}")
    nested = [c for c, kind in nodes.dtypes if kind.startswith(("array", "struct", "map"))]
    nodes.withColumns({c: F.to_json(c) for c in nested}).write.mode("append").partitionBy("label").parquet(path)


def write_report(reports: DataFrame, path: str, batch: str) -> None:
    """Reports (node_id, episode_ids and any others) with their coverage edges, as one commit."""
    commit({"reports": reports, "report_edges": coverage(reports)}, path, batch)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends exist; others are silently left out."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")


def upsert(current: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; of two of one time the new one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def delete(current: DataFrame, ids: DataFrame, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """What is left without some ids, and the rows that they named."""
    return current.join(ids.select(key), key, "left_anti"), current.join(ids.select(key), key, "left_semi")


def plan_problems(nodes: DataFrame, edges: DataFrame, existing: DataFrame) -> DataFrame:
    """(problem, id) of a write plan: ids planned twice or there already, edges with an unknown end."""
    twice = nodes.groupBy("node_id").count().filter("count > 1").select(F.lit("duplicate").alias("problem"), F.col("node_id").alias("id"))
    there = nodes.join(existing.select("node_id"), "node_id", "left_semi").select(F.lit("exists").alias("problem"), F.col("node_id").alias("id")).distinct()
    known = nodes.select("node_id").union(existing.select("node_id")).distinct()
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    loose = ends.join(known, "node_id", "left_anti").select(F.lit("unknown end").alias("problem"), F.col("node_id").alias("id"))
    return twice.union(there).union(loose)


def write_log(job_id: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, at: Column) -> DataFrame:
    """One row for each node, edge and vector of a commit."""
    none = F.lit(None).cast("string")
    row = lambda df, target, **c: df.select(F.lit(job_id).alias("job_id"), F.lit(target).alias("target"), *[c.get(n, none).alias(n) for n in ("node_id", "edge_type", "from_id", "to_id")], at.alias("written_at"))
    c = F.col
    return row(nodes, "GRAPH_NODE", node_id=c("node_id")).union(row(edges, "GRAPH_EDGE", edge_type=c("edge_type"), from_id=c("from_id"), to_id=c("to_id"))).union(row(vectors, "VECTOR", node_id=c("node_id")))


def missing_entries(written: DataFrame) -> DataFrame:
    """Nodes of a write log that have no vector."""
    return written.filter("target = 'GRAPH_NODE'").select("node_id").distinct().join(written.filter("target = 'VECTOR'").select("node_id"), "node_id", "left_anti")


def coverage(reports: DataFrame) -> DataFrame:
    """One analyzed_in edge per distinct episode of each report (node_id, episode_ids)."""
    return reports.select(F.explode(F.array_distinct("episode_ids")).alias("from_id"), F.col("node_id").alias("to_id")).withColumn("edge_type", F.lit("analyzed_in"))


def commit(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """Write the tables of a plan under one batch folder, then its marker; readers take marked batches only."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/_committed")


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of the committed batches of a table."""
    done = spark.read.parquet(f"{path}/_committed").select(F.col("batch").cast("string").alias("batch")).distinct()
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("string")).join(done, "batch", "left_semi")


def adopt(source: DataFrame, target_exists: bool, path: str) -> bool:
    """Copy an old collection, unless the target holds rows already."""
    if target_exists:
        return False
    source.write.mode("errorifexists").parquet(path)
    return True


def migrate(source: DataFrame, path: str, width: int, key: str = "node_id", pages: int = 8) -> DataFrame:
    """Copy a collection of vectors (key, embedding and any others) page by page, and say what came of it: one row of page, copied, nameless.

    Pages are ranges of the key's hash, each a folder of its own that is
    overwritten as a whole: a copy that stopped goes on with the pages that have no
    row in `_pages`, and a page that holds fewer rows than it should is an error
    and gets none. Vectors without a key are left out and counted; one of another
    width than the target's is refused before anything is written.
    """
    spark = source.sparkSession
    named = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
    odd = source.filter(named & (F.coalesce(F.size("embedding"), F.lit(-1)) != width)).select(F.size("embedding").alias("n")).limit(1).collect()
    if odd:
        raise ValueError(f"the target holds vectors of width {width}, the source one of {odd[0].n}")
    schema = "page int, copied long, nameless long"
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/_pages")
    done = {r.page for r in spark.read.schema(schema).parquet(f"{path}/_pages").collect()}  # a row for each page
    paged = source.withColumn("_page", F.coalesce(F.pmod(F.xxhash64(key), F.lit(pages)), F.lit(0)).cast("int"))
    wanted = {r["_page"]: r for r in paged.groupBy("_page").agg(F.count_if(named).alias("named"), F.count_if(~named).alias("nameless")).collect()}
    for page in sorted(set(range(pages)) - done):
        folder, want = f"{path}/rows/page={page}", wanted.get(page)
        paged.filter((F.col("_page") == page) & named).drop("_page").write.mode("overwrite").parquet(folder)
        copied = spark.read.parquet(folder).count()
        if want and copied != want.named:
            raise ValueError(f"page {page} holds {copied} rows of {want.named}")
        spark.createDataFrame([(page, copied, want.nameless if want else 0)], schema).coalesce(1).write.mode("append").parquet(f"{path}/_pages")
    return spark.read.schema(schema).parquet(f"{path}/_pages")
