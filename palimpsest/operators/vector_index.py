"""An inverted-file index of vectors: cells around centres, short codes to choose by, exact scores to rank by."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.vectors import SENT_QUERIES, cosine, norm
from palimpsest.sources.scratch import cut

#: Centres are sent to every task: at most so many, 50 MB at a width of 768.
MOST_CELLS = 16_384
#: Vectors of a file; a larger cell is several slices.
SLICE = 50_000
#: Queries of one cell that meet a slice at once.
BLOCK = 4_096
#: Vectors that a task scores at once, against QUERIES_AT_ONCE queries or all centres.
ROWS_AT_ONCE = 2_048
QUERIES_AT_ONCE = 256
#: The cell of what has no direction or another width.
OUTSIDE = -1


@dataclass(frozen=True)
class VectorIndex:
    """Where the index lies, its centres (unit length), the widest angle in each cell, slices of each, and how many cells a search probes."""

    path: str
    key: str
    key_type: str
    centres: np.ndarray
    radius: np.ndarray
    slices: np.ndarray
    probes: int = 16

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors): the rows of that width that have a direction."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    length = np.sqrt((flat * flat).sum(axis=1))
    ok = np.isfinite(length) & (length > 0)
    return rows[ok], flat[ok] / length[ok, None]


def _centres(vectors: DataFrame, key: str, cells: int, sample: int) -> np.ndarray:
    """Centres of a bounded sample, drawn by the hash of the id."""
    e = F.col("embedding")
    usable = vectors.filter((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull()) & (norm(e) > 0))
    width, total = usable.groupBy(F.size(e).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).first() or (0, 0)
    if not total:
        return np.zeros((0, 0))
    few = usable.filter(F.size(e) == width)
    if total > sample:
        few = few.filter(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    few = cut(few.limit(2 * sample).select(array_to_vector(e.cast("array<double>")).alias("features")))
    if few.isEmpty():
        return np.zeros((0, 0))
    found = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=10, seed=1).fit(few)
    centres = np.array(found.clusterCenters(), np.float64)
    length = np.sqrt((centres * centres).sum(axis=1))
    return centres[length > 0] / length[length > 0, None]


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each vector with its cell, the cosine to its centre, and its residual as a byte for each dimension and a scale."""
    names = [*vectors.columns, "cell", "near", "code", "scale"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cell, near, scale = np.full(n, OUTSIDE, np.int32), np.zeros(n), np.zeros(n, np.float32)
            code: list[bytes | None] = [None] * n
            if len(centres):
                rows, unit = _units(batch.column("embedding"), centres.shape[1])
                likeness = unit @ centres.T
                best = likeness.argmax(axis=1)
                rest = unit - centres[best]
                widest = np.abs(rest).max(axis=1, initial=0)
                step = np.where(widest > 0, widest / 127, 1)
                bytes_ = np.rint(rest / step[:, None]).astype(np.int8)
                cell[rows], near[rows], scale[rows] = best, likeness[np.arange(len(rows)), best], step
                for r, row in zip(rows.tolist(), bytes_, strict=True):
                    code[r] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near), pa.array(code, pa.binary()), pa.array(scale)], names)

    return vectors.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes) + ", cell int, near double, code binary, scale float")


def _probes_for(spark: SparkSession, index: VectorIndex, k: int, recall: float, most: int) -> int:
    """The fewest cells in which that share of the k nearest of some indexed vectors lies, found by the exact way; at most `most` vectors ask."""
    rows = index.rows(spark).filter(F.col("cell") >= 0)
    total = rows.count()
    some = rows.filter(F.pmod(F.xxhash64(index.key, F.lit(9)), F.lit(1 << 30)) < int(min(1.0, most / max(total, 1)) * (1 << 30))).limit(most)
    asked = cut(some.select(F.col(index.key).alias("query_id"), "embedding"))
    near = search(index, asked, k + 1, probes=8, exact=True).filter(F.col(index.key) != F.col("query_id"))
    held = rows.select(index.key, "cell").join(F.broadcast(near), index.key).select("query_id", "cell").toArrow()  # at most (k + 1) * most rows
    queries = asked.toArrow()
    if not len(held):
        return 16
    rows_, unit = _units(queries["embedding"].combine_chunks(), index.centres.shape[1])
    place = np.argsort(np.argsort(-np.where(index.slices > 0, unit @ index.centres.T, -2), axis=1, kind="stable"), axis=1)
    at = {q: i for i, q in enumerate(queries["query_id"].take(pa.array(rows_)).to_pylist())}
    ranks = np.sort([place[at[q], c] for q, c in zip(held["query_id"].to_pylist(), held["cell"].to_pylist(), strict=True)])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def build(vectors: DataFrame, path: str, key: str = "node_id", cells: int | None = None, sample: int = 50_000, k: int = 10, recall: float = 0.95, asks: int = 200) -> VectorIndex:
    """Write the index of all vectors (key, embedding and any others) to a new folder.

    The centres are those of a sample of about `sample` vectors; every vector is
    indexed. There are as many cells as the square root of the vectors, MOST_CELLS
    at most, unless `cells` says. A cell is a folder of files of about SLICE
    vectors, dealt by the hash of the key and sorted by it, so a cell that holds a
    third of all vectors is many files. Vectors without a direction or of another
    width than most are kept in a cell of their own (-1), which no search probes:
    their score is 0. How many cells a search probes is measured: as many as hold
    `recall` of the k nearest of `asks` of the vectors (16 if none asks). Where vectors come in
    clusters that is a few; where they are scattered at random it is half of them.
    The table of cells is written last; a folder without it is no index.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    centres = _centres(vectors, key, min(cells or max(2, int(n**0.5)), MOST_CELLS), sample)
    placed = cut(_assigned(vectors, centres))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))
    sizes = cut(sizes.select("cell", "n", "near", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")))  # one row for each cell
    dealt = placed.join(F.broadcast(sizes.select("cell", "slices")), "cell").withColumn("slice", F.pmod(F.xxhash64(key), F.col("slices")).cast("int"))
    dealt = dealt.drop("near", "slices").repartition("cell", "slice").sortWithinPartitions("cell", "slice", key)
    dealt.write.partitionBy("cell").option("maxRecordsPerFile", 4 * SLICE).parquet(f"{path}/vectors")
    known = {r.cell: r for r in sizes.collect()}
    rows = [(i, [float(x) for x in c], float(np.arccos(np.clip(known[i].near, -1, 1))) if i in known else 0.0, known[i].slices if i in known else 0) for i, c in enumerate(centres)]
    key_type = dict(vectors.dtypes)[key]
    index = VectorIndex(path, key, key_type, centres, np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int32))
    probes = _probes_for(spark, index, k, recall, asks) if len(centres) and asks else 16
    written = spark.createDataFrame([(key, key_type, probes, rows)], "key string, key_type string, probes int, cells array<struct<cell:int,centre:array<double>,radius:double,slices:int>>")
    written.select("key", "key_type", "probes", F.inline_outer("cells")).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index of a folder; its cells, of which there are at most MOST_CELLS, are read at once."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    cells = [r for r in rows if r.cell is not None]
    centres = np.array([r.centre for r in cells], np.float64).reshape(len(cells), -1) if cells else np.zeros((0, 0))
    return VectorIndex(path, rows[0].key, rows[0].key_type, centres, np.array([r.radius for r in cells]), np.array([r.slices for r in cells], np.int32), rows[0].probes)


def _probes(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """(query_id, within, unit, cells): the cells of the nearest centres.

    Where a query has a `floor`, the cells beyond those that may hold a vector of
    that cosine or more: the angle to a cell's centre less the cell's own widest
    angle bounds the angle to what is in it.
    """
    centres, radius, full = index.centres, index.radius, index.slices > 0
    names = ["query_id", "within", "unit", "cells"]
    again = "floor" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _units(batch.column("embedding"), centres.shape[1])
            likeness = np.where(full, unit @ centres.T, -2)
            order = np.argsort(-likeness, axis=1, kind="stable")
            cells = [[c for c in own if full[c]] for own in order[:, :probes].tolist()]
            if again:
                floor = batch.column("floor").to_numpy(zero_copy_only=False)[rows]
                least = np.maximum(np.arccos(np.clip(likeness, -1, 1)) - radius, 0)
                may = full & (np.cos(least) >= floor[:, None] - 1e-9)
                cells = [[c for c in own[probes:] if ok[c]] for own, ok in zip(order.tolist(), may, strict=True)]
            own = pa.array(rows)
            columns = [batch.column("query_id").take(own), batch.column("within").take(own), pa.array(list(unit), pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    types = dict(queries.dtypes)
    return queries.mapInArrow(run, f"query_id {types['query_id']}, within {types['within']}, unit array<double>, cells array<int>")


def _scores(table: pa.Table, centre: np.ndarray, unit: np.ndarray, exact: bool) -> np.ndarray:
    """Cosine of each query with each row of a cell, by the codes or by the vectors."""
    if exact:
        rows, found = _units(table["embedding"].combine_chunks(), unit.shape[1])
        out = np.zeros((len(unit), len(table)))
        out[:, rows] = unit @ found.T
        return out
    codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(table), -1).astype(np.float32)
    return (unit @ centre)[:, None] + (unit.astype(np.float32) @ codes.T) * table["scale"].to_numpy()


def _best(scores: np.ndarray, allowed: np.ndarray | None, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the `keep` best rows of each query, and of those that tie with the last of them."""
    scores = scores if allowed is None else np.where(allowed, scores, -np.inf)
    if scores.shape[1] > keep:
        last = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep, None]
    else:
        last = np.full((len(scores), 1), -np.inf)
    return np.nonzero((scores >= last) & (scores > -np.inf))


def _merged(q: np.ndarray, r: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows found for queries in several pieces the `keep` best of each query, and those that tie with the last of them."""
    order = np.lexsort((-score, q))
    q, r, score = q[order], r[order], score[order]
    new = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(q)))
    last = np.repeat(score[new + np.minimum(size, keep) - 1], size) if len(q) else score
    held = score >= last
    return q[held], r[held], score[held]


def _candidates(index: VectorIndex, probes: DataFrame, keep: int, exact: bool, within: str | None, few: bool) -> DataFrame:
    """(query_id, key, cell, approx): the best of each slice for each query that probes its cell.

    Few queries are sent to the files of the cells they probe; many meet them by a
    shuffle, in blocks of queries of a cell and slices of its vectors.
    """
    spark = probes.sparkSession
    key, centres = index.key, index.centres
    asked = cut(probes.withColumn("cell", F.explode("cells")).drop("cells"))
    per_cell = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cells = sorted(r.cell for r in per_cell.collect())  # MOST_CELLS at most
    stored = index.rows(spark).filter(F.col("cell").isin(cells))
    stored = stored.select(key, "cell", "slice", *([F.col(f"`{within}`").alias("within")] if within else []), *(["embedding"] if exact else ["code", "scale"]))
    id_type, key_type = dict(probes.dtypes)["query_id"], dict(stored.dtypes)[key]
    schema = f"query_id {id_type}, `{key}` {key_type}, cell int, approx double"
    names = ["query_id", key, "cell", "approx"]

    def met(table: pa.Table, cell: int, ids: pa.Array, unit: np.ndarray, own: np.ndarray | None) -> pa.Table:
        """The best of a table for each query, scored piece by piece: what is in memory at once doesn't grow with rows times queries."""
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for at in range(0, len(table), ROWS_AT_ONCE):
            part = table.slice(at, ROWS_AT_ONCE).combine_chunks()
            kinds = None if own is None else np.array(part["within"].to_pylist(), object)
            parts = [best]
            for k in range(0, len(unit), QUERIES_AT_ONCE):
                some = slice(k, k + QUERIES_AT_ONCE)
                scores = _scores(part, centres[cell], unit[some], exact)
                q, r = _best(scores, None if own is None else own[some, None] == kinds[None, :], keep)
                parts.append((q + k, r + at, scores[q, r].astype(np.float64)))
            best = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), keep)
        q, r, score = best
        return pa.table([ids.take(pa.array(q)), table[key].combine_chunks().take(pa.array(r)), pa.array(np.full(len(q), cell, np.int32)), pa.array(score)], names)

    if few:
        # At most SENT_QUERIES queries, and their cells.
        sent = probes.toArrow()
        by_cell: dict[int, list[int]] = {}
        for i, own in enumerate(sent["cells"].to_pylist()):
            for c in own:
                by_cell.setdefault(c, []).append(i)
        unit = np.array(sent["unit"].to_pylist(), np.float64)
        own = np.array(sent["within"].to_pylist(), object) if within else None
        ids = sent["query_id"].combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                at = table["cell"].to_numpy()
                for c in np.unique(at).tolist():
                    who = np.array(by_cell[c])
                    part = table.take(pa.array(np.flatnonzero(at == c)))
                    yield from met(part, c, ids.take(pa.array(who)), unit[who], None if own is None else own[who]).combine_chunks().to_batches()

        return stored.mapInArrow(run, schema)

    blocks = F.broadcast(per_cell)
    left = asked.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    slices = spark.createDataFrame([(c, int(index.slices[c])) for c in cells] or [(OUTSIDE, 0)], "cell int, slices int").withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(F.col("slices") - 1, F.lit(0)))))
    left = left.join(F.broadcast(slices.select("cell", "slice")), "cell").select("query_id", "within", "unit", "cell", "slice", "block")
    right = stored.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def pair(asked_: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked_) or not len(table):
            return pa.table([pa.array([], t) for t in (asked_.schema.field("query_id").type, table.schema.field(key).type, pa.int32(), pa.float64())], names)
        unit = asked_["unit"].combine_chunks().flatten().to_numpy().reshape(len(asked_), -1)
        own = np.array(asked_["within"].to_pylist(), object) if within else None
        return met(table, asked_["cell"][0].as_py(), asked_["query_id"].combine_chunks(), unit, own)

    on = ["cell", "slice", "block"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(pair, schema)


def _ranked(rows: DataFrame, by: str, key: str, keep: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), key))
    return rows.withColumn("rank", place).filter(F.col("rank") <= keep)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, fetch: int | None = None, exact: bool = False, within: str | None = None, sent: int = SENT_QUERIES) -> DataFrame:
    """(query_id, key, score, rank): the k vectors nearest to each query (query_id, embedding) by cosine, ties by key.

    The cells of the `probes` nearest centres (as many as the index measured, unless
    told) are read, no other file; of their vectors the `fetch` best by their codes (a byte for each dimension) are fetched
    whole and ranked by the exact cosine. `exact` compares whole vectors and then
    reads every cell that may hold one as near as the k-th found, so nothing is
    missed. within: a column that must equal that of the query (also `within`).

    Scores lie between 0 and 1, and only vectors above 0 are found; a query without
    a direction, of another width, or with a null or repeated id finds nothing more
    than its id does, and an empty index nothing at all. Up to `sent` queries go to
    the files; more of them meet the cells by a shuffle.
    """
    spark, key, probes = queries.sparkSession, index.key, index.probes if probes is None else probes
    if not len(index.centres):
        return queries.select("query_id", F.lit(None).cast(index.key_type).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter("false")
    within_col = F.col(f"`{within}`") if within else F.lit(None).cast("string")
    asked = cut(queries.select("query_id", within_col.alias("within"), "embedding").filter("query_id is not null").dropDuplicates(["query_id"]))
    few = asked.count() <= sent
    fetch = k if exact else max(k, fetch or 8 * k)
    found = cut(_ranked(_candidates(index, _probes(asked, index, probes), fetch, exact, within, few), "approx", key, fetch).drop("rank"))
    if exact:
        floors = found.filter("approx > 0").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("approx")).otherwise(0.0).alias("floor"))
        more = asked.join(floors, "query_id", "left").fillna(0.0, ["floor"])
        found = cut(_ranked(found.unionByName(_candidates(index, _probes(more, index, probes), fetch, True, within, few)), "approx", key, fetch).drop("rank"))
    cells = sorted(r.cell for r in found.select("cell").distinct().collect())  # MOST_CELLS at most
    whole = index.rows(spark).filter(F.col("cell").isin(cells)).select("cell", key, "embedding")
    found = F.broadcast(found) if few and found.count() <= sent else found
    both = whole.join(found, ["cell", key]).join(asked.select("query_id", F.col("embedding").alias("asked")), "query_id")
    scored = both.withColumn("score", cosine(F.col("embedding"), F.col("asked"))).filter("score > 0")
    return _ranked(scored, "score", key, k).select("query_id", key, "score", "rank")
