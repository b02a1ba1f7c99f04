"""Vector search by cosine, scored in JVM expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import cut


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """From 0 to 1; 0 where widths differ, a vector is empty or zero, or the angle is over a right one. norms: their product, where it is known."""
    both = norm(a) * norm(b) if norms is None else norms
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0)
    return F.when(ok, F.least(F.greatest(_dot(a, b) / both, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def top_k(vectors: DataFrame, query: DataFrame, k: int, key: str = "node_id") -> DataFrame:
    """The k nearest to one query vector, best first; ties by id.

    The query is one row and goes to every task; what comes back is k rows from each.
    """
    q = F.broadcast(query.select(F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_qn")).limit(1))
    score = cosine(F.col("embedding"), F.col("_q"), norm(F.col("embedding")) * F.col("_qn"))
    return vectors.join(q).withColumn("score", score).drop("_q", "_qn").orderBy(F.desc("score"), key).limit(k)


def over_fetch(vectors: DataFrame, query: DataFrame, fetch: int, keep: Column, score: Column, k: int, key: str = "node_id") -> DataFrame:
    """Fetch the nearest, then filter, then rank by another score and keep k: what the filter takes is not made up for."""
    return top_k(vectors, query, fetch, key).filter(keep).withColumn("rank_score", score).orderBy(F.desc("rank_score"), key).limit(k)


#: Queries that may be sent to every executor; more of them meet the vectors by a shuffle.
SENT_QUERIES = 10_000
#: Vectors and queries of a kind that meet in one task.
_SLICE, _BLOCK = 10_000, 2_000
#: More than two ways to add up a cosine can differ by.
_NEAR = 1e-9


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths): of one width; what is null, has a null or another width is zero."""
    lists = column.combine_chunks()
    out = np.zeros((len(lists), width))
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    out[rows[~holes]] = values[~holes]
    return out, np.sqrt((out * out).sum(axis=1))


def _may_be_best(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(query_id, kind, node_id, approx): the rows of one kind that may be among the k nearest of each query, by products of matrices.

    Of equal vectors only the k + 1 smallest ids are looked at, as of those of score 0.
    """
    names = ["query_id", "kind", "node_id", "approx"]
    out = [pa.table([pa.array([], asked.schema.field("query_id").type), pa.array([], asked.schema.field("kind").type), pa.array([], pa.string()), pa.array([], pa.float64())], names)]
    if not len(asked) or not len(rows):
        return out[0]
    rows = rows.take(pc.sort_indices(rows, [("node_id", "ascending")]))
    ids, selves = np.array(rows["node_id"].to_pylist(), object), np.array(asked["node_id"].to_pylist(), object)
    widths = lambda t: pc.fill_null(pc.list_value_length(t["embedding"]), 0).to_numpy()
    of = widths(asked)
    for width in np.unique(of).tolist():
        who = np.flatnonzero(of == width)
        v, n = _matrix(rows["embedding"], width) if width else (np.zeros((len(rows), 1)), np.zeros(len(rows)))
        q, m = _matrix(asked["embedding"].take(pa.array(who)), width) if width else (np.zeros((len(who), 1)), np.zeros(len(who)))
        same = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)[1]
        order = np.argsort(same, kind="stable")
        first = np.concatenate(([True], same[order][1:] != same[order][:-1]))
        nth = np.empty(len(v), np.int64)
        nth[order] = np.arange(len(v)) - np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
        keep = np.flatnonzero(nth <= k)
        v, n = v[keep], n[keep]
        for at in range(0, len(who), 256):
            part = slice(at, at + 256)
            lengths = m[part, None] * n
            with np.errstate(all="ignore"):
                raw = np.where(lengths > 0, q[part] @ v.T / lengths, -1.0)
            score = np.clip(np.where(np.isnan(raw), 1.0, raw), 0.0, 1.0)
            score[ids[keep][None, :] == selves[who[part], None]] = -1.0
            none = (raw < -_NEAR) & (score >= 0)
            score[none & (np.cumsum(none, axis=1) > k)] = -1.0
            least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else 0.0
            i, j = np.nonzero((score >= 0) & (score >= least - _NEAR))
            query = asked.take(pa.array(who[part][i]))
            out.append(pa.table([query["query_id"].combine_chunks(), query["kind"].combine_chunks(), pa.array(ids[keep][j], pa.string()), pa.array(score[i, j])], names))
    return pa.concat_tables(out)


def by_kind(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest to each of some queries (query_id, node_id, kind, embedding) within the query's kind; ties by id.

    Slices of a kind's vectors meet blocks of its queries, each pair in one task of
    bounded size, and give out what may be among the k best, which a product of
    matrices says but for its last digits. Those few are scored exactly and ranked.
    """
    def size(rows: DataFrame, name: str, most: int) -> DataFrame:
        return rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    q = cut(queries.select("query_id", "kind", "node_id", "embedding"))
    v = cut(vectors.filter("node_id is not null").select("kind", "node_id", "embedding"))
    sizes = size(v, "slices", _SLICE).join(size(q, "blocks", _BLOCK), "kind")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = q.join(sizes, "kind").withColumn("block", dealt("query_id", "blocks")).withColumn("slice", every("slices"))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides come from sizes
    right = v.join(sizes, "kind").withColumn("slice", dealt("node_id", "slices")).withColumn("block", every("blocks"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    on, types = ["kind", "slice", "block"], dict(q.dtypes)
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(lambda a, b: _may_be_best(a, b, k), f"query_id {types['query_id']}, kind {types['kind']}, node_id string, approx double")
    met = met.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx"))))
    least = F.min(F.when(F.col("_nth") <= k, F.col("approx"))).over(Window.partitionBy("query_id"))
    found = met.withColumn("_least", least).filter(F.col("approx") >= F.col("_least") - _NEAR).select("query_id", "kind", "node_id").distinct()
    asked = q.select(F.col("query_id").alias("_id"), F.col("kind").alias("_kind"), F.col("node_id").alias("_self"), F.col("embedding").alias("_q"))
    both = v.join(found, ["kind", "node_id"]).join(asked, F.col("query_id").eqNullSafe(F.col("_id")) & (F.col("kind") == F.col("_kind"))).filter("node_id <> _self")
    scored = both.withColumn("score", cosine(F.col("embedding"), F.col("_q")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.select("query_id", "node_id", "kind", "score", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)
