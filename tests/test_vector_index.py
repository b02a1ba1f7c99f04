"""The index of vectors against the exact scan, and what it reads."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import vector_index, vectors
from palimpsest.sources import tables
from tests.conftest import scanned

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark):
    return vector_index.build(tables.vectors(spark, FOLDER), tempfile.mkdtemp(prefix="spark-") + "/index", cells=40)


def exact(rows, queries, k, within=None):
    """{query: [(key, score)]}, scores above 0 only."""
    unit = lambda e: None if not e or None in e or not np.linalg.norm(e) else np.array(e, float) / np.linalg.norm(e)
    out = {}
    for q, own, e in queries:
        u = unit(e)
        scored = [(key, float(u @ unit(x))) for key, kind, x in rows if u is not None and unit(x) is not None and len(x) == len(e) and (within is None or kind == own)]
        out[q] = sorted(((s, key) for key, s in scored if s > 0), key=lambda p: (-round(p[0], 12), p[1]))[:k]
    return {q: [(key, round(s, 9)) for s, key in v] for q, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r[3])):
        out.setdefault(r[0], []).append((r[1], round(r[2], 9)))
    return out


def test_recall_and_the_exact_way(spark, index):
    v = tables.vectors(spark, FOLDER)
    rows = [(r.node_id, r.kind, r.embedding) for r in v.collect()]
    asked = [(r.vec_id, r.kind, r.embedding) for r in v.filter("vec_id % 20 = 0").collect()]
    queries = v.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "kind", "embedding")
    want = exact(rows, asked, 10)
    near = found(vector_index.search(index, queries, 10))
    assert index.probes < len(index.centres)
    assert sum(len({k for k, _ in near[q]} & {k for k, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    for sent in (10_000, 0):
        assert found(vector_index.search(index, queries, 10, probes=4, exact=True, sent=sent)) == want
    assert found(vector_index.search(index, queries, 5, probes=4, exact=True, within="kind")) == exact(rows, asked, 5, "kind")
    few, many = (found(vector_index.search(index, queries, 10, probes=6, sent=n)) for n in (10_000, 0))
    assert few == many


def test_a_search_opens_the_files_of_its_cells_only(spark, index):
    one = tables.vectors(spark, FOLDER).filter("vec_id = 7").selectExpr("vec_id as query_id", "embedding")
    probed = vector_index._probes(one.withColumn("within", one.query_id.cast("string")), index, 3).first().cells
    assert len(probed) == 3
    assert 0 < scanned(index.rows(spark).filter(F.col("cell").isin(probed)).select("node_id")) < 500
    assert scanned(index.rows(spark).select("node_id")) == 2000


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{i}", "a", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(f"same{i}", "b", [1.0] * 8) for i in range(200)] + [("zero", "a", [0.0] * 8), ("short", "a", [1.0]), ("none", "a", None), ("empty", "a", []), ("hole", "a", [1.0, None] * 4), ("n0", "a", rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "node_id string, kind string, embedding array<double>, code string")
    index = vector_index.build(df.drop("code"), tempfile.mkdtemp(prefix="spark-") + "/index", cells=12, sample=200)
    assert index.rows(spark).count() == len(rows)
    asked = [(1, "a", [1.0] * 8), (2, "b", rows[3][2]), (3, "a", [0.0] * 8), (4, "a", [1.0, 2.0]), (5, "a", None)]
    queries = spark.createDataFrame([*asked, (None, "a", [1.0] * 8), asked[0]], "query_id long, kind string, embedding array<double>")
    for sent in (100, 0):
        assert found(vector_index.search(index, queries, 7, probes=2, exact=True, sent=sent)) == exact(rows, asked, 7)
    nothing = vector_index.build(df.drop("code").limit(0), tempfile.mkdtemp(prefix="spark-") + "/index")
    assert vector_index.search(nothing, queries, 3).collect() == []


def test_few_cells_do_where_vectors_come_in_clusters(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(30, 16))
    rows = [(f"n{i}", [float(x) for x in middles[i % 30] + 0.1 * rng.normal(size=16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "node_id string, embedding array<double>")
    index = vector_index.build(df, tempfile.mkdtemp(prefix="spark-") + "/index", cells=60)
    assert index.probes <= 8
    asked = [(i, None, rows[i * 20][1]) for i in range(100)]
    queries = spark.createDataFrame([(q, e) for q, _, e in asked], "query_id long, embedding array<double>")
    want, near = exact([(k, None, e) for k, e in rows], asked, 10), found(vector_index.search(index, queries, 10))
    assert sum(len({k for k, _ in near[q]} & {k for k, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_scores_equal_the_scan(spark, index):
    v = tables.vectors(spark, FOLDER)
    scan = vectors.top_k(v, v.filter("vec_id = 7"), 20).collect()
    got = vector_index.search(index, v.filter("vec_id = 7").selectExpr("vec_id as query_id", "embedding"), 20, probes=2, exact=True).orderBy("rank").collect()
    assert [(r.node_id, round(r.score, 9)) for r in got] == [(r.node_id, round(r.score, 9)) for r in scan]


def test_no_task_scores_all_queries_and_rows_at_once():
    """Pieces of rows and queries: no matrix of scores beyond them, and the same neighbours, ties included."""
    assert vector_index.ROWS_AT_ONCE * vector_index.QUERIES_AT_ONCE * 8 <= 1 << 23
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(6, 40)), 1)
    for keep in (1, 3, 40, 50):
        want = set(zip(*(x.tolist() for x in vector_index._best(scores, None, keep)), strict=True))
        parts = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for at in range(0, 40, 7):
            q, r = vector_index._best(scores[:, at : at + 7], None, keep)
            parts = vector_index._merged(*(np.concatenate(x) for x in zip(parts, (q, r + at, scores[q, r + at]), strict=True)), keep)
        assert set(zip(parts[0].tolist(), parts[1].tolist(), strict=True)) == want
