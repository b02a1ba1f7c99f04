"""Adjacency lists and keyed records: the same answers as a scan, from fewer rows."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import adjacency, graph, scans
from palimpsest.sources import chat_export, keyed, sinks, tables
from tests.conftest import scanned

FOLDER = "/root/testdata/sf0.001"
EDGE = "edge_type string, from_id string, to_id string, valid_from timestamp, invalidated_at timestamp"


def new():
    return tempfile.mkdtemp(prefix="spark-") + "/x"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def edges(spark):
    return tables.edges(tables.findings(spark, FOLDER))


@pytest.mark.parametrize(("few", "at_most"), [(0, 7), (1000, 10**6)])
def test_lists_equal_the_scan(spark, few, at_most):
    lists = adjacency.build(edges(spark), new(), buckets=4, at_most=at_most)
    assert (lists.hubs(spark, "in").count() > 0) == (at_most == 7)
    ids = spark.createDataFrame([("obs_11",), ("obs_12",), ("pat_3",), ("pat_3",), ("no such",), (None,)], "node_id string")
    for way in ("out", "in", "both"):
        want = graph.expand(graph.live_edges(edges(spark), as_of="2024-01-20"), ids, way)
        assert rows(adjacency.expand(lists, ids, way, as_of="2024-01-20", few=few).select(want.columns)) == rows(want)
    start = ids.limit(1)
    nodes, between, cut_off = adjacency.neighbourhood(lists, start, 2, few=few)
    assert rows(nodes) == rows(graph.neighbourhood(graph.live_edges(edges(spark)), start, 2)[0]) and not cut_off
    ids_ = {r.node_id for r in nodes.collect()}
    walked = between.collect()
    assert len({(r.edge_type, r.from_id, r.to_id) for r in walked}) == len(walked) > 0
    assert all(r.from_id in ids_ and r.to_id in ids_ for r in walked)
    for limit in (1, 5, 40):
        nodes, between, cut_off = adjacency.neighbourhood(lists, start, 3, limit=limit, few=few)
        want, want_cut = graph.neighbourhood(graph.live_edges(edges(spark)), start, 3, limit=limit)
        assert rows(nodes) == rows(want) and cut_off is want_cut is True
    adjacency.drop(spark, lists)


def test_a_hop_moves_no_edges(spark):
    lists = adjacency.build(edges(spark), new(), buckets=8, at_most=50)
    ids = tables.findings(spark, FOLDER).filter("event_id % 3 = 0").select("node_id")
    plan = adjacency.step(lists, ids, "out", few=10)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Scan parquet")].splitlines()
    scan = next(i for i, line in enumerate(plan.splitlines()) if "lists_out" in line and "Scan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    under, at = [], depth(plan.splitlines()[scan])
    for line in reversed(plan.splitlines()[:scan]):
        if depth(line) < at:
            under.append(line)
            at = depth(line)
    assert above and not any("Exchange" in line for line in under)
    assert any("SortMergeJoin" in line for line in under)
    one = adjacency.step(lists, ids.limit(1), "out")
    assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    adjacency.drop(spark, lists)


def test_odd_edges(spark):
    t = None
    odd = spark.createDataFrame([("a", "x", "x", t, t), ("a", "x", "y", t, t), ("a", "x", "y", t, t), ("b", "x", None, t, t), ("b", None, "y", t, t)], EDGE)
    lists = adjacency.build(odd, new(), buckets=2)
    nodes, between, _ = adjacency.neighbourhood(lists, spark.createDataFrame([("x",)], "node_id string"), 5)
    assert rows(nodes) == [("x", 0), ("y", 1)] and between.count() == 2
    assert adjacency.neighbourhood(lists, spark.createDataFrame([("x",)], "node_id string"), 0)[0].count() == 1
    nothing = adjacency.build(odd.limit(0), new(), buckets=2)
    nodes, between, _ = adjacency.neighbourhood(nothing, spark.createDataFrame([("x",)], "node_id string"), 2, limit=9)
    assert rows(nodes) == [("x", 0)] and between.count() == 0


def test_chains_over_lists(spark):
    v = spark.createDataFrame([("a1", None), ("a2", "a1"), ("a3", "a2"), ("b2", "lost"), ("c1", "c2"), ("c2", "c1"), ("d", None)], "node_id string, previous_version_id string")
    lists = adjacency.build(adjacency.version_links(v), new(), buckets=2)
    for node, want in {"a2": ["a1", "a2", "a3"], "b2": ["b2"], "c1": ["c1", "c2"], "d": ["d"], "nothing": []}.items():
        assert [r.node_id for r in adjacency.version_chain(lists, v, node).orderBy("node_id").collect()] == want
        assert [r.node_id for r in graph.version_chain(spark, v, node).orderBy("node_id").collect()] == want


def test_keyed_records(spark):
    rng = random.Random(1)
    keys = [f"k{i:06d}" for i in range(5000)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k, i, "x" * 50) for i, k in enumerate(keys)], "node_id string, n long, low string")
    table = keyed.write(df, new(), rows=500)
    assert table.files(spark).count() >= 8
    asked = spark.createDataFrame([(0, "k000007"), (1, "k004999"), (2, "none"), (3, "k000007"), (4, None)], "pos long, node_id string")
    want = scans.by_ids(df, asked.filter("node_id is not null"))
    for few in (1000, 1):
        assert [tuple(r) for r in keyed.by_ids(table, asked, few).select("node_id", "n").collect()] == [tuple(r) for r in want.select("node_id", "n").collect()]
    assert [r.n for r in keyed.by_id(table, spark, "k000123").collect()] == [keys.index("k000123")]
    assert keyed.by_id(table, spark, "nothing").collect() == [] == keyed.by_id(table, spark, "a").collect()
    cursor, seen = None, []
    while page := keyed.after(table, spark, cursor, 700).collect():
        seen += [r.node_id for r in page]
        cursor = seen[-1]
    assert seen == sorted(keys)
    assert keyed.after(table, spark, "zzz", 5).collect() == []


def test_a_lookup_reads_few_rows(spark):
    df = spark.range(200_000).selectExpr("format_string('k%06d', id * 7 % 200000) as node_id", "id as n")
    table = keyed.write(df, new(), rows=20_000, group=64 << 10)
    files = table.files(spark).filter((F.col("low") <= "k100000") & (F.col("high") >= "k100000")).collect()
    assert len(files) == 1
    assert scanned(keyed._read(spark, table, [f.file for f in files]).filter("node_id = 'k100000'")) < 25_000
    assert scanned(table.rows(spark).filter("node_id = 'k1x'")) <= 25_000
    assert keyed.by_id(table, spark, "k100000").count() == 1


def test_a_collection_is_copied_page_by_page(spark, tmp_path):
    v = spark.createDataFrame([(f"n{i}", [1.0, 2.0]) for i in range(50)] + [(None, [1.0]), (" ", None)], "node_id string, embedding array<double>")
    got = sinks.migrate(v, str(tmp_path / "a"), 2, pages=4)
    assert (got.count(), *got.selectExpr("sum(copied)", "sum(nameless)").first()) == (4, 50, 2)
    before = rows(spark.read.parquet(str(tmp_path / "a" / "rows")).select("node_id"))
    assert len(before) == 50 and sinks.migrate(v.limit(0), str(tmp_path / "a"), 2, pages=4).count() == 4
    assert rows(spark.read.parquet(str(tmp_path / "a" / "rows")).select("node_id")) == before
    with pytest.raises(ValueError):
        sinks.migrate(v, str(tmp_path / "b"), 3)
    assert not (tmp_path / "b").exists()


def test_every_reason_why_a_conversation_is_refused(spark):
    own = '{"id": "c", "lastUpdated": "2024-01-01T00:00:00Z", "messages": [{"role": "user", "content": "hi"}]}'
    other = own.replace('"user"', '"bot"')
    bodies = {"ok": own, "list": f'[1, null, "x", {own}, {other}]', "bad": own[:-1], "none": "[]", "number": "3", "null": "null", "empty": "{}", "void": None, "items": '{"items": [' + own.replace('"hi"', '" "') + "]}", "undated": own.replace('"lastUpdated"', '"seen"')}
    got = chat_export.refused(spark.createDataFrame(list(bodies.items()), "filename string, body string"))
    assert rows(got) == sorted([("list", 0, "NOT_AN_OBJECT"), ("list", 1, "NOT_AN_OBJECT"), ("list", 2, "NOT_AN_OBJECT"), ("list", 4, "NOTHING_OWN"), ("bad", None, "NOT_JSON"), ("none", None, "NO_CONVERSATIONS"), ("number", None, "NO_CONVERSATIONS"), ("null", None, "NO_CONVERSATIONS"), ("empty", 0, "NO_MESSAGES"), ("void", None, "NOT_JSON"), ("items", 0, "NOTHING_READABLE"), ("undated", 0, "NOTHING_READABLE")], key=repr)
