import json
from datetime import datetime

from palimpsest.llm.chat_format import link_tool_calls
from palimpsest.llm.url_filter import url_filter

TOOLS = [("f", '{"type":"object","properties":{"x":{"type":"integer","minimum":0},"y":{"type":"array","items":{"type":"string"}}},"required":["x"],"additionalProperties":false}')]


def link(spark, calls, results):
    c = spark.createDataFrame([(*r, "e") for r in calls], "conv_id long, call_id string, turn long, name string, arguments string, level string")
    r = spark.createDataFrame([(*r, "e") for r in results], "conv_id long, call_id string, turn long, content string, json string")
    t = spark.createDataFrame(TOOLS, "name string, parameters string")
    return {(r.conv_id, r.call_id, r.kind): r for r in link_tool_calls(c, r, t).collect()}


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "f", '{"x": 1, "y": ["é"]}'), (1, "b", 1, "f", '{"y": [{"$ref": "a"}], "x": {"$ref": "a"}}'), (1, "c", 2, "g", "{}"), (1, "d", 3, "f", "{oops"), (1, "e", 4, "f", None),
        (1, "p", 5, "f", '{"x": {"$ref": "q"}}'), (1, "q", 6, "f", '{"x": {"$ref": "p"}}'), (1, "r", 7, "f", '{"x": {"$ref": "b"}}'), (1, "s", 8, "f", '{"x": {"$ref": "nowhere"}}'), (2, "a", 0, None, '{"x":true}'),
        (1, "a", 9, "f", '{"x": 2}'), (None, "n", 0, "f", "{}"), (3, "z", 0, "f", '{"x":-1,"k":0}'),
    ]
    results = [(1, "a", 2, "one"), (1, "a", 1, "first"), (1, "lost", 3, None), (2, "a", 1, None)]
    got = link(spark, calls, results)
    assert len(got) == 12
    a = got[1, "a", "call"]
    assert a.json == '{"arguments":{"x":1,"y":["é"]},"id":"a","name":"f","result":"first","type":"tool_call"}' and a.valid and a.level == 0 and a.result_turn == 1
    levels = {k[1]: r.level for k, r in got.items() if k[0] == 1 and k[2] == "call"}
    assert levels == {"a": 0, "b": 1, "c": 0, "d": 0, "e": 0, "p": None, "q": None, "r": 2, "s": 0}
    assert got[1, "c", "call"].errors == ["no such tool"] and got[1, "d", "call"].errors == ["$: not JSON"] == got[1, "e", "call"].errors
    assert "refers to itself" in got[1, "p", "call"].errors
    assert got[3, "z", "call"].errors == ["$.k: not known", "$.x: out of bounds"]
    assert got[1, "lost", "result"].errors == ["no such call"] and json.loads(got[1, "lost", "result"].json)["result"] is None
    assert json.loads(got[2, "a", "call"].json)["result"] is None
    assert link(spark, [], []) == {}


def test_url_filter(spark):
    day = lambda n: datetime(2024, 1, 1 + n)
    urls = [(1, "http://A.b.Example.org:80/x", day(3)), (2, "https://u:p@example.org./", day(5)), (3, "nonsense", day(5)), (4, None, day(5)), (5, "http://example.org", None), (6, "http://other.org/example.org", day(9)), (1, "http://A.b.Example.org:80/x", day(3)), (7, "http://b.example.org?", day(10)), (8, "http://xb.example.org", day(10)), (9, "http://example.org", day(4))]
    entries = [("ads", "example.org", day(2), "add"), ("ads", "example.org", day(4), "remove"), ("ads", "example.org", day(4), "add"), ("ads", "example.org", day(2), "add"), ("bad", "B.example.org", day(0), "add"), ("bad", "b.example.org", day(30), "remove"), ("ads", None, day(0), "add"), ("ads", "other.org", day(20), "add"), (None, "other.org", day(0), "add"), ("ads", "other.org", day(0), "huh")]
    c = spark.createDataFrame([(*r, "old") for r in urls], "page_id long, url string, fetched_at timestamp, lists string")
    e = spark.createDataFrame([(*r, 1) for r in entries], "list_name string, pattern string, at timestamp, action string, until int")
    for days in (1, 30):
        got = sorted((r.page_id, tuple(r.lists), r.blocked) for r in url_filter(c, e, days).collect())
        assert got == [(1, ("ads", "bad"), True)] * 2 + [(2, (), False), (3, (), False), (4, (), False), (5, (), False), (6, (), False), (7, ("bad",), True), (8, (), False), (9, (), False)]
    assert url_filter(c.limit(0), e).collect() == []
    assert not any(r.blocked for r in url_filter(c, e.limit(0)).collect())


def test_arguments_that_are_refused(spark):
    """What a parser would choke on becomes a named error, and the row stays JSON that any reader takes."""
    bad = {
        "half": ('{"x":"\\ud800"}', "half a surrogate pair"), "key": ('{"\\udfff":1}', "half a surrogate pair"), "deep": ("[" * 100_000 + "]" * 100_000, "nested too deep"),
        "deepish": ('{"x":' + "[" * 101 + "]" * 101 + "}", "nested too deep"), "nan": ('{"x":NaN}', "not JSON"), "inf": ('{"x":-Infinity}', "not JSON"), "big": ('{"x":1e400}', "number out of range"),
        "long": ('{"x":' + "9" * 5000 + "}", "number out of range"), "twice": ('{"x":1,"x":2}', "repeated key"), "empty": ("", "not JSON"), "space": (" ", "not JSON"), "null": (None, "not JSON"),
    }
    good = {"pair": '{"x":"\\ud83d\\ude00"}', "bytes": '{"x":"' + "a" * 300_000 + '"}', "brackets": '{"x":"' + "[" * 5000 + '"}', "edge": "[" * 100 + "1" + "]" * 100}
    calls = spark.createDataFrame([(1, k, i, "any", t) for i, (k, t) in enumerate([*((k, t) for k, (t, _) in bad.items()), *good.items()])], "conv_id long, call_id string, turn long, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in link_tool_calls(calls, none, spark.createDataFrame([("any", "{}")], "name string, parameters string")).collect()}
    for k, (text, why) in bad.items():
        assert got[k].errors == [f"$: {why}"] and not got[k].valid
        assert json.loads(got[k].json)["arguments"] == text
    for k, text in good.items():
        assert got[k].valid and json.loads(got[k].json)["arguments"] == json.loads(text)


def test_broken_schemas(spark):
    schemas = {"no": "{oops", "null": None, "list": "[1]", "type": '{"type":"strange"}', "props": '{"properties":3}', "bound": '{"minimum":"a"}', "deep": "[" * 9999, "true": "true", "false": "false", "enum": '{"enum":[1]}'}
    calls = spark.createDataFrame([(1, k, 0, k, "true" if k == "enum" else '{"a":1}' if k == "props" else "5") for k in schemas], "conv_id long, call_id string, turn long, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r.errors for r in link_tool_calls(calls, none, spark.createDataFrame(list(schemas.items()), "name string, parameters string")).collect()}
    assert got == {
        "no": ["tool schema: not JSON"], "null": ["tool schema: not JSON"], "list": ["tool schema: broken"], "type": ["tool schema: broken"], "props": ["tool schema: broken"], "bound": ["tool schema: broken"],
        "deep": ["tool schema: nested too deep"], "true": [], "false": ["$: not allowed"], "enum": ["$: not one of the values"],
    }


def test_very_long_urls(spark):
    """A host of 300 labels and a path of a million characters are judged like any other."""
    host = ".".join(["a"] * 300) + ".example.org"
    c = spark.createDataFrame([(1, f"http://{host}/" + "x" * 1_000_000, datetime(2024, 1, 5)), (2, "http://other.org/" + "y" * 1_000_000, datetime(2024, 1, 5))], "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame([("ads", "example.org", datetime(2024, 1, 2), "add")], "list_name string, pattern string, at timestamp, action string")
    assert {r.page_id: r.blocked for r in url_filter(c, e).collect()} == {1: True, 2: False}
