"""Chat formatting: tool calls linked to their results, ordered, validated and serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import cut

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Brackets that JSON text may stand in, and digits that a number may have.
DEPTH, DIGITS = 100, 1000


def _problems(value: object, schema: object, path: str) -> list[str]:
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_a = lambda k: isinstance(value, _KINDS[k]) and not (k in ("integer", "number") and isinstance(value, bool))
    if kinds and not any([is_a(k) for k in kinds]):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(x == value and isinstance(x, bool) == isinstance(value, bool) for x in schema["enum"]):
        out.append(f"{path}: not one of the values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += _problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not known")
    elif isinstance(value, list) and "items" in schema:
        out += [p for i, x in enumerate(value) for p in _problems(x, schema["items"], f"{path}[{i}]")]
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: length out of bounds")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of bounds")
    return out


def problems(value: object, schema: object) -> list[str]:
    """Where a value breaks a schema of type, enum, required, properties, additionalProperties, items and bounds, or that the schema is none."""
    try:
        return _problems(value, schema, "$")
    except (AttributeError, KeyError, RecursionError, TypeError, ValueError):
        return ["tool schema: broken"]


def parsed(text: str | None) -> tuple[object, str | None]:
    """A value of strict JSON text, and what is wrong with the text.

    Refused are text that isn't JSON (NaN and Infinity aren't), numbers beyond a
    double or of more than DIGITS digits, repeated keys, brackets deeper than DEPTH,
    and escapes that leave half a surrogate pair.
    """

    def number(kind):
        def read(x: str):
            if len(x) > DIGITS or not isfinite(float(x)):
                raise OverflowError
            return kind(x)

        return read

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len(out := dict(items)) < len(items):
            raise KeyError
        return out

    def no_number(x: str):
        raise ValueError(x)

    try:
        value = json.loads(text or "", parse_int=number(int), parse_float=number(float), parse_constant=no_number, object_pairs_hook=pairs)
        layer, depth = [value], 0
        while layer := [y for x in layer for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]:
            depth += 1
            if depth > DEPTH:
                raise RecursionError
        canonical(value).encode()
    except UnicodeEncodeError:
        return None, "half a surrogate pair"
    except OverflowError:
        return None, "number out of range"
    except KeyError:
        return None, "repeated key"
    except RecursionError:
        return None, "nested too deep"
    except ValueError:
        return None, "not JSON"
    return value, None


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def references(value: object) -> list[str]:
    """Ids that a value refers to: every {"$ref": id} in it."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def _checked(calls: DataFrame) -> DataFrame:
    """Calls with their parsed state: errors, refs and the canonical text of the call with its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, refs, text = [], [], []
            for r in batch.to_pylist():
                arguments, wrong = parsed(r["arguments"])
                schema, broken = parsed(r["parameters"]) if r["known"] else (None, None)
                if wrong:
                    bad = [f"$: {wrong}"]
                elif not r["known"]:
                    bad = ["no such tool"]
                else:
                    bad = [f"tool schema: {broken}"] if broken else problems(arguments, schema)
                row = {"type": "tool_call", "id": r["call_id"], "name": r["name"], "arguments": r["arguments"] if wrong else arguments}
                if r["linked"]:
                    row["result"] = r["content"]
                errors.append(bad)
                refs.append(sorted(set(references(arguments))))
                text.append(canonical(row))
            keep = [batch.schema.get_field_index(c) for c in ("conv_id", "call_id", "turn", "name", "linked", "result_turn")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string())), pa.array(text, pa.string())],
                ["conv_id", "call_id", "turn", "name", "linked", "result_turn", "errors", "refs", "json"],
            )

    kinds = dict(calls.dtypes)
    schema = f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, name string, linked boolean, result_turn {kinds['turn']}, errors array<string>, refs array<string>, json string"
    return calls.mapInArrow(run, schema)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without references, else one more than the highest referred to; none in or behind a cycle.

    References to calls that don't exist don't count. Each round settles one
    level, by joins on the ids; the rounds are as many as the longest chain.
    """
    ids = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).join(ids.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left_semi")
    edges = cut(edges)
    settled = ids.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    level = 0
    while not edges.isEmpty():
        level += 1
        known = settled.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("known"))
        state = edges.join(known, ["conv_id", "ref"], "left").groupBy("conv_id", "call_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ready"))
        new = cut(state.filter("ready").select("conv_id", "call_id", F.lit(level).alias("level")))
        if new.isEmpty():
            break
        settled = cut(settled.union(new))
        edges = cut(edges.join(new, ["conv_id", "call_id"], "left_anti"))
    return settled


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call, and per result without a call, in an order that `level`, `turn` and `call_id` give.

    calls: conv_id, call_id, turn, name, arguments (JSON). results: conv_id,
    call_id, turn, content. tools: name, parameters (a JSON schema). Returns
    conv_id, call_id, turn, name, kind ('call' or 'result'), level, valid, errors,
    result_turn and json. Calls and results are hash-joined by conversation and
    id, calls and tools by name; references between calls ({"$ref": id} in the
    arguments) order them topologically within a conversation: level 0 refers to
    none, and a call in or behind a cycle has a null level. `valid` says whether
    arguments and level are in order; `errors` says where not. `json` is one
    canonical JSON object: the call with its result, or the lone result.

    Of calls, or results, that share an id in a conversation the earliest turn
    counts, then the smaller text; others go. Without a conversation or an id,
    a call or result can't be linked and goes too. Null arguments are no JSON; a
    null name is no tool. Of tools that share a name the smallest schema counts; a
    tool without one has a broken schema. Arguments and schemas that parsed()
    refuses, and schemas of unknown types or forms, are named in `errors`; `json`
    then holds the arguments as the text they were, so it is JSON in any case.
    Numbers are written as Python writes them. Empty tables give empty results;
    arguments of any length are read whole; other columns are not read.
    Nothing gathers a conversation in one place: its rows spread by id, however
    many there are.
    """
    one = lambda rows, text: rows.filter("conv_id is not null and call_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", text))).filter("_n = 1").drop("_n")
    calls = one(calls.select("conv_id", "call_id", "turn", "name", "arguments"), "arguments")
    results = one(results.select("conv_id", "call_id", F.col("turn").alias("turn"), "content"), "content")
    answers = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("linked"))
    schemas = tools.groupBy("name").agg(F.min("parameters").alias("parameters"), F.lit(True).alias("known"))
    joined = calls.join(answers, ["conv_id", "call_id"], "left").join(schemas, "name", "left").withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("known", F.coalesce("known", F.lit(False)))
    checked = cut(_checked(joined))
    placed = checked.join(_levels(checked.select("conv_id", "call_id", "refs")), ["conv_id", "call_id"], "left")
    cyclic = F.when(F.col("level").isNull(), F.array(F.lit("refers to itself"))).otherwise(F.expr("cast(array() as array<string>)"))
    out = placed.select(
        "conv_id", "call_id", "turn", "name", F.lit("call").alias("kind"), "level", (F.size("errors") + F.size(cyclic) == 0).alias("valid"), F.concat("errors", cyclic).alias("errors"), "result_turn", "json"
    )
    lone = results.join(calls, ["conv_id", "call_id"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [canonical({"type": "tool_result", "id": r["call_id"], "result": r["content"]}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(text, pa.string())], ["conv_id", "call_id", "turn", "json"])

    kinds = dict(results.dtypes)
    lone = lone.select("conv_id", "call_id", "turn", "content").mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, json string")
    nothing = F.array(F.lit("no such call"))
    return out.unionByName(
        lone.select("conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit("result").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("valid"), nothing.alias("errors"), F.col("turn").alias("result_turn"), "json")
    )
