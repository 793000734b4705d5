import json

import pytest

from tapeloom.llm.tool_calls import canonical, fault, link_calls

SCHEMA = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
CALLS = "conv_id long, call_id string, seq long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, seq long, content string"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"x": 1}, None), ({"x": True}, "arguments.x is no integer"), ({"x": -1}, "arguments.x is too small"), ({}, "arguments.x is missing"), ([], "arguments is no object"),
        ({"x": 1, "z": 2}, "arguments.z is unknown"), ({"x": 1, "y": ["a", 2]}, "arguments.y[1] is no string"), ({"x": 1.0}, "arguments.x is no integer"),
    ],
)
def test_validation(value, want):
    assert fault(value, SCHEMA["f"]) == want


def test_links_layers_and_records(spark):
    calls = [
        (1, "a", 0, "f", '{"y":["é"], "x":1}', None), (1, "b", 2, "f", '{"x":2}', "a"), (1, "c", 4, "f", '{"x":3}', "b"), (1, "d", 6, "f", '{"x":4}', "gone"),
        (1, "c", 9, "g", "late repeat", None), (2, "a", 0, "g", "{}", None), (2, "p", 1, "f", '{"x":1}', "q"), (2, "q", 2, "f", '{"x":1}', "p"), (2, "r", 3, "f", '{"x":1}', "q"),
        (3, "a", 5, "f", '{"x":NaN}', "a"), (3, "n", 5, "f", None, None), (None, "a", 1, "f", '{"x":1}', None), (3, None, 1, None, "x", None),
    ]
    results = [(1, "a", 1, 'say "hi"\n'), (1, "a", 3, "second"), (1, "b", 1, "too early"), (1, "z", 1, "alone"), (2, "a", 1, None), (1, "d", 7, None), (None, "a", 2, "x")]
    got = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA).collect()
    by = {(r.conv_id, r.call_id, r.seq): r for r in got}
    assert len(got) == len(by) == 14
    assert [by[1, c, s].layer for c, s in (("a", 0), ("b", 2), ("c", 4), ("d", 6))] == [0, 1, 2, 0]
    assert by[1, "a", 0].record == '{"arguments":{"x":1,"y":["é"]},"id":"a","name":"f","result":"say \\"hi\\"\\n"}'
    assert not by[1, "b", 2].linked and "result" not in by[1, "b", 2].record
    assert json.loads(by[1, "d", 6].record)["result"] is None and by[1, "d", 6].linked
    assert by[1, "z", 1].error == "no call" and by[2, "a", 0].error == "unknown tool"
    assert {by[2, c, s].error for c, s in (("p", 1), ("q", 2), ("r", 3))} == {"cycle"} and by[3, "a", 5].error == "cycle"
    assert by[3, "n", 5].error == "arguments are no JSON" and by[None, "a", 1].layer == 0 and by[3, None, 1].error == "unknown tool"


def test_long_chains_take_few_rounds(spark):
    n = 700
    calls = spark.createDataFrame([(1, f"c{i}", i, "f", '{"x":1}', f"c{i - 1}") for i in range(n)], CALLS)
    got = link_calls(calls, spark.createDataFrame([], RESULTS), SCHEMA).collect()
    assert sorted(r.layer for r in got) == list(range(n)) and all(r.layer == r.seq for r in got)
    assert link_calls(calls.limit(0), spark.createDataFrame([], RESULTS), SCHEMA).count() == 0


def test_canonical_json():
    assert canonical({"b": [1, 2.5, None], "a": {"é": "\n"}}) == '{"a":{"é":"\\n"},"b":[1,2.5,null]}'


def test_strings_that_no_text_can_hold(spark):
    schemas = {"t": {"type": "object", "properties": {"n": {"type": "number"}}}}
    arguments = ['{"s": "\\ud800"}', '{"\\udc00": 1}', '{"n": 1e999}', '{"x": {"y": -1e999}}', '{"s": "\\ud83d\\ude00"}', None, ""]
    rows = [(1, f"c{i}", i, "t", a, None, "x", 1) for i, a in enumerate(arguments)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, seq long, name string, arguments string, after string, layer string, valid int")
    results = spark.createDataFrame([(1, "c4", 9, "é", "x")], "conv_id long, call_id string, seq long, content string, linked string")
    got = {r.call_id: r for r in link_calls(calls, results, schemas).collect()}
    assert [got[f"c{i}"].valid for i in range(7)] == [False] * 4 + [True, False, False]
    assert "surrogate" in got["c0"].error and "surrogate" in got["c1"].error and "finite" in got["c2"].error and got["c3"].record is None
    assert got["c4"].record == '{"arguments":{"s":"\U0001f600"},"id":"c4","name":"t","result":"é"}'


def test_several_parents_and_the_right_result(spark):
    shape = CALLS.replace("after string", "after array<string>")
    calls = [(1, "a", 0, "f", '{"x":1}', None), (1, "b", 1, "f", '{"x":1}', []), (1, "c", 2, "f", '{"x":1}', ["a", "b", "gone", "a"]), (1, "d", 3, "f", '{"x":1}', ["a", "c"]), (1, "e", 4, "f", '{"x":1}', ["d", "p"]), (1, "p", 5, "f", '{"x":1}', ["q", "a"]), (1, "q", 6, "f", '{"x":1}', ["p"]), (1, "r", 7, "f", '{"x":1}', [None, "b"])]
    results = [(1, "b", 0, "before"), (1, "b", 3, "after"), (1, "b", 9, "later"), (1, "c", 1, "early")]
    got = {r.call_id: r for r in link_calls(spark.createDataFrame(calls, shape), spark.createDataFrame(results, RESULTS), SCHEMA).collect()}
    assert {c: r.layer for c, r in got.items()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": None, "p": None, "q": None, "r": 1}
    assert got["e"].error == got["p"].error == "cycle"
    assert got["b"].linked and json.loads(got["b"].record)["result"] == "after" and not got["c"].linked
    one = [(*c[:5], c[5][:1] if c[5] else c[5]) for c in calls[:4]]
    assert sorted(r.layer for r in link_calls(spark.createDataFrame(one, shape), spark.createDataFrame([], RESULTS), SCHEMA).collect()) == [0, 0, 1, 1]


@pytest.mark.parametrize(
    ("value", "schema", "want"),
    [
        (None, {"type": ["string", "null"]}, None), (3, {"type": ["string", "null"]}, "arguments is no string or null"), (True, {"enum": [1]}, "arguments is none of its values"), (1.0, {"enum": [1]}, None),
        (2, {"const": 1}, "arguments is not its value"), (5, {"exclusiveMaximum": 5}, "arguments is too large"), (5, {"exclusiveMinimum": 5}, "arguments is too small"), ([1, 1.0], {"uniqueItems": True}, "arguments has an item twice"),
        ([1], {"minItems": 2}, "arguments has too few items"), ([1, 2], {"maxItems": 1}, "arguments has too many items"), ("x", {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "arguments is none of its kinds"),
        ({"a": 1}, {"additionalProperties": {"type": "string"}}, "arguments.a is no string"), ([1], {"items": False}, "arguments[0] is not allowed"), (None, {"anyOf": [{"type": "integer"}, {"type": "null"}]}, None),
    ],
)
def test_more_keywords(value, schema, want):
    assert fault(value, schema) == want


def test_schemas_that_are_not_known_are_refused(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    for schema in ({"type": "object", "properties": {"x": {"pattern": "a"}}}, {"type": "text"}, {"items": {"oneOf": []}}, {"anyOf": [{"not": {}}]}):
        with pytest.raises(ValueError):
            link_calls(calls, results, {"t": schema})


def test_equal_numbers_are_spelt_alike():
    assert {canonical(x) for x in (1, 1.0, 1e0)} == {"1"} and canonical(-0.0) == "0" and canonical([1e22, 10**22, 0.5]) == "[10000000000000000000000,10000000000000000000000,0.5]"
