"""Linking of tool calls and their results in chats.

Calls and results meet in a hash join on conversation and identifier. A call may come after others of
its conversation. Where each comes after one at most, the layers of that order come from pointer doubling, so
a chain of n calls takes log n joins; else calls are taken off in rounds once all that they come after have been. Arguments are held
against the tool's schema, and each call becomes one line of canonical JSON.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tapeloom.llm.common import cut, release

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


#: Keywords of schemas that fault() knows, and those that say nothing about a value.
KNOWN = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems", "uniqueItems", "required", "properties", "additionalProperties", "items", "anyOf"}
SILENT = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
#: Half of a surrogate pair, which JSON can spell but no text can hold.
HALF = re.compile("[\ud800-\udfff]")


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def check_schema(schema, at: str = "schema") -> None:
    """ValueError if schema has a keyword or type that fault() does not know, so that none is passed over."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at} is no schema")
    for name in schema:
        if name not in KNOWN | SILENT:
            raise ValueError(f"{at}: keyword {name} is not supported")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in KINDS:
            raise ValueError(f"{at}: type {kind} is not known")
    for name, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{name}")
    for i, own in enumerate(schema.get("anyOf", ())):
        check_schema(own, f"{at}.anyOf[{i}]")
    for name in ("items", "additionalProperties"):
        if name in schema:
            check_schema(schema[name], f"{at}.{name}")


def _is(value, kind: str) -> bool:
    return isinstance(value, KINDS[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def fault(value, schema: dict, at: str = "arguments") -> str | None:
    """The first fault of value under schema, by the keywords of KNOWN. A whole number that is written as a fraction (1.0) is a number but no integer."""
    if isinstance(schema, bool):
        return None if schema else f"{at} is not allowed"
    kinds = schema.get("type")
    if isinstance(value, float) and not math.isfinite(value):
        return f"{at} is no finite number"
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at} is no {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return f"{at} is none of its values"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at} is not its value"
    if "anyOf" in schema and all(fault(value, own, at) for own in schema["anyOf"]):
        return f"{at} is none of its kinds"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            return f"{at} is too small"
        if "maximum" in schema and value > schema["maximum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            return f"{at} is too large"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at} is too short"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{at} is too long"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in sorted(schema.get("required", ())):
            if name not in value:
                return f"{at}.{name} is missing"
        for name in sorted(value):
            if name in own:
                if found := fault(value[name], own[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name} is unknown"
            elif found := fault(value[name], schema.get("additionalProperties", True), f"{at}.{name}"):
                return found
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            return f"{at} has too few items"
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            return f"{at} has too many items"
        if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
            return f"{at} has an item twice"
        for i, x in enumerate(value):
            if found := fault(x, schema.get("items", True), f"{at}[{i}]"):
                return found
    return None


def _plain(value):
    """value with every number that is whole as a whole number, so that equal values are spelt alike."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, no escapes beyond those that JSON asks for, and one spelling for each number."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _peeled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """layers() of calls(conv_id, call_id) with edges(conv_id, call_id, to): each round takes those calls that wait for none, and their edges; one more round than there are layers."""
    left, waits = cut(calls), cut(edges)
    layer, done = 0, []
    while True:
        held = waits.select("conv_id", "call_id").distinct()
        free = cut(left.join(held, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(layer).cast("long").alias("layer")))
        if not free.head(1):
            rest = left.select("conv_id", "call_id", F.lit(None).cast("long").alias("layer"))
            return reduce(DataFrame.union, [*done, rest])
        done.append(free)
        left2 = cut(left.join(free, ["conv_id", "call_id"], "left_anti"))
        waits2 = cut(waits.join(free.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti").select("conv_id", "call_id", "to"))
        release(left, waits)
        left, waits, layer = left2, waits2, layer + 1


def layers(calls: DataFrame) -> DataFrame:
    """calls(conv_id, call_id, after) with layer: 0 for a call after none that is there, else one more than the highest of those calls'; null on a cycle and after one. after: an identifier or an array of them."""
    if isinstance(calls.schema["after"].dataType, ArrayType):
        own = cut(calls.select("conv_id", "call_id"))
        edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("to")).join(own.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi").select("conv_id", "call_id", "to")
        edges = cut(edges)
        if edges.groupBy("conv_id", "call_id").count().where(F.col("count") > 1).head(1):
            return _peeled(own, edges)
        calls = own.join(edges.withColumnRenamed("to", "after"), ["conv_id", "call_id"], "left")
    keyed = calls.select("conv_id", "call_id", F.col("after").alias("to"))
    there = keyed.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("there"))
    at = cut(keyed.join(there, ["conv_id", "to"], "left").select("conv_id", "call_id", F.when(F.col("there"), F.col("to")).alias("to"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("layer")))
    limit = max(1, at.count()).bit_length() + 1
    for _ in range(limit):
        if not at.where("to IS NOT NULL").head(1):
            break
        further = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("layer").alias("more"))
        at = cut(at.join(further, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("layer") + F.coalesce("more", F.lit(0))).alias("layer")))
    return at.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("layer")).alias("layer"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, seq, layer, linked, valid, error, record for every call and every result without one.

    calls has conv_id, call_id, seq, name, arguments (JSON text) and after (an identifier of the same
    conversation, or an array of them); results has conv_id, call_id, seq, content. Conversation, layer, seq and
    call_id give a topological order. Of calls, or results, that repeat an identifier the one with
    the smallest seq (then the smallest other fields) stands, of results the smallest that is beyond the call's. A result without a call, or whose call
    comes later, is not linked; a result alone gives a row with error "no call" and no layer.
    Nulls: a row without a conversation or identifier is not linked to any; as a call it has layer 0.
    A schema with a keyword beyond KNOWN and SILENT raises ValueError before anything runs. Null arguments are no JSON, numbers beyond a double's range and halves of surrogate pairs are errors, a null content is a JSON null, an unknown or null name is an error. record is
    null unless the call is valid. Further columns are not read. Empty tables give an empty table.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    columns = ("seq", "name", "arguments", "after")
    first = calls.where(whole).groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("c"))
    first = cut(first.select("conv_id", "call_id", *[f"c.{c}" for c in columns]))
    met = results.where(whole).select("conv_id", "call_id", "seq", "content").join(first.select("conv_id", "call_id", F.col("seq").alias("called_at")).hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    answer = F.struct("seq", "content")
    answers = met.groupBy("conv_id", "call_id").agg(F.coalesce(F.min(F.when(F.col("seq") > F.col("called_at"), answer)), F.min(answer)).alias("r"))
    placed = first.join(layers(first), ["conv_id", "call_id"])
    joined = placed.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full").withColumn("called", F.col("seq").isNotNull() | F.col("layer").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull())
    joined = joined.withColumn("linked", F.col("called") & F.col("r").isNotNull() & F.coalesce(F.col("r.seq") > F.col("seq"), F.lit(False)))
    fields = ["conv_id", "call_id", F.coalesce("seq", "r.seq").alias("seq"), "layer", "linked", "called", "name", "arguments", F.when(F.col("linked"), F.col("r.content")).alias("content")]
    loose = calls.where(~whole).select("conv_id", "call_id", "seq", F.lit(0).cast("long").alias("layer"), F.lit(False).alias("linked"), F.lit(True).alias("called"), "name", "arguments", F.lit(None).cast("string").alias("content"))
    alone = results.where(~whole).select("conv_id", "call_id", "seq", F.lit(None).cast("long").alias("layer"), F.lit(False).alias("linked"), F.lit(False).alias("called"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("string").alias("content"))
    rows = joined.select(*fields).union(loose).union(alone)
    head = ("conv_id", "call_id", "seq", "layer", "linked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, records = [], []
            for r in batch.to_pylist():
                error = record = None
                if not r["called"]:
                    error = "no call"
                elif r["layer"] is None:
                    error = "cycle"
                elif r["name"] not in schemas:
                    error = "unknown tool"
                else:
                    try:
                        value = json.loads(r["arguments"] or "", parse_constant=_no_constant)
                        if HALF.search(json.dumps(value, ensure_ascii=False)):
                            error = "arguments hold half a surrogate pair"
                        else:
                            error = fault(value, schemas[r["name"]])
                            whole = {"arguments": value, "id": r["call_id"], "name": r["name"]} | ({"result": r["content"]} if r["linked"] else {})
                            record = canonical(whole) if error is None else None
                    except (ValueError, RecursionError):  # a float beyond all bounds where the schema does not look, too
                        error = "arguments are no JSON"
                errors.append(error)
                records.append(record)
            valid = pa.array([e is None for e in errors], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], valid, pa.array(errors, pa.string()), pa.array(records, pa.string())], names=[*head, "valid", "error", "record"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*head).schema)
    return rows.mapInArrow(run, f"{shape}, valid boolean, error string, record string")


#: Schemas of the tools that the query's calls name.
SCHEMAS = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 80}}},
    "count": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}}},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as conversations(conv_id, turn, role, text) imply them.

    An assistant's turn asks a tool about its text, and the user's turn after it is the result. By
    the length of the text every third call comes after the assistant's call before, some name an
    unknown tool and some ask for more than the schema allows. A user's first turn answers no call.
    """
    size = F.length("text")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    name = F.when(size % 11 == 0, "weather").when(size % 2 == 0, "search").otherwise("count")
    search = F.concat(F.lit('{"query": "'), word, F.lit('",  "limit": '), (size % 97).cast("string"), F.lit("}"))
    count = F.concat(F.lit('{"n":'), size.cast("string"), F.lit("}"))
    ident = lambda back: F.concat(F.lit("call_"), (F.col("turn") - back).cast("string"))
    calls = conversations.where("role = 'assistant'").select("conv_id", ident(0).alias("call_id"), F.col("turn").alias("seq"), name.alias("name"), F.when(size % 2 == 0, search).otherwise(count).alias("arguments"), F.when(size % 3 == 0, ident(2)).alias("after"))
    results = conversations.where("role = 'user'").select("conv_id", ident(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn AS seq, length(text) AS n, regexp_extract(text, '[A-Za-z]+') AS word,
    CASE WHEN length(text) % 11 = 0 THEN 'weather' WHEN length(text) % 2 = 0 THEN 'search' ELSE 'count' END AS name, text,
    CASE WHEN length(text) % 3 = 0 THEN 'call_' || (turn - 2) END AS after FROM conversations WHERE role = 'assistant'),
one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY seq, name, text) = 1),
r AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, min(turn) AS seq, min(text) AS content FROM conversations WHERE role = 'user' GROUP BY ALL),
deep AS (
  SELECT conv_id, call_id, 0 AS layer FROM one o WHERE NOT EXISTS (SELECT 1 FROM one p WHERE p.conv_id = o.conv_id AND p.call_id = o.after)
  UNION ALL SELECT o.conv_id, o.call_id, d.layer + 1 FROM one o JOIN deep d ON o.conv_id = d.conv_id AND o.after = d.call_id),
j AS (
  SELECT coalesce(o.conv_id, r.conv_id) AS conv_id, coalesce(o.call_id, r.call_id) AS call_id, coalesce(o.seq, r.seq) AS seq, d.layer,
    o.call_id IS NOT NULL AND r.call_id IS NOT NULL AS linked, o.name, o.n, o.word, r.content,
    CASE WHEN o.call_id IS NULL THEN 'no call' WHEN o.name = 'weather' THEN 'unknown tool'
      WHEN o.name = 'search' AND o.n % 97 < 1 THEN 'arguments.limit is too small' WHEN o.name = 'search' AND o.n % 97 > 80 THEN 'arguments.limit is too large'
      WHEN o.name = 'search' AND o.word = '' THEN 'arguments.query is too short' END AS error
  FROM one o LEFT JOIN deep d USING (conv_id, call_id) FULL JOIN r ON o.conv_id = r.conv_id AND o.call_id = r.call_id)
SELECT conv_id, call_id, seq, CAST(coalesce(layer, -1) AS BIGINT) AS layer, linked, error IS NULL AS valid, error,
  CASE WHEN error IS NULL THEN '{"arguments":' || CASE WHEN name = 'search' THEN '{"limit":' || (n % 97) || ',"query":"' || word || '"}' ELSE '{"n":' || n || '}' END
    || ',"id":"' || call_id || '","name":"' || name || '"' || CASE WHEN linked THEN ',"result":' || CAST(to_json(content) AS VARCHAR) ELSE '' END || '}' END AS record
FROM j
"""
