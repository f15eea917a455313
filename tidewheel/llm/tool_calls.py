"""Chat formatting: tool calls linked with results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: What the query's two tools take.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 60}}, "required": ["query", "limit"]},
    "lookup": {"properties": {"query": {"type": "string", "minLength": 1}}, "required": ["query"]},
}


def _no_constant(name: str):
    raise ValueError(name)


def _finite(text: str) -> float:
    if math.isinf(out := float(text)):
        raise ValueError(text)
    return out


def read(arguments: str | None):
    """The value of JSON arguments; ValueError if they are none, hold NaN, infinities or numbers beyond the range of doubles, or are nested too deeply to read."""
    try:
        return json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def _is(x, kind: str) -> bool:
    return isinstance(x, TYPES[kind]) and (kind == "boolean" or not isinstance(x, bool))


def _fault(x, rule: dict, path: str) -> str | None:
    """The first fault of a value: its own type, choice, length and range before those inside it, in order of names."""
    kinds = rule.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(x, k) for k in kinds):
        return f"type of {path}" if path else "not an object"
    if "enum" in rule and not any(x == y and isinstance(x, bool) == isinstance(y, bool) for y in rule["enum"]):
        return f"choice of {path}"
    if isinstance(x, str | list):
        low, high = ("minLength", "maxLength") if isinstance(x, str) else ("minItems", "maxItems")
        if not rule.get(low, 0) <= len(x) <= rule.get(high, len(x)):
            return f"length of {path}"
    if isinstance(x, int | float) and not isinstance(x, bool) and not rule.get("minimum", x) <= x <= rule.get("maximum", x):
        return f"range of {path}"
    if isinstance(x, dict) and ("properties" in rule or "required" in rule):
        at = f"{path}." if path else ""
        for name in sorted(rule.get("required", [])):
            if name not in x:
                return f"missing {at}{name}"
        for name in sorted(x):
            inner = rule.get("properties", {}).get(name)
            if inner is None:
                if not rule.get("additionalProperties", False):
                    return f"unexpected {at}{name}"
            elif found := _fault(x[name], inner, at + name):
                return found
    if isinstance(x, list) and "items" in rule:
        return next((found for j, y in enumerate(x) if (found := _fault(y, rule["items"], f"{path}[{j}]"))), None)
    return None


def faults(arguments: str | None, schema: dict | None) -> str | None:
    """What is wrong with a call's arguments, the first fault in order of names; None if nothing is.

    Schemas may use type (one or several), enum, properties, required, additionalProperties (false unless given), items, and bounds of
    numbers, strings and arrays, at any depth.  Arguments that can't be read, or are nested too deeply for that, are not JSON.
    """
    if schema is None:
        return "unknown tool"
    try:
        found = _fault(read(arguments), {"type": "object"} | schema, "")
        return found and _escaped(found)
    except ValueError:
        return "not JSON"


def _escaped(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't hold, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted names, no spaces and characters as they are; halves of surrogate pairs, which UTF-8 can't hold, as escapes."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _escaped(out)


def depths(calls: DataFrame) -> DataFrame:
    """(conv, call, depth): how many calls come before one by way of `after`; null on or behind a cycle.

    Pointer jumping: after r rounds a pointer leads 2**r calls up.  A round in which no call gets its depth leaves
    only calls that lead into cycles.
    """
    known = calls.select("conv", F.col("call").alias("after"), F.lit(1).alias("there"))
    now = calls.join(known, ["conv", "after"], "left").select("conv", "call", F.when(F.col("there") == 1, F.col("after")).alias("up"))
    now = staged(now.withColumn("n", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "depths")
    open_before = now.filter("up is not null").count()
    while open_before:
        far = now.select("conv", F.col("call").alias("up"), F.col("up").alias("upper"), F.col("n").alias("m"))
        step = now.join(far, ["conv", "up"], "left")
        new = staged(step.select("conv", "call", F.col("upper").alias("up"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "depths")
        discard(now)
        now, still = new, new.filter("up is not null").count()
        if still == open_before:
            break
        open_before = still
    return now.select("conv", "call", F.when(F.col("up").isNull(), F.col("n")).alias("depth"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """(conv, call, turn, depth, is_linked, fault, record) for each call, in topological order.

    calls: (conv, call, turn, name, arguments, after); results: (conv, call, turn, content).  Rows are joined by
    (conv, call).  Of calls, or of results, that repeat an identifier the first by turn, then by content, counts.
    A result without a call is dropped, a call without a result stays with is_linked false, a call
    whose `after` isn't there starts a chain.  Rows without conv or call are dropped.  The output is sorted by conv, depth,
    turn and call over range partitions, so that a long conversation is spread.  record: canonical JSON; arguments that can't be
    read stay as the string they are.
    """
    one = calls.filter("conv is not null and call is not null").groupBy("conv", "call").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select("conv", "call", "c.*")
    one = staged(one, "calls")
    answer = results.groupBy("conv", "call").agg(F.min(F.struct("turn", "content")).alias("r"))
    both = one.join(answer, ["conv", "call"], "left").join(depths(one), ["conv", "call"])

    def run(batches):
        for batch in batches:
            fault, record = [], []
            for call, name, arguments, after, content, has in zip(*(batch.column(c).to_pylist() for c in ("call", "name", "arguments", "after", "content", "is_linked")), strict=True):
                fault.append(faults(arguments, schemas.get(name)))
                rest = {"after": after, "id": call, "name": name, "result": {"content": content} if has else None}
                try:
                    record.append(canonical(rest | {"arguments": read(arguments)}))
                except (ValueError, RecursionError):
                    record.append(canonical(rest | {"arguments": arguments}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "call", "turn", "depth", "is_linked")), pa.array(fault, pa.string()), pa.array(record, pa.string())],
                ["conv", "call", "turn", "depth", "is_linked", "fault", "record"],
            )

    flat = both.select("conv", "call", "turn", "name", "arguments", "after", "depth", F.col("r").isNotNull().alias("is_linked"), F.col("r.content").alias("content"))
    out = flat.mapInArrow(run, "conv long, call string, turn long, depth long, is_linked boolean, fault string, record string")
    return out.orderBy("conv", "depth", "turn", "call")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool use: a user turn calls a tool with its text, and the turn after it holds the result.

    A call comes after the call two turns before.  Its tool follows from the conversation and turn; one in three is unknown.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    words = F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long")
    query = F.coalesce("text", F.lit(""))
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("draw")), F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 2), F.lit(3)).cast("int") + 1)
    calls = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("conv"), name(0).alias("call"), "turn", tool.alias("name"),
        F.when(tool == "search", F.to_json(F.struct(query.alias("query"), words.alias("limit")))).otherwise(F.to_json(F.struct(query.alias("query")))).alias("arguments"),
        F.when(F.col("turn") >= 2, name(2)).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(1).alias("call"), "turn", F.col("text").alias("content"))
    return linked(calls, results, SCHEMAS).select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), "turn", "depth", "is_linked", "fault", "record")


OP4_SQL = r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, ['search', 'lookup', 'draw'][CAST((conv_id + turn // 2) % 3 AS INTEGER) + 1] AS name, coalesce(text, '') AS text,
         len(string_split(coalesce(text, ''), ' ')) AS n
  FROM conversations WHERE role = 'user'),
c AS (
  SELECT conv_id, turn, min(struct_pack(name := name, text := text, n := n)) AS x FROM u GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, min(struct_pack(content := text)) AS y FROM conversations WHERE role = 'assistant' GROUP BY ALL),
d AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM c WHERE turn < 2 OR (conv_id, turn - 2) NOT IN (SELECT (conv_id, turn) FROM c)
  UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.turn = d.turn + 2)
SELECT c.conv_id, 'c' || c.conv_id || '-' || c.turn AS call_id, c.turn, d.depth, r.y IS NOT NULL AS is_linked,
  CASE WHEN x.name = 'draw' THEN 'unknown tool' WHEN x.name = 'search' AND x.n > 60 THEN 'range of limit' WHEN x.text = '' THEN 'length of query' END AS fault,
  '{"after":' || CASE WHEN c.turn >= 2 THEN '"c' || c.conv_id || '-' || (c.turn - 2) || '"' ELSE 'null' END || ',"arguments":{'
  || CASE WHEN x.name = 'search' THEN '"limit":' || x.n || ',' ELSE '' END || '"query":' || CAST(to_json(x.text) AS VARCHAR) || '},"id":"c' || c.conv_id || '-' || c.turn
  || '","name":"' || x.name || '","result":' || CASE WHEN r.y IS NULL THEN 'null' ELSE '{"content":' || coalesce(CAST(to_json(r.y.content) AS VARCHAR), 'null') || '}' END || '}' AS record
FROM c JOIN d USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
"""
