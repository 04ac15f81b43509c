"""Tool-call linking for chat formatting.

Calls and results are hash-joined by identifier, ordered topologically by what they rest on, their arguments validated
against schemas, and each is serialised as canonical JSON: sorted keys, no spaces, no escapes but those that JSON needs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: Any) -> str:  # noqa: ANN401
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: Any, kind: str) -> bool:  # noqa: ANN401
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return isinstance(value, _TYPES[kind])


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:  # noqa: ANN401
    """Where a value breaks a schema of type, enum, required, properties, additionalProperties, items, minimum, maximum,
    minLength and maxLength."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}:type"]
    found = []
    if "enum" in schema and not any(isinstance(value, bool) == isinstance(e, bool) and value == e for e in schema["enum"]):
        found.append(f"{at}:enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}:required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                found += violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}:additional")
    elif isinstance(value, list):
        for i, item in enumerate(value):
            found += violations(item, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, str):
        found += [f"{at}:minLength"] * (len(value) < schema.get("minLength", 0)) + [f"{at}:maxLength"] * (len(value) > schema.get("maxLength", math.inf))
    elif _is(value, "number"):
        found += [f"{at}:minimum"] * (value < schema.get("minimum", -math.inf)) + [f"{at}:maximum"] * (value > schema.get("maximum", math.inf))
    return found


def _constant(name: str) -> None:
    raise ValueError(name)


def _parsed(text: str | None) -> tuple[Any, bool]:
    """The value, and whether it can be written again: numbers beyond a double and lone surrogates cannot."""
    try:
        value = json.loads(text or "", parse_constant=_constant)
        canonical(value).encode()
        return value, True
    except (ValueError, RecursionError):
        return None, False


KEY = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: how many calls a call rests on, one after another; null if it rests on a cycle.

    calls: conv_id, call_id (distinct pairs), after_id. Pointers are doubled, so a chain of n calls takes about log2(n)
    rounds, each written to the checkpoint folder. An after_id that names no call counts as none.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("after_id"))
    known = calls.filter("after_id is not null").join(ids, ["conv_id", "after_id"], "left_semi").select(*KEY, "after_id")
    now = calls.select(*KEY).join(known, KEY, "left").withColumn("level", F.when(F.col("after_id").isNull(), 0).otherwise(1).cast("long")).checkpoint()
    for _ in range(max(1, now.count()).bit_length() + 1):
        if now.filter("after_id is not null").isEmpty():
            break
        step = now.select("conv_id", F.col("call_id").alias("after_id"), F.col("after_id").alias("_next"), F.col("level").alias("_more"))
        open_, done = now.filter("after_id is not null"), now.filter("after_id is null")
        moved = open_.join(step, ["conv_id", "after_id"]).select(*KEY, F.col("_next").alias("after_id"), (F.col("level") + F.col("_more")).alias("level"))
        now = done.unionByName(moved).checkpoint()
    return now.select(*KEY, F.when(F.col("after_id").isNull(), F.col("level")).alias("level"))


LINKED = (
    "conv_id long, call_id string, turn long, name string, level long, result_turn long, n_calls long, n_results long, "
    "status string, errors string, json string"
)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per identifier (conv_id, call_id) of calls, as in LINKED; level, then call_id, is a topological order.

    calls: conv_id, call_id, turn, name, arguments (JSON), after_id (of the call whose result this one uses, or null).
    results: conv_id, call_id, turn, content. Of calls, or results, that repeat an identifier the earliest turn stands, and among
    equal turns the smallest content; n_calls and n_results count all. Rows with a null conv_id or call_id have no
    identifier and are left out; results without a call give no row. status is the first that holds of cycle,
    unknown_tool, bad_json, invalid, before_call (the result comes no later than its call), no_result, ok; errors lists
    what breaks the schema. Null arguments are bad JSON. Empty tables give an empty result; further columns aren't read.
    """
    prepare(calls.sparkSession)
    kept = calls.filter("conv_id is not null and call_id is not null").groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments", "after_id")).alias("c"), F.count("*").alias("n_calls")
    ).select(*KEY, "c.*", "n_calls")
    answers = results.filter("conv_id is not null and call_id is not null").groupBy(*KEY).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")
    ).select(*KEY, F.col("r.turn").alias("result_turn"), "r.content", "n_results")
    linked = kept.join(answers, KEY, "left").join(levels(kept), KEY)
    shared = calls.sparkSession.sparkContext.broadcast(schemas)  # bounded by the tools there are, not by the data

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                arguments, readable = _parsed(r["arguments"])
                schema = shared.value.get(r["name"])
                broken = violations(arguments, schema) if readable and schema is not None else []
                late = r["result_turn"] is not None and r["turn"] is not None and r["result_turn"] <= r["turn"]
                status = next(s for s, holds in (
                    ("cycle", r["level"] is None), ("unknown_tool", schema is None), ("bad_json", not readable), ("invalid", bool(broken)),
                    ("before_call", late), ("no_result", r["n_results"] is None), ("ok", True),
                ) if holds)
                whole = {"id": r["call_id"], "name": r["name"], "arguments": arguments if readable else r["arguments"], "result": r["content"]}
                rows.append((
                    r["conv_id"], r["call_id"], r["turn"], r["name"], r["level"], r["result_turn"], r["n_calls"], r["n_results"] or 0,
                    status, ",".join(broken), canonical(whole),
                ))
            names = [c.split()[0] for c in LINKED.split(", ")]
            kinds = [pa.string() if "string" in c else pa.int64() for c in LINKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    columns = ["conv_id", "call_id", "turn", "name", "arguments", "level", "result_turn", "content", "n_calls", "n_results"]
    return linked.select(F.col("conv_id").cast("long").alias("conv_id"), *columns[1:]).mapInArrow(write, LINKED)


#: The tools that exchanges of `conversations` are written as.
EXCHANGE_TOOLS = {
    "ask": {
        "type": "object", "required": ["query", "turn"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    },
    "brief": {
        "type": "object", "required": ["instruction"], "additionalProperties": False,
        "properties": {"instruction": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    },
}


#: Turns of one conversation that a window holds; of longer ones, only a row per span meets in a window.
SPAN = 4096


def neighbours(conversations: DataFrame) -> DataFrame:
    """conv_id, turn of calls (user and system turns), with answer_turn, the next assistant's turn, and before_turn, the call before."""
    role, turn = F.col("role"), F.col("turn")
    marks = conversations.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(
        F.max(F.when(role == "assistant", turn)).alias("answer"), F.max(F.when(role.isin("user", "system"), turn)).alias("call")
    ).withColumn("span", F.floor(turn / SPAN))
    order = Window.partitionBy("conv_id").orderBy("span")
    spans = marks.groupBy("conv_id", "span").agg(F.min("answer").alias("first"), F.max("call").alias("last")).select(
        "conv_id", "span", F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
        F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
    )
    own = Window.partitionBy("conv_id", "span").orderBy("turn")
    found = marks.withColumns({
        "answer_turn": F.min("answer").over(own.rowsBetween(1, Window.unboundedFollowing)),
        "before_turn": F.max("call").over(own.rowsBetween(Window.unboundedPreceding, -1)),
    }).filter("call is not null").join(spans, ["conv_id", "span"])
    return found.select("conv_id", "turn", F.coalesce("answer_turn", "later").alias("answer_turn"), F.coalesce("before_turn", "earlier").alias("before_turn"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a table of conversations (conv_id, turn, role, text) holds.

    A user's turn is a call of `ask`, a system's one of `brief`; the next assistant's turn of the conversation is its result, so one turn
    may answer several calls. A call rests on the call before it in the conversation. Other roles, and null ones, are neither; rows
    without a conv_id or turn are left out.
    """
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    turn, text = F.col("turn"), F.coalesce(F.col("text"), F.lit(""))
    asked = F.to_json(F.struct(text.alias("query"), turn.alias("turn")))
    told = F.to_json(F.struct(text.alias("instruction"), turn.alias("turn")))
    prepare(conversations.sparkSession)
    near = neighbours(conversations).checkpoint()
    turns = conversations.select("conv_id", "turn", "role", "text")
    # joined by the identifier, so that calls lie where they are linked later
    placed = near.select("conv_id", name(turn).alias("call_id"), name(F.col("before_turn")).alias("after_id"))
    named = turns.filter(F.col("role").isin("user", "system")).withColumn("call_id", name(turn))
    calls = named.join(placed, KEY).select(
        "conv_id", "call_id", "turn", F.when(F.col("role") == "user", "ask").otherwise("brief").alias("name"),
        F.when(F.col("role") == "user", asked).otherwise(told).alias("arguments"), "after_id",
    )
    answered = near.select("conv_id", name(turn).alias("call_id"), F.col("answer_turn").alias("turn"))
    results = turns.filter("role = 'assistant'").join(answered, ["conv_id", "turn"]).select(
        "conv_id", "call_id", "turn", F.col("text").alias("content")
    )
    return calls, results
