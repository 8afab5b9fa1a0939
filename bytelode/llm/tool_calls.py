"""Tool-call linking in conversations (operator 5).

Calls and results are joined by conversation and identifier; a result stands after its call wherever
it was logged, and a call after the results it depends on; arguments are checked against the schema of their tool;
every record is written as canonical JSON (keys sorted, no spaces, UTF-8 as it is).

There is one row per call and per result, so a conversation of any length is spread over tasks: its rows
sorted by level, place, kind and turn are the topological order.  Levels are found by joins, as many as the
longest chain of dependencies; calls in a cycle get level -1.

Nulls and ties: records without identifier stay unlinked; of several calls with one identifier in a
conversation the earliest is linked and the others are called duplicates; a result without call is an
orphan.  Of equal calls in one turn the first in place is linked.  Arguments that are not a JSON object are invalid;
those that are no JSON, hold numbers that JSON lacks or are nested too deeply to be read are kept as a string.
Lone surrogates are written as escapes.  Null arguments are invalid, empty texts no JSON; tables without rows give none."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

EMBEDDED = "tool_calls array<struct<id string, name string, arguments string, depends_on array<string>>>"
TYPES: dict[str, tuple] = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks the schema: type, enum, minLength, minimum, required, properties,
    additionalProperties and items are understood."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, (int, float)) and value < schema.get("minimum", value):
        out.append(f"{at}: too small")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in value if k not in known]
        for k, v in value.items():
            out += faults(v, known.get(k, {}), f"{at}.{k}")
    if isinstance(value, list):
        for i, v in enumerate(value):
            out += faults(v, schema.get("items", {}), f"{at}[{i}]")
    return out


def plain(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 lacks, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return plain(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False))


def call_record(call: str | None, name: str | None, body: str | None, schemas: dict[str, dict]) -> tuple[str, list[str]]:
    """Canonical JSON of a call and what of its arguments breaks the schema."""

    def made(value: Any) -> tuple[str, list[str]]:
        wrong = faults(value, {"type": "object"} | schemas[name]) if name in schemas else [f"no tool {name}"]
        return canonical({"arguments": value, "id": call, "name": name}), [plain(w) for w in wrong]

    try:
        return made(json.loads(body if body is not None else "null"))
    except (ValueError, RecursionError):
        return made(body)


def embedded_calls(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position, call_id, name, arguments, depends_on of calls logged as JSON in assistant turns."""
    found = turns.where("role = 'assistant' AND text LIKE '%\"tool_calls\"%'").select("conv_id", "turn", F.from_json("text", EMBEDDED).alias("j"))
    found = found.select("conv_id", "turn", F.posexplode("j.tool_calls").alias("position", "c"))
    return found.select("conv_id", "turn", "position", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.depends_on")


def embedded_results(turns: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content of tool turns, JSON with tool_call_id and content."""
    found = turns.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("j"))
    return found.select("conv_id", "turn", F.col("j.tool_call_id").alias("call_id"), "j.content")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls that depend on others; all other calls have level 0."""
    deps = calls.where(F.size("depends_on") > 0).select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    deps = checkpointed(deps.where("call_id IS NOT NULL").distinct())
    waiting = deps.select("conv_id", "call_id").distinct()
    done, level = None, 0
    left = waiting.count()
    while left:
        level += 1
        open_ = waiting.select("conv_id", F.col("call_id").alias("on"))
        blocked = deps.join(open_, ["conv_id", "on"], "left_semi").select("conv_id", "call_id").distinct()
        still = checkpointed(waiting.join(blocked, ["conv_id", "call_id"], "left_semi"))
        ready = waiting.join(still, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level))
        now = still.count()
        if now == left:  # what is left waits for itself
            ready, now = waiting.withColumn("level", F.lit(-1)), 0
        done = ready if done is None else done.unionByName(ready)
        waiting, left = still, now
    empty = waiting.withColumn("level", F.lit(0)).limit(0)
    return empty if done is None else done


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and result: conv_id, level, place, kind (0 call, 1 result), turn, call_id, linked,
    status (ok, pending, orphan, duplicate, invalid), errors and json."""
    first = calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min("turn").alias("call_turn"), F.min_by("position", F.struct(F.col("turn").isNull(), "turn", "position")).alias("call_position")
    )
    first = first.join(levels(calls), ["conv_id", "call_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    answered = results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.lit(True).alias("answered"))
    known = calls.join(first, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    kept = F.col("call_turn").eqNullSafe(F.col("turn")) & F.col("call_position").eqNullSafe(F.col("position"))
    rows = known.select(
        "conv_id", F.coalesce("level", F.lit(0)).alias("level"), F.col("turn").alias("place"), F.lit(0).alias("kind"), "turn", "call_id",
        (kept & F.col("answered").isNotNull()).alias("linked"),
        F.when(F.col("call_turn").isNotNull() & ~kept, "duplicate").when(F.col("answered").isNull(), "pending").otherwise("ok").alias("status"),
        "name", F.col("arguments").alias("body"),
    )
    back = results.join(first, ["conv_id", "call_id"], "left").select(
        "conv_id", F.coalesce("level", F.lit(0)).alias("level"), F.greatest("turn", "call_turn").alias("place"), F.lit(1).alias("kind"), "turn", "call_id",
        F.col("call_turn").isNotNull().alias("linked"),
        F.when(F.col("call_turn").isNull(), "orphan").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("name"), F.col("content").alias("body"),
    )
    both = rows.unionByName(back)

    def run(batches):
        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns) if n in ("kind", "call_id", "status", "name", "body")}
            status, errors, out = [], [], []
            for kind, call, state, name, body in zip(*(columns[n] for n in ("kind", "call_id", "status", "name", "body"))):
                wrong: list[str] = []
                if kind == 0:
                    record, wrong = call_record(call, name, body, schemas)
                else:
                    record = canonical({"content": body, "tool_call_id": call})
                status.append("invalid" if wrong and state in ("ok", "pending") else state)
                errors.append(wrong)
                out.append(record)
            keep = [batch.schema.get_field_index(n) for n in ("conv_id", "level", "place", "kind", "turn", "call_id", "linked")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())],
                names=["conv_id", "level", "place", "kind", "turn", "call_id", "linked", "status", "errors", "json"],
            )

    t = both.schema
    kinds = ", ".join(f"{n} {t[n].dataType.simpleString()}" for n in ("conv_id", "level", "place", "kind", "turn", "call_id", "linked"))
    return both.mapInArrow(run, f"{kinds}, status string, errors array<string>, json string")


def replies_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call of the tool ``reply`` and the assistant turn after it as its result."""
    named = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    users = turns.where("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("position"), named(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text")).alias("arguments"), F.array().cast("array<string>").alias("depends_on")
    )
    replies = turns.where("role = 'assistant'").select("conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return users, replies


#: The tool of ``replies_as_calls``.
REPLY = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
