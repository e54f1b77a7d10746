"""Tool-call linking for chat formatting.

Messages are parsed into calls and results. Results are hash-joined to calls by identifier. Calls are placed on levels
so that every call stands above all calls it depends on: (level, turn, place) is a topological order of a conversation.
Arguments are checked against the tool's schema, and each linked call is serialised as canonical JSON: keys in order of
their code points, no white space, no escapes but those that JSON requires. A lone surrogate stays an escape.

Message forms (``text`` of a turn):

* ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}`` from the assistant: calls;
* ``{"tool_call_id", "content"}`` from a tool: a result;
* anything else is plain text, also JSON with NaN or numbers out of range, or nested over DEPTH levels. Plain turns are
  taken as calls of the built-in tools ``instruct`` (a system turn) and ``respond`` (a user turn, which depends on the
  conversation's turn 0 where that is another call); an assistant's plain turn is the result of the turn before it. The
  identifier of a plain call is ``conversation:turn``.

Levels: a conversation of at most SORTED dependencies is sorted in one pass inside a task. A larger one, however hot,
is placed by rounds of joins over all tasks, as many as its longest chain.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import as_text, dropped, saved, slices

#: Tool name -> schema of its arguments.
SCHEMAS: dict[str, dict[str, Any]] = {
    "instruct": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "respond": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False},
}
#: JSON nested deeper is plain text.
DEPTH = 100
#: Dependencies of a conversation that a task sorts at once.
SORTED = 50_000
_LONE = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def _escaped(text: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _name(value: Any) -> str:
    """An identifier, tool name or content as text."""
    return value if isinstance(value, str) else canonical(value)


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return kind not in _TYPES or isinstance(value, _TYPES[kind])


def violation(value: Any, schema: dict[str, Any], at: str = "$") -> str | None:
    """The first rule of the schema that the value breaks, as ``path: rule``; None if it keeps them all. ``type`` is a
    name or a list of names, of which one must hold; an unknown name holds for anything."""
    kind = schema.get("type")
    if kind and not any(_is(value, k) for k in ([kind] if isinstance(kind, str) else kind)):
        return f"{at}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: enum"
    if isinstance(value, str):
        for rule, broken in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))):
            if broken:
                return f"{at}: {rule}"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        for rule, broken in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))):
            if broken:
                return f"{at}: {rule}"
    elif isinstance(value, list):
        for i, x in enumerate(value):
            if (found := violation(x, schema.get("items", {}), f"{at}[{i}]")) is not None:
                return found
    elif isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return _escaped(f"{at}.{name}: required")
        properties = schema.get("properties", {})
        for name in sorted(value):
            if name in properties:
                if (found := violation(value[name], properties[name], _escaped(f"{at}.{name}"))) is not None:
                    return found
            elif schema.get("additionalProperties") is False:
                return _escaped(f"{at}.{name}: additionalProperties")
    return None


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def _deeper(value: Any, most: int) -> bool:
    level = [value]
    for _ in range(most + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def _object(text: str) -> dict[str, Any]:
    if text.lstrip()[:1] != "{":
        return {}
    try:
        found = json.loads(text, parse_float=_finite, parse_constant=_finite)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) and not _deeper(found, DEPTH) else {}


def parsed(conv: int | None, turn: int | None, role: str | None, text: str) -> Iterator[tuple]:
    """Records (kind, id, place, name, arguments, depends_on, content) of one message."""
    message = _object(text)
    if role == "assistant" and isinstance(message.get("tool_calls"), list):
        for place, call in enumerate(x for x in message["tool_calls"] if isinstance(x, dict)):
            depends = call.get("depends_on") if isinstance(call.get("depends_on"), list) else []
            yield "call", f"{conv}:{_name(call.get('id'))}", place, _name(call.get("name")), call.get("arguments"), [f"!{conv}:{_name(d)}" for d in depends], None
    elif role == "tool" and "tool_call_id" in message:
        content = message.get("content")
        yield "result", f"{conv}:{_name(message['tool_call_id'])}", 0, None, None, [], _name(content)
    elif role in ("system", "user") and turn is not None:
        arguments = {"text": text} if role == "system" else {"text": text, "turn": turn}
        yield "call", f"{conv}:{turn}", 0, "instruct" if role == "system" else "respond", arguments, [] if role == "system" or turn == 0 else [f"?{conv}:0"], None
    elif role == "assistant" and turn is not None:
        yield "result", f"{conv}:{turn - 1}", 0, None, None, [], text


RECORD = "kind string, id string, conv_id long, turn long, place long, name string, arguments string, violation string, depends_on array<string>, content string, id_json string, name_json string, content_json string"


def _text(value: str | None) -> str | None:
    return None if value is None else _escaped(value)


def _quoted(value: str | None) -> str | None:
    return None if value is None else canonical(value)


def records(messages: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """Calls and results of all messages; arguments are checked, and every part of a line is canonical JSON already."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for conv, turn, role, text in zip(part.column("conv_id").to_pylist(), part.column("turn").to_pylist(), part.column("role").to_pylist(), as_text(part.column("text"))):
                for kind, ident, place, name, arguments, depends, content in parsed(conv, turn, role, text):
                    call = kind == "call"
                    broken = (violation(arguments, schemas[name]) if name in schemas else "$: unknown tool") if call else None
                    texts = (_text(ident), _text(name), _text(content)), (_quoted(ident), _quoted(name), _quoted(content))
                    rows.append((kind, texts[0][0], conv, turn, place, texts[0][1], canonical(arguments) if call else None, broken, [_escaped(d) for d in depends], texts[0][2], *texts[1]))
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in RECORD.split(", ")])

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(read, RECORD)


def _topological(wanted: dict[str, list[str]]) -> dict[str, int | None]:
    """Level of each id from the ids it depends on; None on a cycle, or above one or above an id that is missing."""
    above, open_, level, depth = defaultdict(list), {}, dict.fromkeys(wanted), {}
    for i, deps in wanted.items():
        open_[i] = len(deps)
        for d in deps:
            above[d].append(i)
    # What is depended on and depends on nothing itself stands on level 0.
    ready = [d for d in above if d not in wanted and d is not None]
    depth.update(dict.fromkeys(ready, 0))
    for d in ready:
        for i in above[d]:
            depth[i] = max(depth.get(i, 0), depth[d] + 1)
            open_[i] -= 1
            if not open_[i]:
                level[i] = depth[i]
                ready.append(i)
    return level


def _levels_in_tasks(edges: DataFrame) -> DataFrame:
    """Levels of conversations that a task can hold."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(wanted: dict[str, list[str]]) -> pa.RecordBatch:
            found = _topological(wanted)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["id", "level"])

        now, wanted = None, {}
        for batch in batches:
            for conv, i, d in zip(*(batch.column(c).to_pylist() for c in ("conv", "id", "dep"))):
                if conv != now and wanted:
                    yield out(wanted)
                    wanted = {}
                now = conv
                wanted.setdefault(i, []).append(d)
        if wanted:
            yield out(wanted)

    return edges.select("conv", "id", "dep").repartition("conv").sortWithinPartitions("conv").mapInArrow(sort, "id string, level long")


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """Levels of conversations of any size: each round places the calls whose dependencies are all placed."""
    base = edges.where("dep IS NOT NULL").select(F.col("dep").alias("id")).distinct().join(edges.select("id").distinct(), "id", "left_anti")
    every = saved(base.select("id", F.lit(0).cast("long").alias("level")), "placed")
    while True:
        waiting = edges.join(every.select("id"), "id", "left_anti").join(every.withColumnRenamed("id", "dep"), "dep", "left")
        ready = waiting.groupBy("id").agg(F.max("level").alias("top"), F.count("level").alias("met"), F.count(F.lit(1)).alias("all")).where("met = all")
        more = saved(every.unionByName(ready.select("id", (F.col("top") + 1).alias("level"))), "placed")
        same = more.count() == every.count()
        dropped(every)
        every = more
        if same:
            return edges.select("id").distinct().join(every, "id", "left")


def levels(calls: DataFrame, at_once: int = SORTED) -> DataFrame:
    """``(id, level)`` of the calls that depend on others: one more than the highest level they depend on; null on a
    cycle or above one. Calls that aren't in the table stand on level 0.

    Dependencies are marked ``!`` or ``?`` before the id; one marked ``?`` that names no call, or the call itself, is
    dropped, one marked ``!`` that names no call leaves its call without a level.
    """
    edges = calls.select("conv", "id", F.explode("depends_on").alias("wanted")).distinct()
    edges = edges.withColumn("dep", F.expr("substring(wanted, 2)")).withColumn("optional", F.col("wanted").startswith("?"))
    known = calls.select(F.col("id").alias("dep")).distinct().withColumn("known", F.lit(True))
    edges = edges.join(known.hint("shuffle_hash"), "dep", "left").where("(known AND NOT (optional AND dep = id)) OR NOT optional")
    edges = saved(edges.select("conv", "id", F.when(F.col("known"), F.col("dep")).alias("dep")), "dependencies")
    sizes = edges.groupBy("conv").count()
    large = sizes.where(F.col("count") > at_once).select("conv")
    in_tasks = _levels_in_tasks(edges.join(large.hint("shuffle_hash"), "conv", "left_anti"))
    if large.isEmpty():
        return in_tasks
    return in_tasks.unionByName(_levels_by_rounds(saved(edges.join(large, "conv", "left_semi").select("id", "dep"), "large")))


def linked_calls(messages: DataFrame, schemas: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """One row per call: conv_id, turn, place, call_id, name, level, valid, violation, n_results, line.

    ``line`` is the canonical JSON of the call with its result. The result is the one of the earliest turn, the least
    content first among equals; n_results counts all. level is null for calls on a cycle or with a dependency that
    doesn't exist. Repeated rows give a row each and share results. Null ids, turns and roles never match anything but
    themselves as text; messages of other roles and plain turns without a number are passed over; a null text is empty.
    """
    table = saved(records(messages, schemas or SCHEMAS), "records")
    calls = table.where("kind = 'call'")
    results = table.where("kind = 'result'").groupBy("id").agg(F.min(F.struct("turn", "content", "content_json")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    above = levels(calls.select(F.substring_index("id", ":", 1).alias("conv"), "id", "depends_on")).withColumn("depends", F.lit(True))
    rows = calls.join(results.hint("shuffle_hash"), "id", "left").join(above.hint("shuffle_hash"), "id", "left")
    rows = rows.withColumn("level", F.when(F.col("depends"), F.col("level")).otherwise(F.lit(0).cast("long")))
    line = F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), "id_json", F.lit(',"name":'), "name_json", F.lit(',"result":'), F.coalesce("first.content_json", F.lit("null")), F.lit("}"))
    return rows.select(
        "conv_id", "turn", "place", F.col("id").alias("call_id"), "name", "level", F.col("violation").isNull().alias("valid"), "violation",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), line.alias("line"),
    )
