"""Tool calls: hostile JSON, and random conversations against a plain reading of the same rules."""

import json
import random
from collections import Counter

import pytest

from strideframe.llm import tool_calls

SCHEMA = "conv_id long, turn long, role string, text string"


def assistant(*calls):
    return json.dumps({"tool_calls": list(calls)})


def test_hostile_messages(spark):
    deep = '{"tool_calls": ' + "[" * 50_000 + "]" * 50_000 + "}"
    call = '{"tool_calls": [{"id": "\\ud800", "name": "f", "arguments": {"q": "\\udfff"}}]}'
    rows = [(1, 0, "assistant", deep), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id": "\\ud800", "content": "x"}'), (1, 3, "assistant", '{"tool_calls": [{"id": "n", "arguments": NaN}]}')]
    rows += [(1, 4, "assistant", '{"tool_calls": [{"id": "n", "arguments": 1e999}, 7, null]}'), (1, 5, "assistant", assistant({"id": {"a": 1}, "name": None, "depends_on": "x"})), (1, 6, "user", "[" * 100_000)]
    rows += [(1, 7, "user", "{" + '"a":{' * 5_000), (2, 0, "assistant", assistant({"id": "t", "name": "f", "arguments": {"q": True}}, {"id": "t", "name": "f", "arguments": {"q": None}})), (2, 1, "user", "x" * 3_000_000)]
    schemas = tool_calls.SCHEMAS | {"f": {"properties": {"q": {"type": ["string", "null"]}}}}
    out = tool_calls.linked_calls(spark.createDataFrame(rows, SCHEMA), schemas).collect()
    by_id = {r.call_id: r for r in out if r.call_id != "2:t"}
    assert by_id["1:\\ud800"].n_results == 1 and by_id["1:\\ud800"].valid and '"q":"\\udfff"' in by_id["1:\\ud800"].line
    assert by_id['1:{"a":1}'].violation == "$: unknown tool" and "1:n" not in by_id
    assert Counter(r.violation for r in out if r.call_id == "2:t") == Counter(["$.q: type", None])
    assert all(json.loads(r.line)["id"] for r in out)


def plain(rows):
    """(call id, level, n_results, result) of every call by direct reading."""
    calls, results = [], {}
    for conv, turn, role, text in rows:
        if role == "assistant":
            calls += [(f"{conv}:{c['id']}", [f"{conv}:{d}" for d in c.get("depends_on", [])]) for c in json.loads(text)["tool_calls"]]
        else:
            m = json.loads(text)
            results.setdefault(f"{conv}:{m['tool_call_id']}", []).append((turn, m["content"]))
    needs = {}
    for i, deps in calls:
        needs.setdefault(i, set()).update(deps)
    level = {i: 0 for i, d in needs.items() if not d}
    while True:
        new = {i: 1 + max(level[x] for x in d) for i, d in needs.items() if i not in level and all(x in level for x in d)}
        if not new:
            break
        level |= new
    return Counter((i, level.get(i), len(results.get(i, [])), min(results[i])[1] if i in results else None) for i, _ in calls)


@pytest.mark.parametrize("at_once", [50_000, 5, 0])
def test_random_conversations(spark, at_once, monkeypatch):
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        names = [f"c{k}" for k in range(rng.randint(1, 25))]
        for turn, name in enumerate(names * 2 if conv % 4 == 0 else names):
            deps = rng.sample(names[: names.index(name)], min(names.index(name), rng.randint(0, 2)))
            if rng.random() < 0.05:
                deps.append(rng.choice([*names, "missing"]))
            rows.append((conv, turn, "assistant", assistant({"id": name, "name": "f", "depends_on": deps})))
            rows += [(conv, turn + 100, "tool", json.dumps({"tool_call_id": name, "content": str(rng.randint(0, 9))})) for _ in range(rng.randint(0, 2))]
    monkeypatch.setattr(tool_calls.levels, "__defaults__", (at_once,))
    out = tool_calls.linked_calls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.call_id, r.level, r.n_results, json.loads(r.line)["result"]) for r in out) == plain(rows)


def test_long_chain_in_one_pass(spark):
    rows = [(1, k, "assistant", assistant({"id": str(k), "name": "f", "depends_on": [str(k - 1)] if k else []})) for k in range(3_000)]
    out = {r.call_id: r.level for r in tool_calls.linked_calls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {f"1:{k}": k for k in range(3_000)}


def test_lines_are_canonical_in_every_field(spark):
    import json

    bad = "\x1f\x00\b\f\n\"\\\u2028é😀"
    lone = "\ud800"
    rows = []
    for i, (x, y) in enumerate([(bad, bad), (lone + "a", "\\ud800a"), ("/", "</x>")]):
        call = {"tool_calls": [{"id": x, "name": y, "arguments": {x: y, "b": [y, {x: 1.5}]}}, {"id": y + "2", "name": x, "arguments": None}]}
        rows += [(i, 0, "assistant", json.dumps(call)), (i, 1, "tool", json.dumps({"tool_call_id": x, "content": y})), (i, 2, "tool", json.dumps({"tool_call_id": y + "2", "content": x}))]
    out = tool_calls.linked_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 6
    for r in out:
        line = json.loads(r.line)
        assert r.line == tool_calls.canonical(line)
        call = json.loads(rows[3 * r.conv_id][3])["tool_calls"][r.place]
        content = json.loads(rows[3 * r.conv_id + 1 + r.place][3])["content"]
        assert line == {"arguments": call["arguments"], "id": f"{r.conv_id}:{call['id']}", "name": call["name"], "result": content}
