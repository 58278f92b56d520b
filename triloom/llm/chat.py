"""Chat formatting with tool-call linking.

Messages are parsed into plain text, tool calls (``<tool_call>`` with a JSON
object: id, name, arguments, optionally after) and tool results
(``<tool_result>``: id, content).  Where a table has no marked calls, a user's
turn may count as an implicit call that the assistant's next turn answers.
Calls are hash-joined to results by conversation and identifier, ordered
topologically (a call stands after the calls it refers to), their arguments
validated against JSON schemas, and each conversation is written as canonical
JSON: keys sorted, no spaces, non-ASCII characters as they are.

A conversation is one row, so one task holds one conversation at a time, as its
row does; messages without a conversation are rows of their own.  Links between
calls and results are made by joins before that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written

_MARKED = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
#: Name, and JSON schema of the arguments.
TOOLS = {"respond": {"type": "object", "required": ["turn", "words"], "properties": {"turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where a JSON value breaks a schema (type, enum, required, properties, items, bounds, lengths, pattern)."""
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def fits(kind: str) -> bool:
        if kind in ("integer", "number"):
            good = isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer())
            return good and not isinstance(value, bool)
        return isinstance(value, _KINDS.get(kind, object))

    if kinds and not any(map(fits, kinds)):
        return [f"{path}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
    elif isinstance(value, list):
        for k, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{path}[{k}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{path}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of bounds")
    return out


def canonical(value) -> str:
    """Canonical JSON."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse(role: str | None, text: str | None) -> tuple[str, list[dict], list[dict]]:
    """Plain text, calls and results of a message; what can't be read stays text."""
    calls, results = [], []

    def take(m: re.Match) -> str:
        try:
            x = json.loads(m[2])
        except ValueError:
            return m[0]
        if not isinstance(x, dict) or not isinstance(x.get("id"), str):
            return m[0]
        if m[1] == "call" and isinstance(x.get("name"), str):
            after = x.get("after", [])
            calls.append({"id": x["id"], "name": x["name"], "arguments": x.get("arguments", {}), "after": [a for a in after if isinstance(a, str)] if isinstance(after, list) else []})
        elif m[1] == "result":
            results.append({"id": x["id"], "content": x.get("content")})
        else:
            return m[0]
        return ""

    return _MARKED.sub(take, text or ""), calls, results


def topological(calls: list[dict]) -> list[dict]:
    """Calls so that each stands after those it refers to, else in the given order; a cycle keeps that order at the end."""
    place = {}
    for k, c in enumerate(calls):
        place.setdefault(c["id"], k)
    waits = [{place[a] for a in c["after"] if a in place and place[a] != k} for k, c in enumerate(calls)]
    freed: dict[int, list[int]] = {}
    for k, w in enumerate(waits):
        for a in w:
            freed.setdefault(a, []).append(k)
    ready = [k for k, w in enumerate(waits) if not w]
    heapify(ready)
    out = []
    while ready:
        k = heappop(ready)
        out.append(k)
        for x in freed.get(k, []):
            waits[x].discard(k)
            if not waits[x]:
                heappush(ready, x)
    seen = set(out)
    return [calls[k] for k in [*out, *(k for k in range(len(calls)) if k not in seen)]]


def _events(tools: dict, implicit: str | None):
    """Rows (conv, turn, role, text, place): their plain text, calls and results as JSON lists with the ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, found = [], []
            for turn, role, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                rest, calls, results = parse(role, text)
                if implicit and turn is not None:
                    if role == "user":
                        calls.append({"id": f"turn-{turn}", "name": implicit, "arguments": {"turn": turn, "words": len(rest.split())}, "after": [f"turn-{turn - 2}"]})
                    elif role == "assistant":
                        results.append({"id": f"turn-{turn - 1}", "content": f"turn {turn}"})
                for x in calls:
                    x["errors"] = violations(x["arguments"], tools[x["name"]]) if x["name"] in tools else ["$: unknown tool"]
                plain.append(rest)
                found.append([{"call": kind, "id": x["id"], "body": canonical(x)} for kind, list_ in ((True, calls), (False, results)) for x in list_])
            kind = pa.list_(pa.struct([("call", pa.bool_()), ("id", pa.string()), ("body", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(plain, pa.string()), pa.array(found, kind)], names=["conv", "turn", "role", "place", "plain", "found"])

    return run


_SCHEMA = "conv_id long, n_messages long, n_calls long, n_linked long, n_unanswered long, n_orphans long, n_repeats long, n_invalid long, chat string"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, lone, turn, kind, role, plain, body, answer) in order: one row for each conversation."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    held, at = [], None

    def done() -> dict:
        messages, calls, orphans, repeats = [], [], [], []
        for turn, what, role, plain, body, answer in held:
            if what == "message":
                messages.append({"content": plain, "role": role, "turn": turn})
            elif what == "call":
                calls.append(json.loads(body) | {"turn": turn, "result": json.loads(answer)["content"] if answer else None, "answered": answer is not None})
            else:
                (orphans if what == "orphan" else repeats).append(json.loads(body) | {"turn": turn})
        linked = sum(c["answered"] for c in calls)
        chat = canonical({"conversation": at[0], "messages": messages, "orphans": orphans, "repeats": repeats, "tool_calls": topological(calls)})
        return dict(zip(names, (at[0], len(messages), len(calls), linked, len(calls) - linked, len(orphans), len(repeats), sum(bool(c["errors"]) for c in calls), chat), strict=True))

    kind = pa.schema([(n, pa.string() if n == "chat" else pa.int64()) for n in names])
    for batch in batches:
        out = []
        for conv, lone, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, lone) != at:
                if held:
                    out.append(done())
                held, at = [], (conv, lone)
            held.append(rest)
        yield pa.RecordBatch.from_pylist(out, kind)
    if held:
        yield pa.RecordBatch.from_pylist([done()], kind)


def format_chats(turns: DataFrame, tools: dict | None = None, implicit: str | None = None) -> DataFrame:
    """One row for each conversation: counts, and chat, its canonical JSON.

    ``turns`` has conv_id, turn, role and text; other columns aren't read.  Of
    several calls with one identifier in a conversation each gets the answer; of
    several results the first (by turn, place in its message, then content)
    answers, and the others are listed as repeats.  A result whose call isn't
    there is an orphan, a call without result is unanswered (its result is null),
    and a call whose arguments break its tool's schema, or whose tool isn't known,
    is invalid; all are kept.  Calls are ordered over the whole conversation.  A
    null text is an empty message; a null turn stands first; a row with a null
    conv_id is a conversation of its own without links.  Repeated rows stay.  An
    empty table gives an empty table.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    events = written(small_batches(rows).mapInArrow(_events(tools or TOOLS, implicit), "conv long, turn long, role string, place long, plain string, found array<struct<call:boolean,id:string,body:string>>"))
    none = F.lit(None).cast("string")
    lone = F.when(F.col("conv").isNull(), F.col("place")).alias("lone")
    messages = events.select("conv", lone, "turn", F.lit("message").alias("kind"), F.lit(0).alias("pos"), "role", "plain", none.alias("body"), none.alias("answer"))
    found = events.select("conv", "turn", "place", F.posexplode("found").alias("pos", "x")).select("conv", lone, "turn", "place", "pos", "x.*")
    first = F.min(F.when(~F.col("call"), F.struct("turn", "pos", "body", "place"))).alias("first")
    links = found.where("conv is not null").groupBy("conv", "id").agg(first, F.max("call").alias("called"))
    met = found.join(links.hint("shuffle_hash"), ["conv", "id"], "left")
    answers = (F.col("first.place") == F.col("place")) & (F.col("first.pos") == F.col("pos"))
    kind = F.when(F.col("call"), "call").when(F.col("called"), F.when(~answers, "repeat")).otherwise("orphan").alias("kind")
    met = met.select("conv", "lone", "turn", kind, "pos", none.alias("role"), none.alias("plain"), "body", F.when(F.col("call"), F.col("first.body")).alias("answer")).where("kind is not null")
    ordered = messages.union(met).repartition("conv", "lone").sortWithinPartitions("conv", "lone", "turn", "kind", "pos", "role", "plain", "body")
    return ordered.drop("pos").mapInArrow(_assemble, _SCHEMA)
