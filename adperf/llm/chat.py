"""Tool-call linking: calls joined with results, ordered, validated, serialised.

Calls and results meet in a hash join on the call identifier.  A call may depend on
other calls; its level is 0 without such, else one more than the greatest
level it depends on, found in rounds (each settles the calls whose
dependencies are settled).  Ordering by (conversation, level, call) is a topological
order.  Arguments are checked against the tool's schema and written as canonical
JSON: keys sorted by UTF-16 code units, no white space, shortest numbers.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import stored

TYPES = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) if not isinstance(v, float) or math.isfinite(v) else False,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
}


#: Words of a schema that are checked, and those that say nothing about a value.
KNOWN = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "items", "properties", "required", "additionalProperties"}
NOTES = {"title", "description", "default", "examples", "$schema", "$comment"}


def check_schema(schema: dict, at: str = "$") -> None:
    """Refuse a schema with words that :func:`problems` does not check."""
    unknown = sorted(set(schema) - KNOWN - NOTES)
    if unknown or not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: no check of {', '.join(unknown) or 'additionalProperties with a schema'}")
    kinds = schema.get("type", [])
    for k in [kinds] if isinstance(kinds, str) else kinds:
        if k not in TYPES:
            raise ValueError(f"{at}: no type {k}")
    for k, v in schema.get("properties", {}).items():
        check_schema(v, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _number(v: int | float) -> str:
    if isinstance(v, int):
        # the text of the equal float, where there is one and it would be written with a power
        if abs(v) < 10**21 or abs(v) > 2**1023 or int(float(v)) != v:
            return str(v)
        v = float(v)
    if not math.isfinite(v):
        raise ValueError("not a finite number")
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    text = repr(v)
    mantissa, e, power = text.partition("e")
    if not e:
        return text
    if -7 < int(power) < 0:  # written out down to 1e-6
        text = f"{v:.{len(mantissa.replace('.', '').lstrip('-')) - 1 - int(power)}f}"
        return text
    return f"{mantissa}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"


def canonical(value) -> str:
    """Canonical JSON of a parsed value."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def parse(text: str | None):
    """The value of a JSON text; repeated keys and numbers that are not finite are refused."""
    def refuse(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text or "", object_pairs_hook=_no_repeats, parse_constant=refuse)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of a schema a value does not meet.

    Knows type, enum, minimum, maximum, minLength, maxLength, items, properties,
    required and additionalProperties.
    """
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        return [f"{at}: not of type {'/'.join(kinds)}"]
    out = []
    # by canonical text: true is not 1
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not a listed value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(set(schema.get("required", ())) - value.keys())]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of the distinct calls; null for calls on a cycle or behind one.

    Dependencies on unknown calls do not count.  Runs of calls with one dependency
    each are crossed by doubling: every such call knows a call further up and the
    distance, and takes over that one's.  Only calls with several dependencies are ordered in
    rounds, so a chain of n calls costs about log n joins.
    """
    nodes = stored(calls.select("call_id").where("call_id is not null").distinct())
    edges = calls.select(F.col("call_id").alias("child"), F.explode("depends_on").alias("parent")).where("child is not null").distinct()
    edges = stored(edges.join(nodes.withColumnRenamed("call_id", "parent"), "parent", "left_semi").select("child", "parent"))
    only = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up")).where("n = 1")
    # (child, up, far): up is reached after far steps
    jumps, rounds = stored(only.select("child", "up", F.lit(1).cast("long").alias("far"))), 0
    limit = max(1, jumps.count()).bit_length() + 1
    while rounds < limit:  # what is still on its way then runs in a cycle
        rounds += 1
        further = jumps.select(F.col("child").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        if jumps.join(further, "up", "left_semi").isEmpty():
            break
        # distances are no longer needed on a cycle, where they would outgrow their type
        jumps = stored(jumps.join(further, "up", "left").select("child", F.coalesce("top", "up").alias("up"), F.least(F.col("far") + F.coalesce("more", F.lit(0)), F.lit(1 << 40)).alias("far")))
    cyclic = jumps.join(jumps.select(F.col("child").alias("up")), "up", "left_semi").select("child")
    jumps = stored(jumps.join(cyclic, "child", "left_anti"))
    # dependencies of the calls with several of them, moved up to calls without just one
    several = edges.join(only, "child", "left_anti")
    moved = several.join(jumps.select(F.col("child").alias("parent"), "up", "far"), "parent", "left")
    left = stored(moved.select("child", F.coalesce("up", "parent").alias("parent"), (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    ready = stored(nodes.join(edges.select(F.col("child").alias("call_id")), "call_id", "left_anti").withColumn("level", F.lit(0).cast("long")))
    done, reached = ready, None
    while True:
        known = ready.select(F.col("call_id").alias("parent"), "level")
        came = left.join(known, "parent").select("child", (F.col("level") + F.col("far")).alias("level"))
        reached = came if reached is None else came.unionByName(reached)
        left = stored(left.join(known, "parent", "left_anti"))
        reached = stored(reached.groupBy("child").agg(F.max("level").alias("level")))
        ready = stored(reached.join(left.select("child").distinct(), "child", "left_anti").withColumnRenamed("child", "call_id"))
        if ready.isEmpty():
            break
        reached = reached.join(left.select("child").distinct(), "child", "left_semi")
        done = done.unionByName(ready)
    along = jumps.join(done.select(F.col("call_id").alias("up"), "level"), "up").select(F.col("child").alias("call_id"), (F.col("level") + F.col("far")).alias("level"))
    return nodes.join(done.unionByName(along), "call_id", "left").select("call_id", F.col("level").cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, call_id, name, level, n_missing, n_results, valid, errors, message.

    ``calls`` has conv_id, call_id, name, arguments (JSON text), depends_on (array
    of call ids, null as empty); ``results`` has call_id, content.  ``schemas``
    (name -> schema) is a configuration and bounded as such.  ``message`` is the
    canonical JSON object of arguments, call_id, name and result (null without
    one; of several results the smallest content); arguments that are no JSON object
    stay as their text, and so do those with an escape of half a character pair, which
    no text can hold.  A schema with words that are not checked is refused.  ``n_missing`` counts dependencies that are no calls.  A
    null call_id links with nothing and has level 0; repeated calls each give a row;
    an unknown name is an error; an empty table gives no rows.  Other columns of
    either table are not read.
    """
    for schema in schemas.values():
        check_schema(schema)
    calls = calls.select("conv_id", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    calls = stored(calls)
    level = levels(calls)
    found = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("n_results"))

    # dependencies that are no calls, counted for each distinct call
    asked = calls.select("call_id", F.explode(F.array_distinct("depends_on")).alias("parent")).where("call_id is not null and parent is not null").distinct()
    unknown = asked.join(level.select(F.col("call_id").alias("parent")), "parent", "left_anti")
    unknown = unknown.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_missing"))

    rows = calls.join(level.hint("shuffle_hash"), "call_id", "left").join(found.hint("shuffle_hash"), "call_id", "left").join(unknown.hint("shuffle_hash"), "call_id", "left")
    rows = rows.select(
        "conv_id", "call_id", "name", F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"),
        F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "arguments", "result",
    )

    def run(batches):
        for b in batches:
            valid, errors, message = [], [], []
            for call_id, name, text, result in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result")), strict=True):
                try:
                    value = parse(text)
                    shown = canonical(value)
                    shown.encode()
                    bad = problems(value, schemas[name]) if name in schemas else ["unknown tool"]
                except UnicodeEncodeError:
                    shown, bad = canonical(text), ["arguments hold half a character pair"]
                except (ValueError, RecursionError):
                    value, shown, bad = text, canonical(text), ["arguments are not JSON"]
                body = canonical({"call_id": call_id, "name": name, "result": result})
                valid.append(not bad)
                errors.append("; ".join(bad))
                message.append('{"arguments":' + shown + "," + body[1:])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("conv_id", "call_id", "name", "level", "n_missing", "n_results")], pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(message, pa.string())],
                names=["conv_id", "call_id", "name", "level", "n_missing", "n_results", "valid", "errors", "message"],
            )

    return rows.mapInArrow(run, "conv_id long, call_id string, name string, level int, n_missing long, n_results long, valid boolean, errors string, message string")


#: The three tools that the calls derived from conversations use.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["chars", "text", "turn"], "additionalProperties": False,
        "properties": {"chars": {"type": "integer", "maximum": 1500}, "text": {"type": "string"}, "turn": {"type": "integer"}},
    },
    "summarise": {
        "type": "object", "required": ["chars", "text"], "additionalProperties": False,
        "properties": {"chars": {"type": "integer", "minimum": 300}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}},
    },
    "translate": {
        "type": "object", "required": ["text"], "additionalProperties": False,
        "properties": {"chars": {"type": "integer"}, "text": {"type": "string"}, "turn": {"type": "integer"}},
    },
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations stand for.

    An assistant turn is a call whose arguments are its turn, whole text and length;
    it depends on the call half as far into the conversation.  The user turn
    after it is its result.
    """
    key = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    made = conversations.where("role = 'assistant'")
    name = F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "summarise").otherwise("translate")
    arguments = F.to_json(F.struct("turn", "text", F.length("text").alias("chars")))
    half = F.floor(turn / 2)
    calls = made.select(
        F.col("conv_id").cast("long").alias("conv_id"), key(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.when(turn > 1, F.array(key(half))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.where("role = 'user' and turn > 0").select(key(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
