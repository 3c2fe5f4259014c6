"""Operator 7: tool-call linking, DataFrame functions only.

Calls and results are hash-joined by identifier.  A call may wait for any number of other calls
(`after`: an identifier or an array of them); its level is the length of the longest way back
to a call that waits for none.  Calls that wait for exactly one other form chains, which are
shortened by pointer doubling, in a number of joins logarithmic in the longest chain; what is
left are the calls that wait for several, levelled in rounds: one round for each level of such
calls upon such calls.  No conversation is gathered.  Arguments are JSON, validated against
the schema of the tool, which is data, and every linked call is serialised as canonical JSON:
keys in order at every depth, no white space, absent values left out.

Call status: `ok`, `no result`, `missing call` (it waits for an identifier that does not
exist) or `cycle`.  Level is null in or behind a cycle, and behind a missing call counts
from there.  Results that no call is linked to come from `unlinked`.

Edge cases: null arguments count as none; arguments that aren't JSON, repeat a key or outgrow
Spark's variants are an error of the call, and its JSON has them as `unparsed`; repeated
identifiers: one call each, all linked to the result of smallest content, waiting together for
everything that any of them waits for; a null identifier links with nothing; nulls and repeats
in `after` are left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..schema import held
from .common import dropped, written


def tool(text: int, words: int) -> dict:
    limits = {"text": {"type": "string", "minLength": 1, "maxLength": text}, "words": {"type": "integer", "minimum": 1, "maximum": words}}
    return {"type": "object", "properties": limits, "required": ["text", "words"]}


# Tools and the JSON schemas of their arguments.
SCHEMAS = {"calculate": tool(400, 80), "lookup": tool(200, 40), "search": tool(300, 60)}

#: how Spark names the type of a variant; an integer is written without fraction or exponent
KINDS = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}
KEYWORDS = {"type", "enum", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "items", "properties", "required", "additionalProperties"}


def waits(calls: DataFrame) -> Column:
    """`after` as an array in order, without nulls and repeats."""
    after = F.col("after")
    if not isinstance(calls.schema["after"].dataType, ArrayType):
        after = F.array(after)
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(after))), F.array().cast("array<string>"))


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level, status of distinct calls (call_id, after)."""
    rows = calls.where("call_id is not null").select("call_id", waits(calls).alias("after"))
    nodes = written(rows.select("call_id").distinct(), "calls")
    asked = rows.select("call_id", F.explode("after").alias("up")).distinct()
    edges = written(asked.join(nodes.select(F.col("call_id").alias("up"), F.lit(True).alias("known")), "up", "left"), "waits")
    ups = edges.groupBy("call_id").agg(F.count("known").alias("ups"), F.min(F.when(F.col("known"), F.col("up"))).alias("up"), F.max(F.col("known").isNull()).alias("missing"))
    one = F.col("ups") == 1
    # top: the first call above that doesn't wait for exactly one other, `far` calls away; `root` if that waits for none
    none = F.coalesce("ups", F.lit(0)) == 0
    state = nodes.join(ups, "call_id", "left").select("call_id", F.when(one, F.col("up")).alias("up"), F.when(one, 1).otherwise(0).cast("long").alias("far"), F.when(~F.coalesce(one, F.lit(False)), F.col("call_id")).alias("top"), F.when(~F.coalesce(one, F.lit(False)), none).alias("root"), F.coalesce("missing", F.lit(False)).alias("missing"))
    state = written(state, "levels")
    n, reach = state.count(), 1
    while reach <= n and not state.where("up is not null").isEmpty():
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("more"), F.col("top").alias("top2"), F.col("root").alias("root2"))
        new = state.join(above, "up", "left").select("call_id", F.col("up2").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("top", "top2").alias("top"), F.coalesce("root", "root2").alias("root"), "missing")
        new = written(new, "levels")
        dropped(state)
        state, reach = new, reach * 2
    # a chain longer than the number of calls goes round: it has no top
    above = state.select(F.col("call_id").alias("up"), "top", "root", (F.col("far") + 1).alias("far"))
    several = ups.where("ups > 1").select("call_id")
    pending = edges.where("known").join(several, "call_id").join(above, "up")
    pending = pending.groupBy("call_id", "top").agg(F.max("far").alias("far"), F.max(F.when(F.col("root"), F.lit(0).cast("long"))).alias("level"))
    pending, found = written(pending, "pending"), []
    while True:
        whole = pending.groupBy("call_id").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new = written(whole.where("open = 0").select(F.col("call_id").alias("top"), F.col("level").alias("low")), "levelled")
        if new.isEmpty():
            dropped(pending, new)
            break
        found.append(new)
        rest = pending.join(new.select(F.col("top").alias("call_id")), "call_id", "left_anti").join(new, "top", "left")
        rest = written(rest.select("call_id", "top", "far", F.coalesce("level", "low").alias("level")), "pending")
        dropped(pending)
        pending = rest
    level = F.when(F.col("root"), F.col("far"))
    if found:
        tops = state.sparkSession.read.schema(found[0].schema).parquet(*(t._porelane_path for t in found))
        state = state.join(tops, "top", "left")
        level = F.coalesce(level, F.col("far") + F.col("low"))
    state = state.select("call_id", level.alias("level"), "missing")
    return state.select("call_id", "level", F.when(F.col("level").isNull(), F.lit("cycle")).when(F.col("missing"), F.lit("missing call")).alias("status"))


def step(name: str) -> str:
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None or not name:
        raise ValueError(f"a property can't be named {name!r}")
    return f"$[{quote}{name}{quote}]"


def faults(value: Column, schema: dict, path: Column | None = None) -> Column:
    """Messages of everything that a variant has wrong by a JSON schema, in the schema's order."""
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"schema keywords that aren't known: {sorted(unknown)}")
    at = F.lit("arguments") if path is None else path
    below = lambda name: name if path is None else F.concat(path, F.lit("."), name)
    said: list[Column] = []

    def say(wrong: Column, what: str, where: Column = at) -> None:
        said.append(F.when(wrong, F.array(F.concat(where, F.lit(f": {what}")))))

    def limits(size: Column, what: str, low: str, high: str) -> None:
        if low in schema:
            say(size < schema[low], f"{what} below {schema[low]}")
        if high in schema:
            say(size > schema[high], f"{what} above {schema[high]}")

    whole = lambda kind: F.try_variant_get(value, "$", kind)
    limits(F.length(whole("string")), "length", "minLength", "maxLength")
    limits(whole("decimal(38,0)" if schema.get("type") == "integer" else "double"), "value", "minimum", "maximum")
    if "enum" in schema:
        say(~F.to_json(value).isin([json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]), "not one of the values allowed")
    items = whole("array<variant>")
    limits(F.size(items), "items", "minItems", "maxItems")
    if "items" in schema:
        said.append(F.flatten(F.transform(items, lambda x, i: faults(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
    known = schema.get("properties", {})
    for name in [*known, *(r for r in schema.get("required", []) if r not in known)]:
        child = F.try_variant_get(value, step(name), "variant")
        if name in schema.get("required", []):
            say(child.isNull(), "missing", below(F.lit(name)))
        if name in known:
            said.append(F.when(child.isNotNull(), faults(child, known[name], below(F.lit(name)))))
    if schema.get("additionalProperties", True) is False:
        extra = F.array_except(F.map_keys(whole("map<string,variant>")), F.array(*map(F.lit, known)).cast("array<string>"))
        said.append(F.transform(F.array_sort(extra), lambda k: F.concat(below(k), F.lit(": unknown"))))
    out = F.flatten(F.array_compact(F.array(*said))) if said else F.array().cast("array<string>")
    if "type" in schema:
        right = F.schema_of_variant(value).rlike(f"^({KINDS[schema['type']]})$")
        out = F.when(right, out).otherwise(F.array(F.concat(at, F.lit(f": not of type {schema['type']}"))))
    return out


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """Messages of everything that the arguments (a variant) have wrong, in order; empty if they are valid."""
    out = F.lit(None).cast("array<string>")
    for known, schema in sorted(schemas.items()):
        out = F.when(name == known, faults(arguments, schema)).otherwise(out)
    return F.coalesce(out, F.array(F.lit("unknown tool")))


def linked(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls (conv_id, turn, call_id, name, after, arguments), results (call_id, content): one row a call.

    conv_id, turn, call_id, name, after, level, status, errors, json.  `arguments` is a JSON
    string; where calls have no such column, those columns are taken that the schemas name.
    """
    if "arguments" in calls.columns:
        given = F.col("arguments")
    else:
        given = F.to_json(F.struct(*(c for c in calls.columns if any(c in s.get("properties", {}) for s in schemas.values()))))
    after = F.when(F.size(waits(calls)) > 0, waits(calls)) if isinstance(calls.schema["after"].dataType, ArrayType) else F.col("after")
    calls = calls.select("conv_id", "turn", "call_id", "name", after.alias("after"), given.alias("given"))
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    # results and levels hold one row an identifier
    out = calls.join(answer, "call_id", "left").join(written(levels(calls), "levels"), "call_id", "left")
    out = out.withColumn("status", F.coalesce("status", F.when(F.col("answered").isNull(), F.lit("no result")), F.lit("ok")))
    out = held(out, "parsed", F.try_parse_json(F.coalesce("given", F.lit("{}"))))
    told = F.when(F.col("parsed").isNull(), F.array(F.lit("arguments: not JSON"))).otherwise(problems(F.col("name"), F.col("parsed"), schemas))
    out = held(out, "problems", told)
    arguments, unparsed = F.when(F.col("given").isNotNull(), F.col("parsed")), F.when(F.col("parsed").isNull(), F.col("given"))
    line = F.to_json(F.struct(F.col("after"), arguments.alias("arguments"), F.col("problems").alias("errors"), F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("content").alias("result"), F.col("status"), unparsed.alias("unparsed")))
    return out.select("conv_id", "turn", "call_id", "name", "after", "level", "status", F.array_join("problems", "; ").alias("errors"), line.alias("json"))


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call is linked to: call_id, status, json, a row each (call_id, content) with its count.

    `orphan result`: no call has the identifier (or it is null); `repeated result`: the call is
    linked to another of them, that of smallest content; equal ones are the linked one's repeats.
    """
    distinct = results.groupBy("call_id", "content").agg(F.count(F.lit(1)).alias("n"))
    least = distinct.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("least"))
    ids = calls.where("call_id is not null").select("call_id", F.lit(True).alias("called")).distinct()
    out = distinct.join(ids, "call_id", "left").join(least, "call_id", "left")
    # the one that is linked doesn't count; contents that are all null have a null least
    count = F.col("n") - F.when(F.col("called") & F.col("content").eqNullSafe(F.col("least")), 1).otherwise(0)
    status = F.when(F.col("called"), F.lit("repeated result")).otherwise(F.lit("orphan result"))
    out = out.select("call_id", "content", count.alias("count"), status.alias("status")).where("count > 0")
    line = F.to_json(F.struct("count", F.col("call_id").alias("id"), F.col("content").alias("result"), "status"))
    return out.select("call_id", "status", line.alias("json"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every assistant turn as a call that waits for the assistant's turn two before; the next user turn is its result.

    Identifiers are conv_id:turn; where a (conv_id, turn) repeats, each row is a call of its own
    text, and the smallest text is the result.  Joins are on identifiers: no conversation is gathered.
    """
    key = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    said = turns.where("role = 'assistant' and conv_id is not null and turn is not null").withColumn("call_id", key(F.col("turn")))
    # joined by identifier, as results and levels are afterwards: texts are shuffled once
    before = said.select(key(F.col("turn") + 2).alias("call_id"), F.lit(True).alias("follows")).distinct()
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    words = F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))
    name = F.element_at(F.array(*map(F.lit, sorted(SCHEMAS))), (1 + F.pmod(F.col("turn"), F.lit(len(SCHEMAS)))).cast("int"))
    calls = said.join(before, "call_id", "left").select("conv_id", "turn", "call_id", name.alias("name"), F.when(F.col("follows"), key(F.col("turn") - 2)).alias("after"), "text", F.when(F.col("text").isNotNull(), words).alias("words"))
    results = turns.where("role = 'user'").select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def conversation_tools(turns: DataFrame) -> DataFrame:
    return linked(*conversation_calls(turns))


def conversation_links(turns: DataFrame) -> DataFrame:
    """conversation_tools, and the rows of user turns that answer no call, which have only call_id, status and json."""
    calls, results = conversation_calls(turns)
    return linked(calls, results).unionByName(unlinked(calls, results), allowMissingColumns=True)
