"""Tool calls in conversations: linked to their results, ordered, validated, canonical JSON.

A turn whose text is a JSON object may declare tools (``{"tools": [{"name", "parameters"}]}``),
make calls (``{"content", "tool_calls": [{"id", "name", "arguments"}]}``) or carry a result
(``{"tool_call_id", "content"}``). Any other text is plain content. One conversation may hold any
share of all rows: nothing is gathered by conversation; each message stays a row with a sort key.
"""

from __future__ import annotations

import json
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clickloom.llm.common import bound_batches, materialize, split_join

_SHAPE = """tools array<struct<name:string,parameters:string>>, content string, tool_call_id string,
tool_calls array<struct<id:string,name:string,arguments:string>>"""
_REFERENCE = r'"\$([^"$]+)"'  # an argument "$id" stands for the result of that call
_KINDS = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool,
    "object": dict, "array": list, "null": type(None),
}


_SURROGATE = re.compile("[\ud800-\udfff]")
_NOTES = frozenset(
    "title description default examples format deprecated readOnly writeOnly $schema $id $comment $defs definitions".split()
)
_RULES = frozenset(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern required properties "
    "additionalProperties items minItems maxItems uniqueItems anyOf oneOf allOf not $ref".split()
)


def unknown_keyword(schema) -> str | None:
    """A keyword of a schema that ``violation`` does not know, in any place, or None."""
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return "not a schema"
    for name, rule in schema.items():
        if name not in _RULES and name not in _NOTES or name == "$ref" and not (rule == "#" or rule.startswith("#/")):
            return name
        if name in ("properties", "$defs", "definitions"):
            inner = list(rule.values())
        elif name in ("anyOf", "oneOf", "allOf"):
            inner = rule
        else:
            inner = [rule] if name in ("additionalProperties", "items", "not") else []
        for part in inner:
            if found := unknown_keyword(part):
                return found
    return None


def _plain(value):
    """A value to compare by: 1 and 1.0 are equal, 1 and true are not."""
    if isinstance(value, dict):
        return "object", frozenset((k, _plain(v)) for k, v in value.items())
    if isinstance(value, list):
        return "array", tuple(map(_plain, value))
    return isinstance(value, bool), value


def _out_of_bounds(value, schema: dict) -> bool:
    low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
    if value < schema.get("minimum", value) or value > schema.get("maximum", value):
        return True
    if low is True and value == schema.get("minimum") or high is True and value == schema.get("maximum"):
        return True
    return not isinstance(low, (bool, type(None))) and value <= low or not isinstance(high, (bool, type(None))) and value >= high


def violation(value, schema, at: str = "$", refs=frozenset(), root=None) -> str | None:
    """The first way in which a value breaks a JSON schema by the keywords of ``_RULES``, or None.

    A string ``"$id"`` with an id of ``refs`` fits any schema; with any other it is plain text.
    """
    root = schema if root is None else root
    if isinstance(value, str) and value[:1] == "$" and value[1:] in refs:
        return None
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"

    def inner(part, rule, place=at):
        return violation(part, rule, place, refs, root)

    if "$ref" in schema:
        target = root
        for step in schema["$ref"].split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            target = target[int(step)] if isinstance(target, list) else target[step]
        if found := inner(value, target):
            return found
    kinds = schema.get("type")
    if kinds is not None:
        fits = False
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            fits |= isinstance(value, _KINDS[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
            fits |= kind == "integer" and isinstance(value, float) and value.is_integer()
        if not fits:
            return f"{at}: not of type {kinds}"
    if "enum" in schema and _plain(value) not in [_plain(x) for x in schema["enum"]]:
        return f"{at}: not in enum"
    if "const" in schema and _plain(value) != _plain(schema["const"]):
        return f"{at}: not the constant"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if _out_of_bounds(value, schema):
            return f"{at}: out of bounds"
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            return f"{at}: not a multiple"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{at}: bad length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: not of the pattern"
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}: {name} is missing"
        for name in sorted(value):
            if name not in known and more is False:
                return f"{at}: {name} is unknown"
            if found := inner(value[name], known.get(name, more), f"{at}.{name}"):
                return found
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at}: bad number of items"
        if schema.get("uniqueItems") and len(set(map(_plain, value))) < len(value):
            return f"{at}: repeated items"
        for k, item in enumerate(value):
            if found := inner(item, schema.get("items", True), f"{at}[{k}]"):
                return found
    for rule in schema.get("allOf", []):
        if found := inner(value, rule):
            return found
    if "anyOf" in schema and all(inner(value, r) for r in schema["anyOf"]):
        return f"{at}: fits none of anyOf"
    if "oneOf" in schema and sum(inner(value, r) is None for r in schema["oneOf"]) != 1:
        return f"{at}: does not fit one of oneOf"
    if "not" in schema and inner(value, schema["not"]) is None:
        return f"{at}: fits not"
    return None


def _no_number(text: str):
    raise ValueError(f"{text} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    return value if abs(value) != float("inf") else _no_number(text)


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key comes twice")
    return found


def parsed(text: str):
    """The value of a JSON text. NaN and infinities, numbers beyond a double, repeated keys and
    nesting too deep to follow raise ValueError, as does any other text."""
    try:
        return json.loads(text, parse_constant=_no_number, parse_float=_finite, object_pairs_hook=_object)
    except RecursionError:
        raise ValueError("nested too deep") from None


def _storable(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and characters as they are (lone surrogates escaped)."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError:
        raise ValueError("nested too deep") from None
    return _storable(text)


UNCHECKED = "unchecked: "


@F.pandas_udf(StringType())
def _checked(arguments: pd.Series, schema: pd.Series, refs: pd.Series) -> pd.Series:
    def check(raw, rule, known):
        try:
            value = parsed(raw) if raw is not None else {}
        except ValueError:
            return "$: not JSON"
        if rule is None:
            return "no schema"
        try:
            rule = parsed(rule)
        except ValueError:
            return "schema is not JSON"
        try:
            if found := unknown_keyword(rule):
                return UNCHECKED + found
            return violation(value, rule, refs=frozenset(() if known is None else known))
        except (ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError, re.error):
            return UNCHECKED + "not a schema"

    found = [check(*row) for row in zip(arguments, schema, refs, strict=True)]
    return pd.Series([None if text is None else _storable(text) for text in found], dtype=object)


@F.pandas_udf(StringType())
def _message(role: pd.Series, text: pd.Series, formed: pd.Series) -> pd.Series:
    def shape(own, raw, json_like):
        if json_like:
            try:
                value = parsed(raw)
                return canonical({"role": own, **{k: v for k, v in value.items() if k != "role"}})
            except ValueError:
                pass
        return canonical({"content": raw, "role": own})

    return pd.Series([shape(*row) for row in zip(role, text, formed, strict=True)], dtype=object)


def _settled(edges: DataFrame) -> DataFrame:
    """(conv, turn, late, depth): where each linked message belongs.

    ``late`` is the last turn among the message and all it depends on, ``depth`` its distance
    within that turn. A round passes keys on along every edge, until nothing changes: one round if
    all messages stand in order, else as many as the longest chain of misplaced ones. The edges
    form no cycle, so the rounds end.
    """
    nodes = edges.select("conv", F.explode(F.array("before", "after")).alias("turn")).distinct()
    state = materialize(nodes.select("conv", "turn", F.col("turn").alias("late"), F.lit(0).alias("depth")), "order")
    key = F.struct("late", "depth")
    while True:
        ahead = edges.join(state.withColumnRenamed("turn", "before"), ["conv", "before"])
        push = ahead.groupBy("conv", F.col("after").alias("turn")).agg(
            F.max(F.struct(F.col("late").alias("late"), (F.col("depth") + 1).alias("depth"))).alias("need")
        )
        moved = state.join(push, ["conv", "turn"], "left").withColumn("moved", F.coalesce(F.col("need") > key, F.lit(False)))
        moved = moved.select(
            "conv", "turn",
            F.when(F.col("moved"), F.col("need.late")).otherwise(F.col("late")).alias("late"),
            F.when(F.col("moved"), F.col("need.depth")).otherwise(F.col("depth")).alias("depth"),
            "moved",
        )
        moved = materialize(moved, "order")
        state = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return state


def link_tool_calls(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, turn, role, message (canonical JSON), order_turn, order_depth,
    n_calls, n_answered, n_invalid, n_unchecked, n_forward, is_result, linked.

    Sorting a conversation by (order_turn, order_depth, turn) puts every call before its result
    and every result before the calls that refer to it. Within a conversation the first call with
    an id is the call; results with its id link to it, others are orphans (``linked`` false).
    ``n_invalid`` counts calls without a declared schema or with arguments that break it;
    ``n_unchecked`` those whose schema has keywords unknown here. An argument ``"$id"`` fits any
    schema if an earlier call of the conversation has the id, else it is checked as plain text.
    ``n_forward`` counts arguments that refer to the call itself or to a later one; they order
    nothing, so no cycle can arise. A turn that makes calls is no result. A null or broken text is
    plain content; calls and results without an id, and turns without a
    conversation or number, stay as they are and link to nothing. Repeated rows give repeated
    rows; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(turns.sparkSession)
    own = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"),
    )
    like = F.coalesce(F.col("text").rlike(r'^\s*\{[\s\S]*"(tools|tool_calls|tool_call_id)"[\s\S]*\}\s*$'), F.lit(False))
    formed = own.where(like & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    formed = formed.select("conv", "turn", F.from_json("text", _SHAPE).alias("j")).where("j is not null")
    formed = materialize(formed, "tool-turns")

    schemas = (
        formed.select("conv", F.explode("j.tools").alias("t")).where("t.name is not null")
        .groupBy("conv", F.col("t.name").alias("name")).agg(F.min("t.parameters").alias("schema"))
    )
    calls = formed.select("conv", "turn", F.posexplode("j.tool_calls").alias("place", "c")).select(
        "conv", "turn", "place", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments")
    )
    calls = split_join(calls, schemas, ["conv", "name"], "left", "schemas")
    calls = materialize(calls, "calls")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "place")).alias("call"))
    first = materialize(first.select("conv", "id", F.col("call.turn").alias("call_turn"), F.col("call.place").alias("place")), "first-calls")
    results = formed.where("j.tool_call_id is not null and j.tool_calls is null").select("conv", "turn", F.col("j.tool_call_id").alias("id")).distinct()
    links = materialize(results.join(first, ["conv", "id"], "left"), "links")
    answered = links.where("call_turn is not null").select("conv", F.col("call_turn").alias("turn"), "place").distinct()

    wanted = calls.select("conv", "turn", "place", F.explode(F.expr(f"regexp_extract_all(arguments, '{_REFERENCE.replace(chr(92), chr(92) * 2)}', 1)")).alias("id"))
    earlier = wanted.withColumnRenamed("place", "at").join(first, ["conv", "id"]).where(
        F.struct("call_turn", "place") < F.struct("turn", "at")
    )
    refs = earlier.groupBy("conv", "turn", F.col("at").alias("place")).agg(F.collect_set("id").alias("refs"))
    checked = split_join(calls, refs, ["conv", "turn", "place"], "left", "earlier-calls")
    checked = materialize(checked.select("conv", "turn", _checked("arguments", "schema", "refs").alias("error")), "checked-calls")
    known = links.where("call_turn is not null").select("conv", "id", "turn", "call_turn")
    uses = materialize(known.join(wanted.drop("place").withColumnRenamed("turn", "after"), ["conv", "id"]), "references")
    edges = known.select("conv", F.col("call_turn").alias("before"), F.col("turn").alias("after")).union(
        uses.where("call_turn < after").select("conv", F.col("turn").alias("before"), "after")
    )
    order = _settled(materialize(edges.where("before <> after").distinct(), "call-edges"))

    skipped = F.col("error").startswith(UNCHECKED)
    per_call = checked.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(~skipped).alias("n_invalid"), F.count_if(skipped).alias("n_unchecked")
    )
    per_answer = answered.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_answered"))
    forward = uses.where("call_turn >= after").groupBy("conv", F.col("after").alias("turn")).agg(F.count_distinct("id").alias("n_forward"))
    per_result = links.groupBy("conv", "turn").agg(F.max(F.col("call_turn").isNotNull()).alias("linked"))
    facts = order.join(per_call, ["conv", "turn"], "full").join(per_answer, ["conv", "turn"], "full").join(per_result, ["conv", "turn"], "full").join(forward, ["conv", "turn"], "full")
    rows = split_join(own, facts, ["conv", "turn"], "left", "turn-facts")
    none = F.lit(0).cast("long")
    return rows.select(
        F.col("conv").alias("conv_id"), "turn", "role", _message("role", "text", like).alias("message"),
        F.coalesce("late", "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("order_depth"),
        *(F.coalesce(c, none).alias(c) for c in ("n_calls", "n_answered", "n_invalid", "n_unchecked", "n_forward")),
        F.col("linked").isNotNull().alias("is_result"), F.coalesce("linked", F.lit(False)).alias("linked"),
    )
