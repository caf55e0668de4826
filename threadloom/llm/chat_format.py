"""Chat formatting with tool-call linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, places, written

_CALLS = "array<struct<id:string,name:string,arguments:variant>>"
_PROPERTY = "struct<type:string,enum:variant,items:struct<type:string>>"
_TOOLS = f"array<struct<name:string,parameters:struct<properties:map<string,{_PROPERTY}>,required:array<string>,additionalProperties:variant>>>"
#: JSON-schema type names and the variant types that are of them.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}


def _is_type(value: Column, name: Column) -> Column:
    """Whether value is of the type of that name, or of one of a JSON list of names; a type that is not known is not checked."""
    kind = F.schema_of_variant(value)
    known, fits = F.lit(False), F.lit(False)
    for t, kinds in _TYPES.items():
        named = (name == t) | (F.startswith(name, F.lit("[")) & F.contains(name, F.lit(f'"{t}"')))
        of = F.lit(False)
        for k in kinds:
            of = of | kind.startswith(k)
        known, fits = known | named, fits | (named & of)
    return ~known | fits


def _breaks(value: Column, rule: Column) -> Column:
    """Whether a given argument breaks its property's rule; an absent one doesn't."""
    items = F.try_variant_get(value, "$", "array<variant>")
    of_items = F.exists(items, lambda x: ~F.coalesce(_is_type(x, rule["items"]["type"]), F.lit(True)))
    allowed = F.transform(F.try_variant_get(rule["enum"], "$", "array<variant>"), lambda x: F.to_json(x))
    outside = ~F.array_contains(allowed, F.to_json(value))
    wrong = ~F.coalesce(_is_type(value, rule["type"]), F.lit(True))
    return value.isNotNull() & (wrong | F.coalesce(of_items, F.lit(False)) | F.coalesce(outside, F.lit(False)))


def _after_calls(rows: DataFrame) -> DataFrame:
    """rows with order (at, hops): that of a message is greater than that of the call it answers.

    A message that answers none is at its own turn; else it is at the later of its turn and its
    call's place, hops behind. Only where a call's message answers one itself, places are handed on,
    until none changes.
    """
    own = lambda turn: F.struct(turn.alias("at"), F.lit(0).alias("hops"))
    behind = lambda call: F.struct(call["at"].alias("at"), (call["hops"] + 1).alias("hops"))
    # A null turn is before all others.
    early = lambda turn, call: (call["at"].isNull() & turn.isNotNull()) | F.coalesce(call["at"] < turn, F.lit(False))
    later = lambda turn, call: F.when(call.isNull() | early(turn, call), own(turn)).otherwise(behind(call))
    both = rows.where((F.col("kind") == "calls") & F.col("call_turn").isNotNull())
    both = written(both.select(F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"), F.xxhash64("text").alias("b_k"), F.col("call_turn").alias("up_turn"), F.col("call_k").alias("up_k"), own(F.col("turn")).alias("state")).distinct(), "answering")
    most = both.groupBy("b_conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for turn in range(most + 1):
        above = both.select(F.col("b_conv").alias("a_conv"), F.col("b_turn").alias("a_turn"), F.col("b_k").alias("a_k"), F.col("state").alias("up"))
        new = both.join(above, F.col("b_conv").eqNullSafe(F.col("a_conv")) & F.col("up_turn").eqNullSafe(F.col("a_turn")) & (F.col("up_k") == F.col("a_k")), "left")
        call = F.coalesce("up", own(F.col("up_turn")))
        new = new.withColumn("next", later(F.col("b_turn"), call)).withColumn("moved", ~F.col("next").eqNullSafe(F.col("state")))
        # What still moves after as many rounds as there are messages waits in a circle, or for one.
        state = F.when(F.col("moved"), own(F.col("b_turn"))).otherwise(F.col("state")) if turn == most else F.col("next")
        moved = written(new.select("b_conv", "b_turn", "b_k", "up_turn", "up_k", state.alias("state"), "moved"), "answering")
        discard(both)
        both = moved
        if not both.where("moved").limit(1).count():
            break
    known = both.select("b_conv", "b_turn", "b_k", "state").distinct()
    up = known.select(F.col("b_conv").alias("a_conv"), F.col("b_turn").alias("a_turn"), F.col("b_k").alias("a_k"), F.col("state").alias("up"))
    out = rows.join(known, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("turn").eqNullSafe(F.col("b_turn")) & (F.xxhash64("text") == F.col("b_k")) & (F.col("kind") == "calls"), "left")
    out = out.join(up, F.col("conv_id").eqNullSafe(F.col("a_conv")) & F.col("call_turn").eqNullSafe(F.col("a_turn")) & (F.col("call_k") == F.col("a_k")) & F.col("answers").isNotNull(), "left")
    call = F.coalesce("up", F.when(F.col("call_turn").isNotNull(), own(F.col("call_turn"))))
    return out.withColumn("order", F.coalesce("state", later(F.col("turn"), call))).drop("b_conv", "b_turn", "b_k", "state", "a_conv", "a_turn", "a_k", "up")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, position, role, kind, call_ids, answers_turn, n_calls, n_linked, n_invalid, json) of each row of turns.

    A text that is a JSON object with `tool_calls` (a list of id, name, arguments) holds calls, one
    with `tool_call_id` a result, one with `tools` (a list of name, parameters) schemas of its
    conversation's tools. Results are joined to calls by conversation and identifier, the earliest
    call of that identifier. position counts a conversation's messages from 0 in topological order:
    by turn, but a result never before its call, also where that message is moved behind a call that
    it answers itself. Messages that wait for one another in a circle, and those that wait for such,
    keep their turn. A call is invalid when its conversation has schemas but none of its tool, or
    its tool has one and a required argument is missing or null, an argument (or an element of a
    list, by items) is of another type, or not one of enum, or is not named where
    additionalProperties is false. A type may be a list of names. Of several schemas of a tool the one
    of the earliest turn counts, of one turn the first in the order of texts, of one text the first.
    Objects inside arguments are not looked into.
    n_linked: calls with a result (for a result: 1 if its call is there). json is the message as
    canonical JSON: keys sorted, no blanks. Other texts are plain content, null and broken JSON too;
    null conversations are one conversation; null turns come first; repeated rows stay rows. Other
    columns of turns are not read.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    maybe = F.col("text").rlike(r"^\s*\{") & F.col("text").rlike(r'"(tool_calls|tool_call_id|tools)"')
    rows = rows.withColumn("v", F.when(maybe, F.try_parse_json("text")))
    rows = rows.withColumns({"calls": F.try_variant_get("v", "$.tool_calls", _CALLS), "answers": F.try_variant_get("v", "$.tool_call_id", "string"), "tools": F.try_variant_get("v", "$.tools", _TOOLS)})
    kind = F.when(F.size("calls") > 0, "calls").when(F.col("answers").isNotNull(), "result").when(F.size("tools") > 0, "tools").otherwise("content")
    rows = rows.withColumn("kind", kind)
    # Only rows that hold calls, results or schemas take part in the joins.
    calls = rows.where("kind = 'calls'").select("conv_id", "turn", F.xxhash64("text").alias("k"), F.posexplode("calls").alias("at", "c"))
    calls = calls.select("conv_id", "turn", "k", "at", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at", "k")).alias("f")).select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_id"), F.col("f.turn").alias("call_turn"), F.col("f.k").alias("call_k"))
    results = rows.where("kind = 'result'").select(F.col("conv_id").alias("r_conv"), F.col("answers").alias("r_id")).distinct()
    tools = rows.where("kind = 'tools'").select("conv_id", F.struct("turn", "text").alias("said"), F.posexplode("tools").alias("at", "t")).select(F.col("conv_id").alias("t_conv"), F.col("t.name").alias("t_name"), F.col("t.parameters").alias("p"), F.struct("said", "at").alias("said"))
    tools = tools.groupBy("t_conv", "t_name").agg(F.min_by("p", "said").alias("p"))
    given = F.from_json(F.to_json("arguments"), "map<string,variant>")
    checked = calls.join(tools, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("name") == F.col("t_name")), "left").withColumn("given", F.when(F.col("p").isNotNull(), given))
    schemas = tools.select(F.col("t_conv").alias("s_conv"), F.lit(True).alias("known")).distinct()
    absent = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
    missing = F.exists(F.coalesce("p.required", F.array().cast("array<string>")), lambda r: absent(F.element_at("given", r)))
    wrong = F.exists(F.map_entries("p.properties"), lambda e: F.coalesce(_breaks(F.element_at("given", e["key"]), e["value"]), F.lit(False)))
    closed = F.to_json("p.additionalProperties") == "false"
    besides = closed & F.exists(F.map_keys("given"), lambda name: ~F.coalesce(F.map_contains_key("p.properties", name), F.lit(False)))
    rules = F.col("given").isNull() | missing | F.coalesce(wrong, F.lit(False)) | F.coalesce(besides, F.lit(False))
    checked = checked.join(schemas, F.col("conv_id").eqNullSafe(F.col("s_conv")) & F.col("p").isNull() & F.col("t_name").isNull(), "left")
    unknown = F.col("known").isNotNull()
    invalid = F.coalesce(unknown | (F.col("p").isNotNull() & rules), F.lit(False))
    checked = checked.withColumn("invalid", invalid).drop("s_conv", "known").join(results, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
    by_turn = checked.groupBy("conv_id", "turn", "k").agg(F.countDistinct("at").alias("c_n"), F.countDistinct(F.when(F.col("r_id").isNotNull(), F.col("at"))).alias("c_linked"), F.countDistinct(F.when(F.col("invalid"), F.col("at"))).alias("c_invalid"))
    by_turn = by_turn.select(F.col("conv_id").alias("c_conv"), F.col("turn").alias("c_turn"), F.col("k").alias("c_k"), "c_n", "c_linked", "c_invalid")
    out = rows.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("answers") == F.col("f_id")), "left")
    out = out.join(by_turn, F.col("conv_id").eqNullSafe(F.col("c_conv")) & F.col("turn").eqNullSafe(F.col("c_turn")) & (F.xxhash64("text") == F.col("c_k")) & (F.col("kind") == "calls"), "left")
    out = places(_after_calls(out), "conv_id", [F.col("order.at").asc_nulls_first(), F.col("order.hops"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()], "position")
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    # A variant keeps an object's fields sorted by name, so parsing and printing makes JSON canonical.
    merged = F.concat(F.lit('{"message":'), F.to_json("v"), F.lit(',"role":'), F.coalesce(F.to_json(F.struct(F.col("role").alias("r"))), F.lit("{}")), F.lit("}"))
    structured = F.to_json(F.try_parse_json(merged))
    return out.select(
        "conv_id", "turn", "position", "role", "kind", F.array_join(F.transform("calls", lambda c: c["id"]), ",").alias("call_ids"), F.col("call_turn").alias("answers_turn"),
        F.coalesce("c_n", F.lit(0)).alias("n_calls"), F.when(F.col("kind") == "result", F.col("call_turn").isNotNull().cast("long")).otherwise(F.coalesce("c_linked", F.lit(0))).alias("n_linked"), F.coalesce("c_invalid", F.lit(0)).alias("n_invalid"),
        F.when(F.col("kind") == "content", plain).otherwise(structured).alias("json"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
