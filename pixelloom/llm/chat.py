"""Chat formatting: tool-call linking, with DataFrame functions only.

Calls and results are joined by (conversation, identifier).  Messages are then put in
topological order: every message has a place (turn, depth).  The turn is its own unless
something it depends on comes later, then it moves there; the depth is 0 for a call that waits
for nothing, one more for each result and each call on the longest way to a message.  Arguments are checked
against a schema, and every message becomes one line of canonical JSON: keys sorted by code
point, no white space.

A message of role ``assistant`` may be JSON ``{"tool_calls": [{"id", "name", "arguments",
"after"}]}`` and one of role ``tool`` JSON ``{"tool_call_id", "content"}``; ``after`` lists
identifiers whose results a call needs.  In plain conversations a user's turn is read as the
call ``ask`` with the arguments ``text`` and ``turn``, and the assistant's turn right after it
as its result; it waits for the result right before it.

Defined results: null texts are null arguments or contents.  Null roles and roles that are
none of these are notes.  A result without its call is an orphan and a call without a result is
open.  Rows with a null conversation or turn keep their line and link with nothing.  Repeated
results of a call all link to it; an identifier that several calls use belongs to the first
turn.  Calls that wait for each other are invalid and keep their own turn.  Extra columns are
ignored.  Nothing collects a conversation, so one of any length is many rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Argument schemas: name -> {field: (type as schema_of_variant names it, required)}.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"ask": {"text": ("STRING", True), "turn": ("BIGINT", True)}}


def plain_events(messages: DataFrame) -> DataFrame:
    """Events of plain conversations (conv_id, turn, role, text).  A call waits for the result right
    before it, which is that of the call two turns back."""
    turn = F.col("turn").cast("long")
    ident = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    call, result = F.col("role").eqNullSafe("user"), F.col("role").eqNullSafe("assistant")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    arguments = F.to_json(F.struct(F.col("text").cast("string").alias("text"), turn.alias("turn")), {"ignoreNullFields": "false"})
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"),
        F.when(call, "call").when(result, "result").otherwise("note").alias("kind"),
        F.when(whole & call, ident(turn)).when(whole & result, ident(turn - 1)).alias("call_id"),
        F.when(call, "ask").alias("name"), F.when(call, arguments).alias("arguments"),
        F.when(~call, F.col("text").cast("string")).alias("content"),
        F.when(whole & call, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )


_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_REPLY = "struct<tool_call_id:string,content:string>"


def events(messages: DataFrame) -> DataFrame:
    """Events of any conversations: messages that are tool calls or results in JSON are read as such,
    all others as plain turns."""
    json = F.ltrim(F.col("text").cast("string")).startswith("{")
    calls = (F.col("role") == "assistant") & F.from_json(F.col("text").cast("string"), _CALLS)["tool_calls"].isNotNull()
    reply = (F.col("role") == "tool") & F.from_json(F.col("text").cast("string"), _REPLY)["tool_call_id"].isNotNull()
    tools = F.coalesce(json & (calls | reply), F.lit(False))
    return plain_events(messages.where(~tools)).unionByName(tool_events(messages.where(tools)))


def tool_events(messages: DataFrame) -> DataFrame:
    """Events of conversations whose texts hold tool calls and results as JSON; an assistant
    message with several calls gives one event for each."""
    calls, reply = F.from_json("text", _CALLS), F.from_json("text", _REPLY)
    parsed = messages.select("conv_id", "turn", "role", "text", F.when(F.col("role") == "assistant", calls).alias("c"), F.when(F.col("role") == "tool", reply).alias("r"))
    one = parsed.withColumn("x", F.explode_outer("c.tool_calls"))
    call, result = F.col("x").isNotNull(), F.col("r.tool_call_id").isNotNull()
    return one.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.when(call, "call").when(result, "result").otherwise("note").alias("kind"),
        F.when(call, F.col("x.id")).when(result, F.col("r.tool_call_id")).alias("call_id"),
        F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"),
        F.when(~call, F.coalesce(F.when(result, F.col("r.content")), "text")).alias("content"),
        F.coalesce("x.after", F.array().cast("array<string>")).alias("after"),
    )


def _valid(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether the arguments of a call are JSON that fits the schema of its name."""
    out = F.lit(False)
    for name, fields in sorted(schemas.items()):
        fit = F.lit(True)
        for field, (kind, required) in sorted(fields.items()):
            value = F.schema_of_variant(F.try_variant_get("v", f"$['{field}']", "variant"))
            missing = F.lit(not required)
            fit = fit & F.when(value.isNull() | (value == "VOID"), missing).otherwise(value == kind)
        out = F.when(F.col("name") == name, F.col("v").isNotNull() & fit).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _ordered(events: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """events with order_turn, order_depth and cyclic.

    A call that waits for nothing has depth 0, a result one more than its call, and a call that
    waits one more than the deepest result that it needs.  Its turn is the latest of its own and
    those of all that it waits for.  ``named`` has the events with an identifier, without texts.
    """
    keys = ["conv_id", "call_id"]
    plain = {"order_turn": F.col("turn"), "order_depth": F.when(F.col("kind") == "result", 1).otherwise(0).cast("long"), "cyclic": F.lit(False)}
    named = named.where("turn is not null")
    calls = named.where("kind = 'call'")
    waits = calls.where("size(after) > 0").select(*keys, "turn", F.explode("after").alias("need")).where("need is not null")
    results = named.where("kind = 'result'").groupBy(*keys).agg(F.min("turn").alias("ready"))
    firsts = calls.groupBy(*keys).agg(F.min("turn").alias("asked"))
    needs = waits.join(results.withColumnRenamed("call_id", "need"), ["conv_id", "need"]).join(firsts.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
    needs = needs.groupBy(*keys, "need").agg(F.max(F.greatest("turn", "ready", "asked")).alias("t"))
    needs = scratch.save(needs, "needs")
    if needs.isEmpty():
        return events.withColumns(plain)
    several = needs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    places = _by_rounds(needs, scratch) if not several.isEmpty() else _by_doubling(needs, scratch)
    out = events.join(places, keys, "left")
    moved = F.coalesce(F.col("d").isNotNull(), F.lit(False)) & F.col("kind").isin("call", "result") & F.col("turn").isNotNull()
    deep = F.when(F.col("kind") == "result", F.col("d") + 1).otherwise(F.col("d"))
    out = out.withColumns({"order_turn": F.when(moved, F.greatest("turn", "t")).otherwise(plain["order_turn"]), "order_depth": F.when(moved, deep).otherwise(plain["order_depth"])})
    return out.withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).drop("t", "d")


def _by_doubling(needs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, t, d, cyclic) where each call waits for one other: chains, whose places are
    summed over twice the distance in every round, so a chain of n takes log n of them."""
    keys = ["conv_id", "call_id"]
    waiting = needs.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("more"))
    state = needs.join(waiting, ["conv_id", "need"], "left")
    state = scratch.save(state.select(*keys, F.when(F.col("more"), F.col("need")).alias("next"), F.col("t"), F.lit(2).cast("long").alias("d")), "chain0")
    rounds = int(state.groupBy("conv_id").count().agg(F.max("count")).first()[0]).bit_length() + 1
    for k in range(1, rounds + 1):
        if state.where("next is not null").isEmpty():
            break
        far = state.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("_next"), F.col("t").alias("_t"), F.col("d").alias("_d"))
        step = state.join(far, ["conv_id", "next"], "left")
        step = step.select(*keys, F.col("_next").alias("next"), F.greatest("t", "_t").alias("t"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"))
        state = scratch.save(step, f"chain{k}")
        scratch.drop(f"chain{k - 1}")
    # who still has somebody in front waits for itself
    cyclic = F.col("next").isNotNull()
    return state.select(*keys, F.when(~cyclic, F.col("t")).alias("t"), F.when(~cyclic, F.col("d")).alias("d"), cyclic.alias("cyclic"))


def _by_rounds(needs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same where calls wait for several others: each round settles those whose needs are
    settled, as many rounds as the longest chain has calls."""
    keys = ["conv_id", "call_id"]
    waiting = needs.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("more")).distinct()
    needs = scratch.save(needs.join(waiting, ["conv_id", "need"], "left"), "edges")
    settled, k = None, 0
    while True:
        left = needs if settled is None else needs.join(settled, keys, "left_anti")
        if settled is None:
            left = left.withColumns({"_t": F.lit(None).cast("long"), "_d": F.lit(None).cast("long")})
        else:
            left = left.join(settled.select("conv_id", F.col("call_id").alias("need"), F.col("t").alias("_t"), F.col("d").alias("_d")), ["conv_id", "need"], "left")
        free = F.col("more").isNull() | F.col("_d").isNotNull()
        ready = left.groupBy(*keys).agg(F.min(free).alias("free"), F.max(F.greatest("t", "_t")).alias("t"), F.max(F.coalesce("_d", F.lit(0)) + 2).cast("long").alias("d"))
        fresh = scratch.save(ready.where("free").select(*keys, "t", "d"), f"round{k}")
        if fresh.isEmpty():
            break
        settled = fresh if settled is None else scratch.save(settled.unionByName(fresh), f"settled{k}")
        k += 1
    every = needs.select(*keys).distinct()
    if settled is None:
        return every.select(*keys, F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("d"), F.lit(True).alias("cyclic"))
    return every.join(settled, keys, "left").withColumn("cyclic", F.col("d").isNull())


def link(events: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, role, call_id, status, linked_turn, order_turn, order_depth, valid, line)
    for every event.  Sort by conv_id, order_turn, order_depth, turn for the conversation."""
    scratch = Scratch(events.sparkSession, "chat")
    keys = ["conv_id", "call_id"]
    named = scratch.save(events.where("call_id is not null and conv_id is not null").select(*keys, "turn", "kind", "after"), "named")
    ordered = _ordered(events, named, scratch)
    calls = named.where("kind = 'call'").groupBy(*keys).agg(F.min("turn").alias("call_turn"))
    results = named.where("kind = 'result'").groupBy(*keys).agg(F.min("turn").alias("result_turn"))
    both = calls.join(results, keys, "full")
    rows = ordered.join(both, keys, "left")
    first = F.col("turn") == F.col("call_turn")
    linked = F.when(F.col("kind") == "call", F.when(first, F.col("result_turn"))).when(F.col("kind") == "result", F.col("call_turn"))
    status = (
        F.when(F.col("kind") == "note", "note").when(linked.isNotNull(), "linked").when(F.col("kind") == "call", "open").otherwise("orphan")
    )
    rows = rows.withColumn("v", F.try_parse_json("arguments")).withColumn("linked_turn", linked).withColumn("status", status)
    rows = rows.withColumn("valid", F.when(F.col("kind") == "call", _valid(schemas) & ~F.col("cyclic")))
    # fields in code point order; a variant's keys come out sorted and without white space
    keep = {"ignoreNullFields": "false"}
    call = F.to_json(F.struct(F.coalesce("v", F.to_variant_object(F.struct(F.col("arguments").alias("raw")))).alias("arguments"), F.col("call_id").alias("id"), "name", "role", "status"), keep)
    result = F.to_json(F.struct(F.col("call_id").alias("call"), "content", "role", "status"), keep)
    note = F.to_json(F.struct("content", "role"), keep)
    line = F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(note)
    return rows.select("conv_id", "turn", "role", "call_id", "status", "linked_turn", "order_turn", "order_depth", "valid", line.alias("line"))
