"""Chat formatting with tool calls: calls and results are hash-joined by identifier, ordered topologically, checked
against schemas and written as canonical JSON. DataFrame functions only.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object with `tool_calls` (a list of objects with
id, name, arguments and, where a call needs other calls' results, depends_on, a list of ids) makes its message a call
message; a text of role `tool` that is an object with `tool_call_id` is a result. All others are plain. `schemas` is a
table (name, param, type, required) of the tools' parameters; type is the name that Spark gives a JSON value's type
(STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT, ...).

Order: plain messages keep their turn as their place. A call's place is the latest turn among its own and those of all calls that it depends on,
at any remove; its level is 0, or one more than the highest level of the calls it depends on. A result has its call's place and level.
Sorting a conversation by (place, level, kind, turn, item) is a topological order, also where a call depends on one of a later
turn: that one's place is no later, and its level is lower. Levels are found over the calls alone, by pointer jumping along chains and waves between them,
each stored, until no call is left or none moves; calls on a cycle, or on a call that isn't there, keep level null and `resolved` false, and sort last in their
place. Nothing is gathered per conversation, so a conversation of any length is spread over tasks.

Canonical JSON: keys sorted, no white space, absent values left out, argument objects with sorted keys.

Cases: null texts give messages without content; texts that aren't JSON are plain; of several calls of one id in a
conversation, the one of the earliest turn and item counts for links, and of several results the earliest is linked,
the others aren't (`linked` false). Rows with null conv_id are never linked. Repeated rows each give a row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import stored, with_uid

#: Rows of a canonical line, in sort order within one place and level.
KINDS = {"message": 0, "call": 1, "result": 2}
PARAMETERS = "name string, param string, type string, required boolean"


def quoted(c):
    """A string as a JSON string."""
    return F.expr(f"to_json(cast({c} as variant))")


def line(**parts):
    """A canonical object from JSON texts by key; null ones are left out."""
    fields = [F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def entries(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each plain message, call and result, from one pass over the messages: uid, conv_id, turn, kind, item, call_id, needs (the
    calls that a call depends on), faults and json."""
    looks = F.col("text").rlike(r"^\s*\{")
    m = messages.select("conv_id", "turn", "role", "text", F.when(looks, F.try_parse_json("text")).alias("v"))
    called = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    answers = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    m = m.select("conv_id", "turn", "role", "text", "v", called.alias("called"), answers.alias("answers"))
    kind = F.when(F.col("called").isNotNull(), "call").when(F.col("answers").isNotNull(), "result").otherwise("message")
    content = F.when(F.col("kind") == "message", quoted("text")).when(F.col("kind") == "result", F.coalesce(F.expr("to_json(try_variant_get(v, '$.content', 'variant'))"), F.lit("null")))
    m = m.withColumn("kind", kind).select("conv_id", "turn", "role", "kind", "answers", content.alias("content"), F.posexplode(F.coalesce("called", F.expr("array(cast(null as variant))"))).alias("item", "c"))
    get = lambda path, kind: F.try_variant_get("c", path, kind)
    m = m.select("conv_id", "turn", "role", "kind", "item", "content", F.coalesce("answers", get("$.id", "string")).alias("call_id"), get("$.name", "string").alias("name"), get("$.arguments", "variant").alias("arguments"), F.array_distinct(F.coalesce(get("$.depends_on", "array<string>"), F.array().cast("array<string>"))).alias("needs"))
    json = line(arguments=F.expr("to_json(arguments)"), content=F.col("content"), id=quoted("call_id"), name=quoted("name"), role=quoted("role"), type=F.concat(F.lit('"'), F.when(F.col("kind") == "message", "").otherwise("tool_"), "kind", F.lit('"')))
    return with_uid(with_faults(m, schemas).select("conv_id", "turn", "kind", "item", "call_id", "needs", "faults", json.alias("json")))


def with_faults(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """With faults, of calls: an unknown tool, missing parameters, values of another type, unknown parameters; of others none. Each tool's
    parameters are one row, so that a call finds its faults in its own row."""
    tools = schemas.where("name is not null").groupBy(F.col("name").alias("tool")).agg(F.collect_list(F.struct("param", "type", "required")).alias("params"))
    none = F.array().cast("array<string>")
    rows = rows.join(tools, (F.col("kind") == "call") & (F.col("name") == F.col("tool")), "left").withColumn("given", F.coalesce(F.expr("map_entries(try_cast(arguments as map<string, variant>))"), F.expr("array()")))
    params = F.coalesce("params", F.expr("array()"))
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.coalesce(F.exists("given", lambda g: g["key"] == p["param"]), F.lit(False))), lambda p: F.concat(F.lit("missing "), p["param"]))

    def wrong(g):
        is_ = F.regexp_extract(F.schema_of_variant(g["value"]), r"^\w+", 0)
        known = F.filter(params, lambda p: p["param"] == g["key"])
        each = F.transform(known, lambda p: F.when(p["type"].isNull(), F.concat(F.lit("unknown "), g["key"])).when(p["type"] != is_, F.concat(F.lit("type "), g["key"])))
        return F.when(F.size(known) > 0, each).otherwise(F.array(F.concat(F.lit("unknown "), g["key"])))

    faults = F.concat(missing, F.flatten(F.transform("given", wrong)), F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(none))
    return rows.withColumn("faults", F.when(F.col("kind") == "call", F.sort_array(F.array_distinct(F.array_compact(faults)))).otherwise(none))


def counted(df: DataFrame, **what) -> tuple[DataFrame, dict]:
    """The rows stored, and how many of them fulfil each condition, counted while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *(F.count_if(c).alias(k) for k, c in what.items())))
    return out, seen.get


def levels(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """(uid, level, place) of the calls with dependencies that can be ordered; a call without any has level 0 and its turn as its place.

    Calls with one dependency form chains, which pointer jumping shortens to their heads in as many rounds as the longest
    has bits; then each wave settles the calls whose several dependencies are settled. A row knows how many dependencies its
    head has, so it is at the end of its chain when that isn't one. A round in which none gets there leaves circles and calls behind missing ones."""
    needs = calls.select("uid", "conv_id", "turn", F.size("needs").alias("n"), F.explode("needs").alias("call_id"))
    found = keys.select("conv_id", "call_id", "call")
    needs = needs.join(found, ["conv_id", "call_id"], "left").select("uid", "turn", "n", F.col("call.uid").alias("on"), F.col("call.turn").alias("on_turn"), F.col("call.n").alias("on_n"))
    edges, seen = counted(needs, several=F.col("n") > 1, onward=(F.col("n") == 1) & (F.col("on_n") == 1))
    chains = edges.where("n = 1 and on is not null").select("uid", F.col("on").alias("head"), F.col("on_n").alias("head_n"), F.lit(1).alias("steps"), F.greatest("turn", "on_turn").alias("latest"))
    at_end, onward = chains.where("head_n <> 1"), chains.where("head_n = 1")
    left = seen["onward"]
    while left:
        heads = at_end.unionByName(onward).select(F.col("uid").alias("head"), F.col("head").alias("next"), F.col("head_n").alias("next_n"), F.col("steps").alias("more"), F.col("latest").alias("later"))
        jumped = onward.join(heads, "head").select("uid", F.col("next").alias("head"), F.col("next_n").alias("head_n"), (F.col("steps") + F.col("more")).alias("steps"), F.greatest("latest", "later").alias("latest"))
        jumped, moved = counted(jumped, ended=F.col("head_n") != 1, onward=F.col("head_n") == 1)
        at_end, onward = at_end.unionByName(jumped.where("head_n <> 1")), jumped.where("head_n = 1")
        left = moved["onward"] if moved["ended"] else 0
    done = at_end.where("head_n = 0").select("uid", F.col("steps").alias("level"), F.col("latest").alias("place"))
    if not seen["several"]:
        return done
    chains = at_end.where("head_n > 1")
    done = done.unionByName(calls.where(F.size("needs") == 0).select("uid", F.lit(0).alias("level"), F.col("turn").alias("place")))
    along = lambda settled: settled.unionByName(chains.join(settled.withColumnRenamed("uid", "head"), "head").select("uid", (F.col("level") + F.col("steps")).alias("level"), F.greatest("place", "latest").alias("place")))
    waiting, left, rest = edges.where("n > 1").select("uid", "turn", "on"), None, seen["several"]
    while rest and rest != left:
        known = along(done).withColumnRenamed("uid", "on")
        ready = waiting.join(known, "on", "left").groupBy("uid").agg(F.every(F.col("level").isNotNull()).alias("all"), F.max("level").alias("top"), F.max("place").alias("place"), F.max("turn").alias("turn")).where("all")
        done = stored(done.unionByName(ready.select("uid", (F.col("top") + 1).alias("level"), F.greatest("place", "turn").alias("place"))))
        left = rest
        waiting, seen = counted(waiting.join(done.select("uid"), "uid", "left_anti"), rest=F.lit(True))
        rest = seen["rest"]
    return along(done)


def formatted(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each message, call and result: conv_id, place, level, kind, turn, item, call_id, linked, resolved, faults, json.

    Texts are read from the messages once, and shuffled once more, when a row meets what is known of its call."""
    rows = stored(entries(messages, schemas))
    calls = rows.where("kind = 'call'")
    first = lambda kind, *of: F.min(F.when(F.col("kind") == kind, F.struct(*of)))
    keyed = rows.where("kind <> 'message' and conv_id is not null and call_id is not null")
    keys = stored(keyed.groupBy("conv_id", "call_id").agg(first("call", "turn", "item", "uid", F.size("needs").alias("n")).alias("call"), first("result", "turn", "uid").alias("answer")))
    order = levels(calls, keys)
    # what is known of a call: its first result, where it is linked, and its level and place, where it depends on others
    links = keys.where("call is not null and answer is not null").select("call.uid", F.col("answer.uid").alias("answer"), F.col("call.turn").alias("turn"), F.when(F.col("call.n") == 0, 0).alias("level"))
    known = links.unionByName(order, allowMissingColumns=True).groupBy("uid").agg(*(F.max(c).alias(c) for c in ("answer", "turn", "level", "place")))
    of_call = F.struct("uid", "level", "place", F.col("answer").isNotNull().alias("linked"))
    of_result = F.struct(F.col("answer").alias("uid"), "level", F.coalesce("place", "turn").alias("place"), F.lit(True).alias("linked"))
    known = known.select(F.inline(F.array_compact(F.array(of_call, F.when(F.col("answer").isNotNull(), of_result)))))
    alone = F.when((F.col("kind") == "message") | ((F.col("kind") == "call") & (F.size("needs") == 0)), 0)
    out = rows.join(known, "uid", "left").withColumns({"level": F.coalesce("level", alone), "place": F.coalesce("place", "turn"), "linked": F.coalesce("linked", F.lit(False))})
    return out.select("conv_id", "place", "level", "kind", "turn", "item", "call_id", "linked", F.col("level").isNotNull().alias("resolved"), "faults", "json")


def sort_keys():
    """A conversation's order: topological for calls and results."""
    kind = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v)))
    return ["conv_id", "place", F.col("level").asc_nulls_last(), kind[F.col("kind")], "turn", "item", "json"]


def positioned(rows: DataFrame, *columns) -> DataFrame:
    """The columns (all, where none are given) with position, the place of a row in its conversation from 0. Rows are cut into ranges by
    conversation and order, and a range is numbered from what the conversation's earlier ranges have, so a long conversation is many
    tasks' work. Only the columns are kept beyond the sort."""
    keys = sort_keys()
    columns = columns or rows.columns
    cut = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", F.struct(*columns).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv_id").alias("conv"), F.col("part").alias("in"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    placed = cut.join(starts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("in")))
    return placed.select("row.*", (F.col("at") + F.col("shift")).alias("position"))


def dialogue_calls(conversations: DataFrame) -> DataFrame:
    """Dialogues without tools as messages with calls: a user's turn calls `reply` with its text and turn, and depends on the call of two turns
    before where there is one, in every fifth conversation of two turns after; an assistant's turn is the result of the turn before. In
    two of three conversations the turn is given as a string or left out."""
    c = conversations.select("conv_id", "turn", "role", "text")
    key = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    step = F.when(F.col("conv_id") % 5 == 4, 2).otherwise(-2)
    # whether the user spoke there: the same row seen from there
    there = c.where("role = 'user'").select("conv_id", (F.col("turn") - step).alias("turn"), F.lit(True).alias("again")).distinct()
    users = c.where("role = 'user'").join(there, ["conv_id", "turn"], "left")
    needs = F.when(F.col("again"), F.array(key(F.col("turn") + step)))
    call = lambda *given: F.to_json(F.struct(F.array(F.struct(key(F.col("turn")).alias("id"), F.lit("reply").alias("name"), F.struct(*given).alias("arguments"), needs.alias("depends_on"))).alias("tool_calls")))
    kind = F.col("conv_id") % 3
    called = F.when(kind == 1, call("text", F.col("turn").cast("string").alias("turn"))).when(kind == 2, call("text")).otherwise(call("text", "turn"))
    answered = F.to_json(F.struct(key(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    user = users.select("conv_id", "turn", "role", called.alias("text"))
    other = c.where("role <> 'user' or role is null").select("conv_id", "turn", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", answered).otherwise(F.col("text")).alias("text"))
    return user.unionByName(other)


def op6(spark, sf_dir: str) -> DataFrame:
    messages = dialogue_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame([("reply", "text", "STRING", True), ("reply", "turn", "BIGINT", True)], PARAMETERS)
    digests = F.size("faults").cast("long").alias("n_faults"), F.sha2("json", 256).alias("json_sha256")
    out = positioned(formatted(messages, schemas), "conv_id", "turn", "kind", "place", "level", "call_id", "linked", *digests)
    return out.select("conv_id", "turn", "kind", "place", "level", "position", "call_id", "linked", "n_faults", "json_sha256")


ORACLE_OP6 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, 'call-' || conv_id || '-' || turn AS me, 'call-' || conv_id || '-' || (turn - 1) AS prior, CASE WHEN conv_id % 5 = 4 THEN 2 ELSE -2 END AS step FROM conversations),
l AS (SELECT conv_id, turn, 0 AS level, turn AS place FROM c a WHERE role = 'user' AND NOT EXISTS (FROM c b WHERE b.role = 'user' AND b.conv_id = a.conv_id AND b.turn = a.turn + a.step)
 UNION ALL SELECT c.conv_id, c.turn, l.level + 1, greatest(l.place, c.turn) FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn + c.step = l.turn AND c.role = 'user'),
u AS (SELECT c.*, l.level, l.place, CASE conv_id % 3 WHEN 1 THEN ',"turn":"' || turn || '"' WHEN 2 THEN '' ELSE ',"turn":' || turn END AS given, EXISTS (FROM c b WHERE b.role = 'assistant' AND b.conv_id = c.conv_id AND b.turn = c.turn + 1) AS linked FROM c JOIN l USING (conv_id, turn) WHERE role = 'user'),
x AS (SELECT conv_id, turn, 'call' AS kind, 1 AS o, place, level, me AS call_id, linked, CASE WHEN conv_id % 3 > 0 THEN 1 ELSE 0 END AS n_faults, '{"arguments":{"text":' || to_json(text) || given || '},"id":"' || me || '","name":"reply","role":"user","type":"tool_call"}' AS j FROM u
 UNION ALL SELECT c.conv_id, c.turn, 'result', 2, coalesce(u.place, c.turn), u.level, c.prior, u.turn IS NOT NULL, 0, '{"content":' || to_json(c.text) || ',"id":"' || c.prior || '","role":"tool","type":"tool_result"}' FROM c LEFT JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1 WHERE c.role = 'assistant'
 UNION ALL SELECT conv_id, turn, 'message', 0, turn, 0, NULL, false, 0, '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' FROM c WHERE role NOT IN ('user', 'assistant'))
SELECT conv_id, turn, kind, place, CAST(level AS INTEGER) AS level, row_number() OVER (PARTITION BY conv_id ORDER BY place, level NULLS LAST, o, turn, CAST(j AS VARCHAR)) - 1 AS position, call_id, linked, CAST(n_faults AS BIGINT) AS n_faults, sha256(CAST(j AS VARCHAR)) AS json_sha256 FROM x
"""
