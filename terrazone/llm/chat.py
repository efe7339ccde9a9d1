"""Operator 2: chat formatting with tool-call linking.

A message's text may be a JSON object. One with "tool_calls" (an array of {id, name, arguments, after}) makes calls: id and name
are strings, arguments an object, after an optional array of ids of calls that come first. One in a message of role
`tool` with "tool_call_id" is a result. Calls and results are hash-joined by conversation and identifier; calls
are put in topological order of `after` (level 0 needs no other call, else one more than the largest level needed); arguments
are validated against the schema of the tool's name; every message, call and result is written as canonical JSON: keys in
order, no white space, null for what is missing. Nothing is grouped by conversation, so a conversation or first turn that is a
third of all rows is spread like any other; the order is given by columns: turn, then part (0 the message, 1 calls, 2 result),
then level, then call_index.

Levels cost a round for every doubling of the longest chain of calls that need one other call each, and a round for every level among
calls that need several.

Defined cases: text that isn't such an object (after JSON's white space) is plain text; null text, role, turn or conversation stay null; of several calls
with one identifier in a conversation the first by turn and index is linked, the others are `duplicate`; of several results the first by turn
and text is linked, the others are `orphan`, as are results without a call; a call without a result is `open`; a call whose
order runs in a circle, or needs an unknown call or one without a level, has no level and is `unordered`; an unknown tool has no schema and is
invalid; repeated rows are messages each; other columns, whatever their names, are ignored; texts may be of any length that a row can have;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.session import cut, drop

#: Tool name: argument: (type, needed). A type is the name of a JSON type or `integer`, a dict of fields (an object of these), or a list of one type.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
    "plan": {"steps": ([{"do": ("string", True), "times": ("integer", False)}], True), "by": ({"name": ("string", True), "sure": ("boolean", False)}, False)},
}
_CALLS = "array<struct<id string, name string, arguments variant, after array<string>>>"


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


def _fits(value: Column, kind) -> Column:
    """Whether a variant is of a type."""
    if isinstance(kind, dict):
        return _has_fields(value, kind)
    if isinstance(kind, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce((_kind(value) == "array") & F.forall(items, lambda x: _fits(x, kind[0])), F.lit(False))
    if kind == "integer":
        return F.coalesce(F.schema_of_variant(value) == "BIGINT", F.lit(False))
    return F.coalesce(_kind(value) == kind, F.lit(False))


def _has_fields(value: Column, schema: dict) -> Column:
    """Whether a variant is an object that has each needed field, none that is unknown, and each of its type."""
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    whole = F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(a) for a in sorted(schema)]).cast("array<string>"))) == 0
    for arg, (kind, needed) in sorted(schema.items()):
        held = F.try_element_at(fields, F.lit(arg))
        whole = whole & F.when(held.isNull(), F.lit(not needed)).otherwise(_fits(held, kind))
    return F.coalesce(F.when(fields.isNotNull(), whole), F.lit(False))


def valid_arguments(name: Column, arguments: Column, tools: dict) -> Column:
    """Whether arguments fits the schema of the tool's name."""
    found = F.lit(False)
    for tool, schema in sorted(tools.items()):
        found = F.when(name == tool, _has_fields(arguments, schema)).otherwise(found)
    return found


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of linked calls that can be ordered. calls: conv, id, after, one row for each conv and id.

    A call that needs just one other hangs on it; by doubling pointers each learns the first call up its chain that hangs on none, its root, and the
    distance. Roots without needs have level 0; those that need several calls get theirs round by round.
    """
    calls = cut(calls.select("conv", "id", F.array_distinct(F.array_compact(F.coalesce("after", F.array().cast("array<string>")))).alias("after")), "calls-after")
    single = calls.where(F.size("after") == 1).select("conv", "id", F.col("after")[0].alias("need"))
    known = calls.select("conv", "id")
    up = known.select(F.col("conv").alias("conv_"), F.col("id").alias("up"))
    hung = single.join(up, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("need") == F.col("up")), "left").select("conv", "id", F.col("up").alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("dist"), F.col("up").isNotNull().alias("open"))
    free = calls.where(F.size("after") != 1).select("conv", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("dist"), F.lit(False).alias("open"))
    state = cut(hung.unionByName(free), "chains")
    left = state.where("open").count()
    for _ in range(left.bit_length() + 1):  # what is open then runs in a circle
        if not left:
            break
        told = state.select(F.col("conv").alias("conv_"), F.col("id").alias("root_"), F.col("root").alias("far"), F.col("dist").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(told, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("root") == F.col("root_"))).select("conv", "id", F.col("far").alias("root"), (F.col("dist") + F.col("more")).alias("dist"), F.col("still").alias("open"))
        after = cut(state.where(~F.col("open")).unionByName(moved), "chains")
        drop(state)
        state, left = after, after.where("open").count()
    settled = state.where(~F.col("open") & F.col("root").isNotNull()).select("conv", "id", "root", "dist")
    level = calls.where(F.size("after") == 0).select("conv", "id", F.lit(0).cast("long").alias("level"))
    many = calls.where(F.size("after") > 1)
    if not many.isEmpty():
        asked = many.select("conv", "id", F.explode("after").alias("need"))
        ways = settled.select(F.col("conv").alias("conv_"), F.col("id").alias("need_"), "root", "dist")
        # what each of several needs hangs on; null where it is unknown or never settles
        asked = cut(asked.join(ways, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("need") == F.col("need_")), "left").select("conv", "id", "root", "dist"), "needs")
        level, size = cut(level, "levels"), -1
        while True:
            now = level.count()
            if now == size:
                break
            size = now
            told = level.select(F.col("conv").alias("conv_"), F.col("id").alias("root_"), "level")
            met = asked.join(told, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("root") == F.col("root_")), "left")
            ready = met.groupBy("conv", "id").agg(F.max(F.col("level") + F.col("dist")).alias("most"), F.count_if(F.col("level").isNull()).alias("open")).where(F.col("open") == 0)
            fresh = cut(level.where(F.col("level") == 0).unionByName(ready.select("conv", "id", (F.col("most") + 1).alias("level"))), "levels")
            drop(level)
            level = fresh
    roots = level.select(F.col("conv").alias("conv_"), F.col("id").alias("root_"), "level")
    found = settled.join(roots, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("root") == F.col("root_")))
    return found.select("conv", "id", (F.col("level") + F.col("dist")).cast("int").alias("level"))


def _canonical(**fields: Column) -> Column:
    """One JSON object of the fields by name; a variant field is written with its keys in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def format_chats(df: DataFrame, tools: dict = TOOLS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, call and result: conv, turn, part, level, call_index, role, call_id, status, valid, json."""
    rows = df.select(df[conv_col].alias("conv"), df[turn_col].alias("turn"), df[role_col].alias("role"), df[text_col].alias("text"))
    object_ = F.when(F.col("text").rlike(r"^[ \t\n\r]*\{"), F.try_parse_json("text"))
    rows = rows.withColumn("v", object_)
    rows = rows.withColumn("calls", F.when(~F.col("role").eqNullSafe("tool"), F.try_variant_get("v", "$.tool_calls", _CALLS))).withColumn("result_of", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    has = rows.where(F.col("calls").isNotNull())
    calls = cut(
        has.select("conv", "turn", "role", F.posexplode("calls").alias("call_index", "c")).select("conv", "turn", "role", "call_index", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.col("c.after").alias("after")),
        "calls",
    )
    results = cut(rows.where(F.col("result_of").isNotNull()).select("conv", "turn", "role", F.col("result_of").alias("id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"), "text"), "results")
    # the first call and the first result of an identifier; grouped minima, so rows of one identifier needn't meet
    first = calls.where(F.col("id").isNotNull()).groupBy("conv", "id").agg(F.min(F.struct("turn", "call_index")).alias("at"), F.min_by("after", F.struct("turn", "call_index")).alias("after"))
    answer = results.groupBy("conv", "id").agg(F.min(F.struct("turn", "text")).alias("answer"))
    level = _levels(first.select("conv", "id", "after"))
    keys = ["conv", "id"]
    hint = first.select("conv", "id", "at").hint("shuffle_hash")
    linked = hint.join(answer, _same(hint, answer, keys), "left").select(hint["conv"], hint["id"], "at", "answer")
    linked = linked.join(level.withColumnRenamed("conv", "conv_").withColumnRenamed("id", "id_"), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("id") == F.col("id_")), "left").drop("conv_", "id_")
    told = calls.join(linked.withColumnRenamed("conv", "conv_").withColumnRenamed("id", "id_"), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("id") == F.col("id_")), "left").drop("conv_", "id_")
    mine = F.col("at").eqNullSafe(F.struct("turn", "call_index"))
    arguments = F.try_parse_json("arguments")
    call_rows = told.select(
        "conv", "turn", F.lit(1).alias("part"), F.when(mine, F.col("level")).alias("level"), "call_index", "role", F.col("id").alias("call_id"),
        F.when(F.col("id").isNull(), "open").when(~mine, "duplicate").when(F.col("level").isNull(), "unordered").when(F.col("answer").isNull(), "open").otherwise("linked").alias("status"),
        valid_arguments(F.col("name"), arguments, tools).alias("valid"),
        _canonical(arguments=arguments, id=F.col("id"), name=F.col("name"), result_turn=F.when(mine, F.col("answer.turn"))).alias("json"),
    )
    back = results.join(linked.withColumnRenamed("conv", "conv_").withColumnRenamed("id", "id_"), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("id") == F.col("id_")), "left").drop("conv_", "id_")
    answers = F.col("answer").eqNullSafe(F.struct("turn", "text"))
    result_rows = back.select(
        "conv", "turn", F.lit(2).alias("part"), F.when(answers, F.col("level")).alias("level"), F.lit(0).alias("call_index"), "role", F.col("id").alias("call_id"),
        F.when(answers, "linked").otherwise("orphan").alias("status"), F.lit(None).cast("boolean").alias("valid"),
        _canonical(call_turn=F.when(answers, F.col("at.turn")), content=F.try_parse_json("content"), tool_call_id=F.col("id")).alias("json"),
    )
    content = F.when(F.col("calls").isNotNull(), F.try_variant_get("v", "$.content", "string")).otherwise(F.col("text"))
    message_rows = rows.where(F.col("result_of").isNull()).select(
        "conv", "turn", F.lit(0).alias("part"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("call_index"), "role", F.lit(None).cast("string").alias("call_id"),
        F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"), _canonical(content=content, role=F.col("role"), turn=F.col("turn")).alias("json"),
    )
    out = message_rows.unionByName(call_rows).unionByName(result_rows)
    return out.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    found = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        found = found & (a[k] == b[k])
    return found


def with_calls(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in which every assistant's message makes a call, for conversations that come without any.

    The call of turn t is c{t} and comes after that of turn t - 2. Its tool and arguments follow from the length n of the text, so some aren't valid:
    n mod 4 names the tool, and every other calculation lacks its expression. A message of role `tool` gives its result; where 5 divides n it is
    missing, and where 7 does it names another call.
    """
    n, turn = F.length(text_col), F.col(turn_col).cast("string")
    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "calculate", "fetch", "lookup")]), n % 4 + 1)
    arguments = F.struct(
        F.when((n % 8 == 1), F.concat(n.cast("string"), F.lit("+1"))).alias("expression"), F.when((n % 4 == 0) | (n % 8 == 5), n).alias("limit"),
        F.when(n % 4 == 0, F.md5(text_col)).alias("query"), F.when(n % 4 >= 2, F.concat(F.lit("https://example.org/"), F.md5(text_col))).alias("url"),
    )
    after = F.when(F.col(turn_col) >= 3, F.array(F.concat(F.lit("c"), (F.col(turn_col) - 2).cast("string"))))
    call = F.struct(F.concat(F.lit("c"), turn).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    asked = F.to_json(F.struct(F.col(text_col).alias("content"), F.array(call).alias("tool_calls")))
    told = F.to_json(F.struct(F.concat(F.when(n % 7 == 0, "x").otherwise("c"), turn).alias("tool_call_id"), F.struct(n.alias("chars")).alias("content")))
    mine = F.col(role_col).eqNullSafe("assistant") & F.col(text_col).isNotNull() & F.col(turn_col).isNotNull()
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    plain, calling = message(F.col(role_col), F.col(text_col)), message(F.col(role_col), asked)
    made = F.when(~mine, F.array(plain)).when(n % 5 == 0, F.array(calling)).otherwise(F.array(calling, message(F.lit("tool"), told)))
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.inline(made))


ORACLE_SQL = """
with m as (select conv_id, turn, role, text, length(text) as n, role = 'assistant' and text is not null and turn is not null as mine from conversations),
a as (select *, 'c' || turn as call_id, ['search', 'calculate', 'fetch', 'lookup'][n % 4 + 1] as name,
  case when n % 8 = 1 then '{"expression":"' || n || '+1"}' when n % 8 = 5 then '{"limit":' || n || '}'
    when n % 4 = 0 then '{"limit":' || n || ',"query":"' || md5(text) || '"}' else '{"url":"https://example.org/' || md5(text) || '"}' end as arguments,
  count(*) over (partition by conv_id, turn % 2 order by turn) as place from m where mine),
c as (select *, case when place = (turn + 1) // 2 then ((turn - 1) // 2)::int end as level, n % 5 <> 0 and n % 7 <> 0 as answered from a)
select conv_id, turn, 0 as part, null::int as level, 0 as call_index, role, null::varchar as call_id, 'message' as status, null::boolean as valid,
  '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || ',"turn":' || coalesce(turn::varchar, 'null') || '}' as json from m
union all
select conv_id, turn, 1, level, 0, role, call_id, case when level is null then 'unordered' when answered then 'linked' else 'open' end, n % 4 = 0 or n % 8 = 1 or n % 4 = 2,
  '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result_turn":' || case when answered then turn::varchar else 'null' end || '}' from c
union all
select conv_id, turn, 2, case when n % 7 <> 0 then level end, 0, 'tool', case when n % 7 = 0 then 'x' || turn else call_id end, case when n % 7 = 0 then 'orphan' else 'linked' end, null,
  '{"call_turn":' || case when n % 7 = 0 then 'null' else turn::varchar end || ',"content":{"chars":' || n || '},"tool_call_id":"' || case when n % 7 = 0 then 'x' || turn else call_id end || '"}'
from c where n % 5 <> 0
"""
