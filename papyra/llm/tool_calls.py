"""Chat formatting with linked tool calls; DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import checkpoint, read, skew_safe_join

#: Tools and the JSON schemas of their arguments, as the query's production setting.
SCHEMAS = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculator": {"required": ["expression"], "properties": {"expression": {"type": "string"}}},
    "lookup": {"required": ["id"], "properties": {"id": {"type": "integer"}, "fields": {"type": "array"}}},
}
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*"}
#: Keywords of schemas that say nothing about what is valid.
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
_MESSAGE = "content string, tool_call_id string, tool_calls array<struct<id: string, name: string, arguments: string>>"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _check(name: str, schema: Mapping) -> None:
    """ValueError for what isn't compiled, which would pass unseen otherwise."""
    if (other := set(schema) - {"type", "required", "properties"} - _NOTES) or schema.get("type", "object") != "object":
        raise ValueError(f"schema of {name}: {sorted(other) or 'a type other than object'} can't be checked")
    for key, rule in schema.get("properties", {}).items():
        if not isinstance(rule, Mapping) or (other := set(rule) - {"type", "enum"} - _NOTES):
            raise ValueError(f"schema of {name}, property {key}: {sorted(other) if isinstance(rule, Mapping) else rule} can't be checked")
        if "type" in rule and (not isinstance(rule["type"], str) or rule["type"] not in _TYPES):
            raise ValueError(f"schema of {name}, property {key}: type {rule['type']} can't be checked")
        if "enum" in rule and not rule["enum"]:
            raise ValueError(f"schema of {name}, property {key}: an empty enum can't be checked")


def faults_of(schemas: Mapping[str, dict], call: str = "c") -> str:
    """SQL for the number of faults of a call: an unknown tool, arguments that aren't an object, and each missing
    required, mistyped or not allowed property. However many schemas there are, they are one constant of the plan: type,
    required and enum of properties; any other keyword that restricts values raises ValueError."""
    tools = []
    for name, schema in sorted(schemas.items()):
        _check(name, schema)
        required = ", ".join(_quote(k) for k in sorted(set(schema.get("required", ()))))
        rules = []
        for key, rule in sorted(schema.get("properties", {}).items()):
            kind = _quote(f"^({_TYPES[rule['type']]})$") if rule.get("type") else "cast(null as string)"
            enum = f"array({', '.join(_quote(json.dumps(x, ensure_ascii=False)) for x in rule['enum'])})" if rule.get("enum") else "cast(null as array<string>)"
            rules.append(f"named_struct('key', {_quote(key)}, 'kind', {kind}, 'allowed', {enum})")
        tools.append(f"{_quote(name)}, named_struct('required', cast(array({required}) as array<string>), 'rules', cast(array({', '.join(rules)}) as array<struct<key: string, kind: string, allowed: array<string>>>))")
    if not tools:
        return "1"
    tool = f"element_at(map({', '.join(tools)}), {call}.name)"
    given = f"try_cast(try_parse_json({call}.arguments) as map<string, variant>)"
    wrong = f"transform({tool}.rules, r -> if({given}[r.key] is null, 0, int(r.kind is not null and not schema_of_variant({given}[r.key]) rlike r.kind) + int(r.allowed is not null and not coalesce(array_contains(r.allowed, to_json({given}[r.key])), false))))"
    return f"coalesce(if({given} is null, 1, 0) + size(filter({tool}.required, k -> {given}[k] is null)) + aggregate({wrong}, 0, (a, x) -> a + x), 1)"


def latest_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """_conv, _result, _turn, _at of results: the turn of the latest call with that identifier up to theirs, else of the first one after.

    calls and results are distinct (_conv, _result, _turn). They are dealt by ranges of these three, so that a long
    conversation, or an identifier that one uses all the time, is spread over tasks; what a range needs from those before
    and after it is one row for each range.
    """
    both = calls.withColumn("_kind", F.lit(0)).unionByName(results.withColumn("_kind", F.lit(1)))
    dealt = checkpoint(both.repartitionByRange("_conv", "_result", "_turn", "_kind").withColumn("_part", F.spark_partition_id()))
    call = F.when(F.col("_kind") == 0, F.struct("_conv", "_result", "_turn"))
    # One row for each range: the last call of those before it, the first of those after.
    edges = dealt.groupBy("_part").agg(F.max(call).alias("_last"), F.min(call).alias("_first"))
    # Frames grow from a start, upwards or downwards: those that shrink towards an end are computed anew for each row.
    up, down = W.orderBy("_part"), W.orderBy(F.desc("_part"))
    edges = edges.select("_part", F.max("_last").over(up.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(down.rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    keys = [F.col(c) for c in ("_conv", "_result", "_turn", "_kind")]
    up, down = (W.partitionBy("_part").orderBy(*k).rowsBetween(W.unboundedPreceding, 0) for k in (keys, [k.desc() for k in keys]))
    found = dealt.join(F.broadcast(edges), "_part")
    found = found.withColumn("_up", F.coalesce(F.max(call).over(up), "_before")).withColumn("_down", F.coalesce(F.min(call).over(down), "_after"))
    own = lambda c: F.when((F.col(f"{c}._conv") == F.col("_conv")) & (F.col(f"{c}._result") == F.col("_result")), F.col(f"{c}._turn"))
    return found.where("_kind = 1").select("_conv", "_result", "_turn", F.coalesce(own("_up"), own("_down")).alias("_at")).where("_at is not null")


def link_tool_calls(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", schemas: Mapping[str, dict] = SCHEMAS) -> DataFrame:
    """One row per message: conversation, turn, role, place, level, link, n_calls, n_unanswered, n_invalid, message.

    A message whose text is a JSON object may hold tool_calls (id, name, arguments), or (role tool) a tool_call_id; any
    other text is content. Results are joined with calls by conversation and identifier; where a conversation uses one
    again, a result goes with the latest call up to its turn (the first one after, if there is none), and with that alone. link: 'call' (it makes calls), 'linked' or 'orphan' (a result with or without its call),
    else 'none'. (place, level, turn) is a topological order: a result never precedes its call: place is the later of
    the turn and its call's turn, level is 1 for linked results, else 0. n_invalid counts calls whose arguments don't
    fit the schema of their tool (or whose tool is unknown; schemas with keywords other than type, required, properties
    and enum raise ValueError); n_unanswered those without a result. message is canonical
    JSON: keys sorted, no spaces, no nulls; arguments too, if they are JSON, else a string.

    Null and empty texts are empty content; null conversations, turns and identifiers match nothing. Repeated messages
    stay and are linked alike. An empty table gives an empty result; other columns are ignored. A conversation is
    never gathered in one place, so its length doesn't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), text.alias("_text"))
    rows = rows.withColumn("_m", F.when(F.ltrim("_text").startswith("{"), F.from_json("_text", _MESSAGE)))
    tool = (F.col("_role") == "tool") & F.col("_m.tool_call_id").isNotNull()
    calls = F.when((F.size("_m.tool_calls") > 0) & ~F.coalesce(tool, F.lit(False)), F.col("_m.tool_calls"))
    rows = rows.select("_conv", "_turn", "_role", "_text", F.when(tool, F.col("_m.tool_call_id")).alias("_result"), F.when(tool | calls.isNotNull(), F.coalesce("_m.content", F.lit(""))).otherwise(F.col("_text")).alias("_content"), calls.alias("_calls"))
    plain = rows.where("_result is null and _calls is null")
    linked = checkpoint(rows.where("_result is not null or _calls is not null").withColumn("_key", F.struct(F.xxhash64("_conv", "_turn", "_role", "_text"), F.xxhash64(F.lit("k"), "_conv", "_turn", "_role", "_text"))))

    total = linked.count()
    # Identifiers that a conversation uses for calls of one turn join by hash; those used again go by turn.
    made = linked.where("_calls is not null").select("_key", "_conv", "_turn", F.explode("_calls.id").alias("_result")).distinct()
    turns = checkpoint(made.where("_conv is not null and _result is not null and _turn is not null").select("_conv", "_result", "_turn").distinct())
    results = linked.where("_result is not null").withColumn("_place", F.struct("_conv", "_result", "_turn"))
    asked = checkpoint(results.where("_conv is not null and _turn is not null").groupBy("_conv", "_result", "_turn").agg(F.count(F.lit(1)).alias("_rows")))
    once = turns.groupBy("_conv", "_result").agg(F.min("_turn").alias("_at"), F.count(F.lit(1)).alias("_n"))
    met = checkpoint(asked.join(once, ["_conv", "_result"]))
    again = met.where("_n > 1").select("_conv", "_result", "_turn")
    by_turn = latest_calls(turns.join(again.select("_conv", "_result").distinct(), ["_conv", "_result"], "left_semi"), again)
    links = met.where("_n = 1").select("_conv", "_result", "_turn", "_at").unionByName(by_turn).join(asked, ["_conv", "_result", "_turn"])
    links = checkpoint(links.select(F.struct("_conv", "_result", "_turn").alias("_place"), "_at", "_rows"))
    results = skew_safe_join(results, links.withColumn("_found", F.lit(True)), "_place", "_rows", total)
    answered = links.select("_place._conv", "_place._result", F.col("_at").alias("_turn")).distinct()
    callers = linked.where("_calls is not null")
    unanswered = made.join(answered, ["_conv", "_result", "_turn"], "left_anti").groupBy("_key").agg(F.count(F.lit(1)).alias("_open"))
    unanswered = checkpoint(unanswered.join(callers.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")), "_key"))
    callers = skew_safe_join(callers, unanswered, "_key", "_rows", total)
    canonical = "transform(_calls, c -> named_struct('arguments', coalesce(try_parse_json(c.arguments), cast(c.arguments as variant)), 'id', c.id, 'name', c.name))"

    def shape(part: DataFrame, link: Column, place: Column, level: Column, n: Column, unanswered: Column, invalid: Column, message: Column) -> DataFrame:
        return part.select(
            F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), F.col("_role").alias(role_col), place.alias("place"), level.cast("int").alias("level"),
            link.alias("link"), n.cast("long").alias("n_calls"), unanswered.cast("long").alias("n_unanswered"), invalid.cast("long").alias("n_invalid"), message.alias("message"),
        )

    zero = F.lit(0)
    found = F.coalesce("_found", F.lit(False))
    out = shape(plain, F.lit("none"), F.col("_turn"), zero, zero, zero, zero, F.to_json(F.struct(F.col("_content").alias("content"), F.col("_role").alias("role"))))
    out = out.unionByName(shape(
        results, F.when(found, "linked").otherwise("orphan"), F.greatest("_turn", "_at"), found.cast("int"), zero, zero, zero,
        F.to_json(F.struct(F.col("_content").alias("content"), F.col("_role").alias("role"), F.col("_result").alias("tool_call_id"))),
    ))
    return out.unionByName(shape(
        callers, F.lit("call"), F.col("_turn"), zero, F.size("_calls"), F.coalesce("_open", zero), F.expr(f"aggregate(transform(_calls, c -> int({faults_of(schemas)} > 0)), 0, (a, b) -> a + b)"),
        F.to_json(F.struct(F.col("_content").alias("content"), F.col("_role").alias("role"), F.expr(canonical).alias("tool_calls"))),
    ))


def with_calls(conversations: DataFrame) -> DataFrame:
    """The conversations with each assistant's turn as a tool call and each later user's turn as a result (role tool).

    Every row stays, with its whole text as content. Identifiers are used again after four turns, each fifth conversation's results
    name none that exists, each third one's arguments don't fit, and each fourth one's tool isn't known.
    """
    odd = "conv_id % 3 = 0"
    tool = "case conv_id % 4 when 0 then 'search' when 1 then 'calculator' when 2 then 'lookup' else 'browse' end"
    arguments = f"""case conv_id % 4
        when 0 then concat('{{"query":"', md5(text), '","limit":', if({odd}, '"many"', cast(turn as string)), '}}')
        when 1 then if({odd}, '{{}}', concat('{{"expression":"', turn, '+1"}}'))
        when 2 then concat('{{"id":', if({odd}, '"x"', cast(turn as string)), ',"fields":["a"]}}')
        else concat('{{"url":"', md5(text), '"}}') end"""
    call = f"to_json(named_struct('content', text, 'tool_calls', array(named_struct('id', concat('c', (turn div 2) % 2), 'name', {tool}, 'arguments', {arguments}))))"
    result = "to_json(named_struct('tool_call_id', if(conv_id % 5 = 0, 'none', concat('c', ((turn - 1) div 2) % 2)), 'content', text))"
    rows = conversations.withColumn("text", F.coalesce("text", F.lit("")))
    answer = F.expr("role = 'user' and turn > 0")
    return rows.select("conv_id", "turn", F.when(answer, "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", F.expr(call)).when(answer, F.expr(result)).otherwise(F.col("text")).alias("text"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table holds no calls; they are made from its turns (with_calls), one row for each."""
    return link_tool_calls(with_calls(read(spark, sf_dir, "conversations")))


SQL = """
with m as (
  select conv_id, turn, coalesce(text, '') as text, role = 'assistant' as is_call, role = 'user' and turn > 0 as is_result, case when role = 'user' and turn > 0 then 'tool' else role end as role,
    case when role = 'assistant' then 'c' || ((turn // 2) % 2) when role = 'user' and turn > 0 then case when conv_id % 5 = 0 then 'none' else 'c' || (((turn - 1) // 2) % 2) end end as id,
    case conv_id % 4 when 0 then 'search' when 1 then 'calculator' when 2 then 'lookup' else 'browse' end as tool, conv_id % 3 = 0 as odd
  from conversations),
made as (select distinct conv_id, id, turn from m where is_call),
asked as (select distinct conv_id, id, turn from m where is_result),
links as (select a.conv_id, a.id, a.turn, coalesce(max(case when c.turn <= a.turn then c.turn end), min(c.turn)) as at_turn from asked a join made c on a.conv_id = c.conv_id and a.id = c.id group by all),
answered as (select distinct conv_id, id, at_turn from links)
select m.conv_id, m.turn, m.role, case when l.at_turn is not null then greatest(m.turn, l.at_turn) else m.turn end as place, case when l.at_turn is not null then 1 else 0 end as level,
  case when is_call then 'call' when is_result then case when l.at_turn is not null then 'linked' else 'orphan' end else 'none' end as link, (is_call)::int::bigint as n_calls,
  (is_call and a.at_turn is null)::int::bigint as n_unanswered, (is_call and (odd or tool = 'browse'))::int::bigint as n_invalid,
  '{"content":' || to_json(text)::varchar || ',"role":' || to_json(m.role)::varchar ||
  case when is_call then ',"tool_calls":[{"arguments":' || case tool when 'search' then '{"limit":' || case when odd then '"many"' else m.turn::varchar end || ',"query":"' || md5(text) || '"}'
    when 'calculator' then case when odd then '{}' else '{"expression":"' || m.turn || '+1"}' end
    when 'lookup' then '{"fields":["a"],"id":' || case when odd then '"x"' else m.turn::varchar end || '}' else '{"url":"' || md5(text) || '"}' end || ',"id":"' || m.id || '","name":"' || tool || '"}]'
  when is_result then ',"tool_call_id":"' || m.id || '"' else '' end || '}' as message
from m left join links l on is_result and m.conv_id = l.conv_id and m.id = l.id and m.turn = l.turn
left join answered a on is_call and m.conv_id = a.conv_id and m.id = a.id and m.turn = a.at_turn
"""
