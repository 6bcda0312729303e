"""Chat formatting with tool-call linking, in DataFrame operations only.

A conversation's messages become lines of canonical JSON (keys sorted, no blanks, no null fields), one row each, so a
conversation however long never has to fit in a task. Tool use is read from message texts that are JSON objects:

* role assistant: {"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}, or calls of the shape
  {"id": ..., "type": "function", "function": {"name": ..., "arguments": "{...}"}}, with arguments as text or not
* role tool: {"tool_call_id": ..., "content": ...}

Each call and each result is a line of its own. Results are hash-joined to calls by conversation and identifier. The
order is topological: a line comes at its message's turn, a message before its calls, a result at its own turn but never
before its call, even if it was logged earlier; lines of one place come in order of kind and identifier. Calls are checked against the tools' schemas. Fields that aren't known
here are kept, under `extra`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.staging import discard, stage

#: Turns of one conversation that are numbered by one task.
TURNS_EACH = 1024
#: Lines from which on such a range is split by turn, part and a hash of the line.
CROWDED = 65_536
#: JSON schema type -> what Spark calls a variant of it.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def _get(of: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({of}, '$.{path}', '{kind}')"


def _but(fields: str, *known: str) -> str:
    """The fields of a map that aren't known, null if there are none."""
    rest = f"map_filter({fields}, (k, v) -> k NOT IN ({', '.join(repr(k) for k in known)}))"
    return f"CASE WHEN size({rest}) > 0 THEN {rest} END"


def _call(c: str) -> str:
    """One element of tool_calls, a variant, as a line's fields; of what is no object, all is in arguments."""
    fields, function = f"try_variant_get({c}, '$', 'map<string,variant>')", _get(c, "function", "map<string,variant>")
    given = f"coalesce({_get(c, 'arguments', 'variant')}, {_get(c, 'function.arguments', 'variant')}, CASE WHEN {fields} IS NULL THEN {c} END)"
    parsed = f"CASE WHEN schema_of_variant({given}) = 'STRING' THEN coalesce(try_parse_json(try_variant_get({given}, '$', 'string')), {given}) ELSE {given} END"
    inner = f"transform_keys(map_filter(coalesce({function}, cast(map() AS map<string,variant>)), (k, v) -> k NOT IN ('name', 'arguments')), (k, v) -> concat('function.', k))"
    outer = f"map_filter(coalesce({fields}, cast(map() AS map<string,variant>)), (k, v) -> k NOT IN ('id', 'name', 'arguments') AND (k <> 'function' OR {function} IS NULL))"
    both = f"map_concat({outer}, {inner})"
    return f"named_struct('part', i + 1, 'kind', 'call', 'call_id', {_get(c, 'id')}, 'name', coalesce({_get(c, 'name')}, {_get(c, 'function.name')}), 'arguments', {parsed}, 'content', cast(null AS string), 'answer', cast(null AS variant), 'extra', CASE WHEN size({both}) > 0 THEN {both} END)"


def lines(turns: DataFrame) -> DataFrame:
    """Messages, calls and results as rows: conv_id, turn, part, role, kind, call_id, name, arguments, content, answer, extra."""
    t = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("rec", F.expr("CASE WHEN startswith(text, '{') AND role IN ('assistant', 'tool') THEN try_parse_json(text) END"))
    t = t.withColumn("fields", F.expr("try_variant_get(rec, '$', 'map<string,variant>')"))
    t = t.withColumn("called", F.expr(f"CASE WHEN role = 'assistant' THEN {_get('rec', 'tool_calls', 'array<variant>')} END"))
    t = t.withColumn("gave", F.expr(f"CASE WHEN role = 'tool' THEN {_get('rec', 'tool_call_id')} END"))
    none = {k: f"cast(null AS {k})" for k in ("string", "variant", "map<string,variant>")}
    plain = f"named_struct('part', 0, 'kind', 'message', 'call_id', {none['string']}, 'name', {none['string']}, 'arguments', {none['variant']}, 'content', text, 'answer', {none['variant']}, 'extra', {none['map<string,variant>']})"
    # content that is no string is kept as a field that isn't known
    is_text = "coalesce(schema_of_variant(fields['content']) = 'STRING', false)"
    said = f"named_struct('part', 0, 'kind', 'message', 'call_id', {none['string']}, 'name', {none['string']}, 'arguments', {none['variant']}, 'content', CASE WHEN {is_text} THEN {_get('rec', 'content')} END, 'answer', {none['variant']}, 'extra', CASE WHEN {is_text} THEN {_but('fields', 'content', 'tool_calls')} ELSE {_but('fields', 'tool_calls')} END)"
    result = f"named_struct('part', 0, 'kind', 'result', 'call_id', gave, 'name', {none['string']}, 'arguments', {none['variant']}, 'content', {none['string']}, 'answer', fields['content'], 'extra', {_but('fields', 'tool_call_id', 'content')})"
    parts = F.expr(f"CASE WHEN gave IS NOT NULL THEN array({result}) WHEN called IS NOT NULL THEN concat(array({said}), transform(called, (c, i) -> {_call('c')})) ELSE array({plain}) END")
    return t.select("conv_id", "turn", "role", F.explode(parts).alias("p")).select("conv_id", "turn", "role", "p.*")


def _checked(calls: DataFrame, tools: DataFrame | None) -> DataFrame:
    """calls with problems: '' for a valid one. tools: name, parameter, type, required, a row for each parameter (null
    for a tool without any)."""
    if tools is None:
        return calls.withColumn("problem", F.lit(""))
    known = tools.groupBy("name").agg(F.map_from_entries(F.collect_list(F.when(F.col("parameter").isNotNull(), F.struct("parameter", F.struct(F.lower("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required")))))).alias("schema"))
    args = "try_variant_get(arguments, '$', 'map<string,variant>')"
    missing = "filter(map_keys(schema), k -> schema[k].required and not array_contains(map_keys(given), k))"
    unknown = "filter(map_keys(given), k -> not array_contains(map_keys(schema), k))"
    wrong = "filter(map_keys(given), k -> array_contains(map_keys(schema), k) and not regexp_like(schema_of_variant(given[k]), concat('^(', element_at(types, schema[k].type), ')$')))"
    types = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in TYPES.items()) + ")"
    out = calls.join(known.withColumnRenamed("name", "tool"), F.col("name") == F.col("tool"), "left").withColumn("given", F.expr(args)).withColumn("types", F.expr(types))
    problem = F.when(F.col("tool").isNull(), "unknown tool").when(F.col("given").isNull(), "arguments are no object")
    for word, expr in (("missing", missing), ("unknown", unknown), ("wrong type", wrong)):
        problem = problem.when(F.expr(f"size({expr}) > 0"), F.expr(f"concat('{word}: ', array_join(array_sort({expr}), ','))"))
    return out.withColumn("problem", problem.otherwise("")).drop("tool", "schema", "given", "types")


def format_chat(turns: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, seq, role, kind, call_id, linked, problem, json.

    seq numbers a conversation's lines from 0 in topological order. linked (calls and results; null for messages): a
    call has a result, a result has a call; of several calls of an id the first counts, of several results the first is
    linked. problem is '' or says why a call's arguments don't fit, or 'no call', 'repeated' for results and 'repeated
    id' for calls. Text that is no such JSON is content, of any length. Null conversations are one, null turns come first, null roles
    and texts leave their field out; repeated rows are kept; an empty table gives none.
    """
    rows = stage(lines(turns), "chat-lines")  # read by five branches, so that none parses the texts again
    place = F.struct(F.col("turn"), F.col("part"))
    first_call = rows.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(place).alias("c"))
    first_result = rows.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min(place).alias("r"))
    links = first_call.join(first_result.withColumnsRenamed({"conv_id": "v", "call_id": "i"}), F.expr("conv_id <=> v AND call_id = i"), "full")
    links = links.select(F.coalesce("conv_id", "v").alias("l_conv"), F.coalesce("call_id", "i").alias("l_id"), "c", "r")
    messages = rows.where("kind = 'message'").withColumns({"problem": F.lit(""), "linked": F.lit(None).cast("boolean"), "c": F.lit(None).cast("struct<turn:long,part:int>")})
    same = F.expr("conv_id <=> l_conv AND call_id = l_id")
    calls = _checked(rows.where("kind = 'call'"), tools).join(links, same, "left")
    calls = calls.withColumn("linked", F.expr("c <=> struct(turn, part) AND r IS NOT NULL")).withColumn("problem", F.expr("CASE WHEN call_id IS NOT NULL AND NOT (c <=> struct(turn, part)) THEN 'repeated id' ELSE problem END")).withColumn("c", F.lit(None).cast("struct<turn:long,part:int>"))
    results = rows.where("kind = 'result'").join(links, same, "left").withColumn("linked", F.expr("c IS NOT NULL AND r <=> struct(turn, part)"))
    results = results.withColumn("problem", F.expr("CASE WHEN c IS NULL THEN 'no call' WHEN NOT linked THEN 'repeated' ELSE '' END"))
    columns = ["conv_id", "turn", "part", "role", "kind", "call_id", "name", "arguments", "content", "answer", "extra", "problem", "linked", "c"]
    all_ = messages.select(columns).union(calls.select(columns)).union(results.select(columns))
    late = F.expr("c IS NOT NULL AND coalesce(turn IS NULL AND c.turn IS NOT NULL OR c.turn > turn OR (c.turn <=> turn AND c.part > part), false)")
    all_ = all_.withColumn("o_turn", F.when(late, F.col("c.turn")).otherwise(F.col("turn"))).withColumn("o_part", F.when(late, F.col("c.part")).otherwise(F.col("part"))).withColumn("o_after", late.cast("int"))
    # each field by the order of its name; to_json leaves null fields out, and variants have sorted keys
    body = F.struct(F.col("arguments"), F.col("call_id"), F.col("content"), F.col("extra"), F.col("kind"), F.col("name"), F.col("answer").alias("result"), F.col("role"), F.col("turn"))
    done = all_.select("conv_id", "turn", "role", "kind", "call_id", "linked", "problem", "o_turn", "o_part", "o_after", F.to_json(body).alias("json"))
    done = stage(done, "chat-linked")  # counted twice and numbered
    discard(rows)
    return _numbered(done).select("conv_id", "turn", "seq", "role", "kind", "call_id", "linked", "problem", "json")


def _numbered(rows: DataFrame) -> DataFrame:
    """seq: ranges of turns are numbered each by itself and moved by the lines of the ranges before them. A crowded range
    (a turn with very many lines, or lines without a turn) is split once more, by turn, by ranges of calls, and for lines
    of one place by kind, identifier and a hash, which also order them."""
    rows = rows.withColumn("range", F.expr(f"o_turn div {TURNS_EACH}")).withColumn("bucket", F.shiftrightunsigned(F.xxhash64("json"), 52).cast("int"))
    counts = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("conv_id").alias("b_conv"), F.col("range").alias("b_range"), first.alias("before"), (F.col("n") > CROWDED).alias("crowded"))
    rows = rows.join(counts, F.expr("conv_id <=> b_conv AND range <=> b_range")).drop("b_conv", "b_range")
    of_part = [F.when(F.col("o_part") == 0, F.col(c)).alias(c) for c in ("kind", "call_id", "bucket")]
    sub = F.struct("o_turn", F.expr(f"o_part div {TURNS_EACH}").alias("p"), (F.col("o_part") > 0).alias("call"), *of_part)
    rows = rows.withColumn("sub", F.when(F.col("crowded"), sub))
    inner = rows.where("crowded").groupBy("conv_id", "range", "sub").agg(F.count("*").alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "range").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = inner.select(F.col("conv_id").alias("b_conv"), F.col("range").alias("b_range"), F.col("sub").alias("b_sub"), upto.alias("inside"))
    rows = rows.join(inner, F.expr("conv_id <=> b_conv AND range <=> b_range AND sub <=> b_sub"), "left")
    own = F.row_number().over(Window.partitionBy("conv_id", "range", "sub").orderBy("o_turn", "o_part", "o_after", "turn", "kind", "call_id", "bucket", "json")) - 1
    return rows.withColumn("seq", (own + F.col("before") + F.coalesce("inside", F.lit(0))).cast("long"))
