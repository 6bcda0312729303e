"""Event dumps as JSON lines: {"seq": n, "tag": "...", "args": [...]}, closed by a record `_END` or not.

Files are split and parsed in Spark. Arguments are read as variants, so `12` and `"12"` stay apart, and taken into typed
columns fail-closed: FAILFAST raises on the first bad record, SKIP leaves bad records out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas

#: What a variant of a kind may be.
_KINDS = {"u": "^(BIGINT)$", "i": "^(BIGINT)$", "n": "^(BIGINT|DOUBLE|DECIMAL.*)$", "s": "^(STRING)$"}
_CASTS = {"u": "bigint", "i": "bigint", "n": "double", "s": "string"}


def _arg(i: int) -> str:
    return f"try_variant_get(rec, '$.args[{i}]', 'variant')"


def _ok(tag: str) -> str:
    """Whether a record's arguments are those of its tag. More of them than needed are ignored."""
    checks = []
    for i, (_, kind) in enumerate(schemas.TAGS[tag]):
        checks.append(f"coalesce(regexp_like(schema_of_variant({_arg(i)}), '{_KINDS[kind]}'), false)")
        if kind == "u":
            checks.append(f"coalesce(try_variant_get(rec, '$.args[{i}]', 'bigint') >= 0, false)")
    return " AND ".join(checks) or "true"


def _value(column: str) -> Column:
    cases = [f"WHEN '{tag}' THEN try_variant_get(rec, '$.args[{i}]', '{_CASTS[k]}')" for tag, args in schemas.TAGS.items() for i, (c, k) in enumerate(args) if c == column]
    return F.expr(f"CASE raw_tag {' '.join(cases)} END")


def read(spark: SparkSession, path: str, *, mode: str = "FAILFAST", profile: Column | None = None) -> DataFrame:
    """Event relation of the dumps at path. profile_id is the file's path unless given.

    A byte order mark and blank lines are dropped, as are the closing record and what isn't an event of it. Null numbers
    stand for non-finite ones and are no valid argument. SKIP also takes a NEW_FID's name from its last argument.
    """
    if mode not in ("FAILFAST", "SKIP"):
        raise ValueError(f"mode {mode}: FAILFAST or SKIP")
    text = spark.read.text(path).select((F.col("_metadata.file_path") if profile is None else profile).alias("profile_id"), F.regexp_replace("value", "^﻿", "").alias("raw"))
    return parse(text, mode=mode)


def parse(text: DataFrame, *, mode: str = "FAILFAST") -> DataFrame:
    """The same from rows (profile_id, raw); also for streams."""
    rows = text.where(F.trim("raw") != "").select("profile_id", "raw", F.expr("try_parse_json(raw)").alias("rec"))
    rows = rows.select("*", F.expr("try_variant_get(rec, '$.tag', 'string')").alias("raw_tag"), F.expr("try_variant_get(rec, '$.seq', 'bigint')").alias("seq"))
    rows = rows.where(~F.col("raw_tag").eqNullSafe(schemas.END))
    known = F.expr("CASE raw_tag " + " ".join(f"WHEN '{t}' THEN {_ok(t)}" for t in schemas.TAGS) + " ELSE false END") & (F.coalesce(F.col("seq"), F.lit(-1)) >= 0)
    known = F.coalesce(known, F.lit(False))
    if mode == "SKIP":
        rows = rows.where(known).withColumn("tag", F.col("raw_tag"))
    else:
        # within the tag itself: a filter beside it might be run after others, on what they have made of the tag
        bad = F.raise_error(F.concat(F.lit("bad event record: "), F.substring("raw", 1, 200))).cast("string")
        rows = rows.withColumn("tag", F.when(known, F.col("raw_tag")).otherwise(bad))
    values = {c: _value(c) for c in schemas.COLUMNS}
    if mode == "SKIP":
        values["name"] = F.when(F.col("raw_tag") == "NEW_FID", F.expr("try_variant_get(element_at(try_variant_get(rec, '$.args', 'array<variant>'), -1), '$', 'string')")).otherwise(values["name"])
    return rows.select("profile_id", "seq", "tag", *[v.alias(c) for c, v in values.items()])


def write(events: DataFrame, path: str) -> None:
    """A dump of each profile, in the order of seq and closed by `_END`; folders profile_id=... below path."""
    lines(events).repartition("profile_id").sortWithinPartitions("profile_id", "seq").select("profile_id", "value").write.partitionBy("profile_id").text(path)


def lines(events: DataFrame) -> DataFrame:
    """profile_id, seq, value: a dump's lines, the closing record after the last."""
    cases = []
    for tag, args in schemas.TAGS.items():
        parts = []
        for c, k in args:
            if k == "s":  # the string between the braces of a one-field object
                parts.append(f"coalesce(substring(to_json(named_struct('v', {c})), 6, length(to_json(named_struct('v', {c}))) - 6), 'null')")
            elif k == "n":
                parts.append(f"coalesce(CASE WHEN isnan({c}) OR abs({c}) = double('infinity') THEN 'null' WHEN {c} = floor({c}) AND abs({c}) < 9e15 THEN cast(cast({c} as bigint) as string) ELSE cast({c} as string) END, 'null')")
            else:
                parts.append(f"coalesce(cast({c} as string), 'null')")
        args_sql = "concat_ws(',', " + ", ".join(parts) + ")" if parts else "''"
        cases.append(f"WHEN '{tag}' THEN {args_sql}")
    args = F.expr(f"CASE tag {' '.join(cases)} END")
    body = events.select("profile_id", "seq", F.concat(F.lit('{"args":['), args, F.lit('],"seq":'), F.col("seq").cast("string"), F.lit(',"tag":"'), F.col("tag"), F.lit('"}')).alias("value"))
    ends = events.groupBy("profile_id").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
    return body.unionByName(ends.withColumn("value", F.concat(F.lit('{"args":[],"seq":'), F.col("seq").cast("string"), F.lit(f',"tag":"{schemas.END}"}}'))))


def for_each(source: Iterable[str], handlers: dict[str, Callable], *, on_error: str = "raise") -> int:
    """Call handlers[tag](args, seq) for each record of a dump on the driver, or handlers["*"](tag, args, seq) where the
    tag has none; the number of records. source is any lines: an open file, a process's output, or lines() of a profile
    by toLocalIterator. A record at a time is held; the closing record is given out like others. Records of tags without
    a handler count too. on_error "skip" passes over lines that aren't records.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error {on_error}: raise or skip")
    count, rest = 0, handlers.get("*")
    for line in source:
        line = line.lstrip("\ufeff").strip()
        if not line:
            continue
        try:
            record = json.loads(line)
            tag, args, seq = record["tag"], record.get("args") or [], record.get("seq")
            if not isinstance(tag, str) or not isinstance(args, list):
                raise TypeError("tag or args")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            if on_error == "raise":
                raise ValueError(f"bad event record: {line[:200]}") from e
            continue
        count += 1
        if tag in handlers and tag != "*":
            handlers[tag](args, seq)
        elif rest:
            rest(tag, args, seq)
    return count
