"""Profile tools: completeness, verify, compare, normalize, merge, salvage labels, conversion checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom import schemas
from tickloom.operators import aggregates as agg
from tickloom.operators import sequence
from tickloom.operators.aggregates import P
from tickloom.staging import stage
from tickloom.views import Profile

#: The reasons for which a profile is incomplete.
MISSING_END, NO_TIMING = "missing PID_END after PID_START", "no statement timing events (TIME_LINE/TIME_BLOCK)"


class IncompleteProfile(ValueError):
    """A report was asked for of a profile that isn't whole."""


def _judged(c: DataFrame) -> DataFrame:
    few = F.when((F.col("pid_start_events") > 0) & (F.col("pid_end_events") < F.col("pid_start_events")), F.lit(MISSING_END))
    none = F.when((F.col("time_line_events") == 0) & (F.col("time_block_events") == 0), F.lit(NO_TIMING))
    return c.withColumn("reasons", F.array_join(F.array_compact(F.array(few, none)), ",")).withColumn("complete", F.col("reasons") == "")


def completeness(p: Profile) -> DataFrame:
    """profile_id, reasons (joined by commas, empty when complete), complete."""
    return _judged(agg.counters(p)).select(P, "reasons", "complete")


def require_complete(p: Profile, allow_incomplete: bool = False) -> None:
    """Raise for the first incomplete profile, unless that is allowed. Dumps never ask."""
    if not allow_incomplete:
        bad = completeness(p).where("NOT complete").first()
        if bad:
            raise IncompleteProfile(f"{bad[P]}: {bad.reasons}")


def verify(p: Profile) -> DataFrame:
    """counters with reasons and complete: what a verification prints."""
    return _judged(agg.counters(p))


def lifecycle(p: Profile) -> DataFrame:
    """profile_id: processes, started, ended, open (started and not ended)."""
    s = agg.process_spans(p)
    return s.groupBy(P).agg(F.count("*").alias("processes"), F.sum("starts").alias("started"), F.sum("ends").alias("ended"), F.sum(F.when(F.col("starts") > F.col("ends"), 1).otherwise(0)).alias("open"))


def _compared(p: Profile, counts_total: bool) -> dict[str, tuple[DataFrame, list[str], list[str], list[str]]]:
    """aggregate -> (rows, keys, values that must be equal, values that must be close)."""
    tags = None if counts_total else ["TIME_LINE", "TIME_BLOCK", "DISCOUNT"]
    return {
        "counts": (agg.tag_counts(p, tags), ["tag"], ["events"], []),
        "lines": (agg.line_totals(p), ["fid", "line"], ["calls", "ticks"], []),
        "blocks": (agg.block_totals(p), ["fid", "block_line"], ["calls", "ticks"], []),
        "subs": (agg.sub_totals(p["SUB_RETURN"]), ["name"], ["returns"], ["incl", "excl"]),
        "edges": (agg.call_edges(p["SUB_CALLERS"]), ["caller", "called"], ["calls", "max_rec_depth"], ["incl", "excl", "reci"]),
        "source": (agg.source_lines(p), ["fid", "line"], ["text"], []),
        "definitions": (agg.sub_defs(p), ["name"], ["fid", "first_line", "last_line"], []),
        "files": (agg.files(p), ["fid"], ["name"], []),
        "attributes": (agg.attributes(p), ["key"], ["value"], []),
        "options": (agg.options(p), ["key"], ["value"], []),
    }


def compare(a: Profile, b: Profile, *, counts_total: bool = True) -> DataFrame:
    """aggregate, key, left, right: where two profiles differ; empty for equal ones. Counts, ticks and texts must be
    equal, times close. Call sites aren't compared. profile_id is left aside: compare one profile with one.

    All aggregates of both sides go into one relation of (aggregate, key, values), which one more aggregate by key sets
    side by side: a join for each of the ten isn't needed.
    """
    rows = []
    for side, p in (("a", a), ("b", b)):
        for name, (df, keys, exact, near) in _compared(p, counts_total).items():
            texts = F.array(*[F.col(c).cast("string") for c in exact])
            numbers = F.array(*[F.col(c).cast("double") for c in near]).cast("array<double>")
            key = F.array(*[F.col(k).cast("string") for k in keys])
            rows.append(df.select(F.lit(name).alias("aggregate"), key.alias("keys"), F.lit(side).alias("side"), F.struct(texts.alias("exact"), numbers.alias("near")).alias("v")))
    both = reduce(DataFrame.unionAll, rows).groupBy("aggregate", "keys").agg(*[F.max(F.when(F.col("side") == s, F.col("v"))).alias(s) for s in "ab"])
    far = F.exists(F.zip_with("a.near", "b.near", lambda x, y: ~(F.coalesce(fn.close(x, y), F.lit(False)) | (x.isNull() & y.isNull()))), lambda bad: bad)
    differ = F.col("a").isNull() | F.col("b").isNull() | (F.col("a.exact") != F.col("b.exact")) | far
    text = lambda s: F.array_join(F.concat(f"{s}.exact", F.transform(f"{s}.near", fn.format_ticks)), "|", "?")
    return both.where(differ).select("aggregate", F.array_join("keys", "|").alias("key"), text("a").alias("left"), text("b").alias("right"))


def compare_dumps(a: DataFrame, b: DataFrame) -> DataFrame:
    """pos, left, right: records that differ in tag or arguments at the same place of two event relations; seq itself is
    left aside."""
    cols = ["tag", *schemas.COLUMNS]
    text = F.to_json(F.struct(*cols)).alias("rec")
    at = lambda e, n: sequence.renumbered(e, ["seq"], seq="pos").select(P, "pos", text.alias(n)) if "pos" in e.columns else e.withColumn("pos", F.row_number().over(Window.partitionBy(P).orderBy("seq")) - 1).select("pos", text.alias(n))
    return at(a, "left").join(at(b, "right"), "pos", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def normalized(events: DataFrame) -> DataFrame:
    """Events whose volatile fields are replaced: comments and base times by marks, paths by base names."""
    short = lambda c: F.when(fn.is_path_like(c), fn.stripped_basename(c)).otherwise(F.col(c))
    app = F.when(F.coalesce("value", F.lit("")) == "", F.lit("<APP>")).otherwise(short("value"))
    tag = F.col("tag")
    value = F.when((tag == "ATTRIBUTE") & (F.col("key") == "basetime"), F.lit("<BASETIME>")).when((tag == "ATTRIBUTE") & (F.col("key") == "application"), F.when(app == "", F.lit("<APP>")).otherwise(app)).otherwise(F.col("value"))
    return events.withColumn("text", F.when(tag == "COMMENT", F.lit("<COMMENT>")).otherwise(F.col("text"))).withColumn("value", value).withColumn("name", F.when(tag == "NEW_FID", short("name")).otherwise(F.col("name")))


def normalized_args(events: DataFrame) -> DataFrame:
    """profile_id, seq, tag, args: normalized events with their arguments as text in one stable form: strings as they
    are, integers, and floats as normalized_number() writes them. Dumps that say the same compare equal as text."""
    kinds = {"s": lambda c: F.col(c), "u": lambda c: F.col(c).cast("string"), "i": lambda c: F.col(c).cast("string"), "n": fn.normalized_number}
    args = F.lit(None).cast("array<string>")
    for t, columns in schemas.TAGS.items():
        args = F.when(F.col("tag") == t, F.array(*[kinds[k](c) for c, k in columns]).cast("array<string>")).otherwise(args)
    return normalized(events).select(P, "seq", "tag", args.alias("args"))


_FIDS = ["NEW_FID", "TIME_LINE", "TIME_BLOCK", "SUB_ENTRY", "SUB_INFO", "SUB_CALLERS", "SRC_LINE"]


def _prepared(inputs: list[DataFrame]) -> DataFrame:
    """All inputs with their place; from the second on without VERSION and START_DEFLATE, and with a comment first."""
    out = None
    for i, e in enumerate(inputs):
        e = e.withColumn("input", F.lit(i))
        if i:
            e = e.where(~F.col("tag").isin("VERSION", "START_DEFLATE"))
            note = e.sparkSession.range(1).select(F.lit(None).cast("string").alias(P), F.lit(-1).cast("long").alias("seq"), F.lit("COMMENT").alias("tag"), F.lit(f"# merged input {i + 1}\n").alias("text"), F.lit(i).alias("input"))
            e = e.unionByName(note, allowMissingColumns=True)
        out = e if out is None else out.unionByName(e)
    return out


def _in_line(rows: DataFrame) -> DataFrame:
    """rows numbered by input and seq. Ranges of seq are numbered each by itself, so that a merged profile, however long,
    is never one task; rows of one input and seq come in order of tag and arguments."""
    return sequence.numbered(rows, ["input"], "seq", ["tag", *schemas.COLUMNS])


def _as_one(rows: DataFrame, profile_id: str) -> DataFrame:
    return rows.withColumn(P, F.lit(profile_id)).select([f.name for f in schemas.EVENTS.fields])


def _offsets(inputs: list[DataFrame]) -> DataFrame:
    """t_input, offset: the sum of the highest file ids that the inputs before declare. A row for each input."""
    tops = [e.where("tag = 'NEW_FID'").agg(F.lit(i).alias("t_input"), F.coalesce(F.max("fid"), F.lit(0)).alias("top")) for i, e in enumerate(inputs)]
    before = Window.orderBy("t_input").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as inputs
    return reduce(DataFrame.unionAll, tops).select("t_input", F.coalesce(F.sum("top").over(before), F.lit(0)).alias("offset"))


def merge_concat(inputs: list[DataFrame], profile_id: str = "merged") -> DataFrame:
    """Streams one after the other. File ids of an input move up by the highest that the inputs before it declare."""
    # an input's highest id is its own plus its offset, and so is at least all before it
    rows = _in_line(_prepared(inputs)).join(F.broadcast(_offsets(inputs)), F.col("input") == F.col("t_input"))  # a row for each input
    fid = F.when(F.col("tag").isin(_FIDS), F.col("fid") + F.col("offset")).otherwise(F.col("fid"))
    eval_fid = F.when((F.col("tag") == "NEW_FID") & (F.col("eval_fid") != 0), F.col("eval_fid") + F.col("offset")).otherwise(F.col("eval_fid"))
    return _as_one(rows.withColumn("fid", fid).withColumn("eval_fid", eval_fid), profile_id)


def file_map(inputs: list[DataFrame]) -> DataFrame:
    """input, fid, new_fid, name, declared: the first input keeps its ids; later names get the id that they have already,
    or the next free one. declared is the seq of the declaration that a merge keeps, null where another input has it.

    A row for each file of an input, staged: the events are read for it once.
    """
    named = [e.where("tag = 'NEW_FID'").groupBy("fid").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq")).select(F.lit(i).alias("input"), "fid", "name", "seq") for i, e in enumerate(inputs)]
    named = stage(reduce(DataFrame.unionAll, named), "files")
    first = named.where("input = 0").groupBy("name").agg(F.min("fid").alias("kept"))
    fresh = named.where("input > 0").join(first, "name", "left_anti").groupBy("name").agg(F.min(F.struct("input", "seq", "fid")).alias("at"))
    top = named.where("input = 0").agg(F.max("fid")).first()[0] or 0
    fresh = fresh.select("name", (F.lit(top) + F.row_number().over(Window.orderBy("at"))).alias("made"))  # of new file names only
    out = named.join(first, "name", "left").join(fresh, "name", "left")
    out = out.select("input", "fid", F.when(F.col("input") == 0, F.col("fid")).otherwise(F.coalesce("kept", "made")).alias("new_fid"), "name", "seq")
    keep = out.groupBy(F.col("new_fid").alias("k_fid")).agg(F.min(F.struct("input", "seq")).alias("k"))
    out = out.join(keep, F.col("new_fid") == F.col("k_fid"))
    return stage(out.select("input", "fid", "new_fid", "name", F.when(F.expr("k = struct(input, seq)"), F.col("seq")).alias("declared")), "file-map")


def merge_by_name(inputs: list[DataFrame], profile_id: str = "merged") -> DataFrame:
    """Streams one after the other with files of one name made one. Ids that nothing declares stay as they are; of the
    declarations of a file, the first of all inputs is kept."""
    found = file_map(inputs)
    m = found.select(F.col("input").alias("m_input"), F.col("fid").alias("m_fid"), "new_fid", "declared")
    e = found.select(F.col("input").alias("e_input"), F.col("fid").alias("e_fid"), F.col("new_fid").alias("new_eval"))
    rows = _prepared(inputs).join(m, (F.col("input") == F.col("m_input")) & (F.col("fid") == F.col("m_fid")), "left")
    rows = _in_line(rows.where("tag <> 'NEW_FID' OR seq <=> declared")).withColumn("of_eval", F.when(F.col("eval_fid") != 0, F.col("eval_fid")))
    rows = rows.join(e, (F.col("input") == F.col("e_input")) & (F.col("of_eval") == F.col("e_fid")), "left")
    return _as_one(rows.withColumn("fid", F.coalesce("new_fid", "fid")).withColumn("eval_fid", F.coalesce("new_eval", "eval_fid")), profile_id)


def salvage_labels(events: DataFrame, *, wire: str, consumed: int, size: int, prefix: str = "profile") -> DataFrame:
    """events of one profile with seven attributes and a comment after VERSION that say what was recovered."""
    reasons = completeness(Profile.of(events)).first()
    # fixed values: the names of the attributes, and the comment's words below
    values = {"salvage": "1", "salvage.incomplete": "1", "salvage.wire": wire, "salvage.bytes_consumed": str(consumed), "salvage.input_len": str(size), "salvage.discarded_tail": str(max(0, size - consumed)), "salvage.stream_incomplete": (reasons.reasons if reasons else "") or "none"}
    rows = [("ATTRIBUTE", f"{prefix}.{k}", v, None, i) for i, (k, v) in enumerate(values.items())]
    rows.append(("COMMENT", None, None, f"# {prefix} salvage: recovered complete verified prefix only; incomplete=1; discarded_tail={max(0, size - consumed)}\n", len(values)))
    marks = events.sparkSession.createDataFrame(rows, "tag string, key string, value string, text string, k int").withColumn("place", F.lit(1))
    old = events.withColumn("place", F.when((F.col("tag") == "VERSION") & (F.col("seq") == F.min("seq").over(Window.partitionBy(P))), 0).otherwise(2)).withColumn("k", F.lit(0))
    one = events.select(P).first()
    marks = marks.withColumn(P, F.lit(one[0] if one else ""))
    both = old.unionByName(marks, allowMissingColumns=True)
    return sequence.renumbered(both, ["place", "seq", "k"]).select([f.name for f in schemas.EVENTS.fields])


def conversion_problems(events: DataFrame, *, lossy: bool = False) -> DataFrame:
    """profile_id, seq, tag, problem: what the newer wire format can't hold. lossy cuts fractions and drops the extra
    fields, and so only minds the rest."""
    inf = float("inf")
    times = [c for c in ("time", "incl", "excl", "reci") if c in events.columns]
    problem = F.when(~F.col("tag").isin(list(schemas.TAGS)), F.lit("unknown tag"))
    for c in times:
        v = F.col(c)
        problem = problem.when(F.isnan(v) | (F.abs(v) == inf), F.lit(f"{c} not finite")).when(v < 0, F.lit(f"{c} negative"))
        if not lossy:
            problem = problem.when(v != F.floor(v), F.lit(f"{c} fractional"))
    problem = problem.when(F.col("tag").isin("TIME_LINE", "TIME_BLOCK") & (F.col("ticks") < 0), F.lit("ticks negative"))
    if not lossy:
        problem = problem.when((F.col("tag") == "TIME_BLOCK") & (F.col("sub_line") != 0), F.lit("sub_line"))
        for c in ("eval_fid", "eval_line", "flags", "size", "mtime"):
            problem = problem.when((F.col("tag") == "NEW_FID") & (F.col(c) != 0), F.lit(c))
    return events.select(P, "seq", "tag", problem.alias("problem")).where("problem IS NOT NULL")


def lossy(events: DataFrame) -> DataFrame:
    """events cut to what the newer wire format holds."""
    cut = {c: F.when(F.abs(F.col(c)) < 9e15, F.col(c).cast("long").cast("double")).otherwise(F.col(c)) for c in ("time", "incl", "excl", "reci")}
    zero = {c: F.when(F.col(c).isNotNull(), F.lit(0).cast("long")) for c in ("sub_line", "eval_fid", "eval_line", "flags", "size", "mtime")}
    return events.withColumns(cut | zero)


def kinds(events: DataFrame, expected: DataFrame) -> DataFrame:
    """tag, expected, observed: where the tags of a profile aren't those expected (tag, present)."""
    seen = events.groupBy("tag").agg(F.count("*").alias("observed"))
    return expected.join(seen, "tag", "full").select("tag", "present", F.coalesce("observed", F.lit(0)).alias("observed")).where("coalesce(present, false) <> (observed > 0)")
