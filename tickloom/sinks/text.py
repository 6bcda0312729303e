"""Text, CSV and JSON reports, folded stacks, callgrind and DOT files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom.operators import aggregates as agg
from tickloom.operators import derived, graph, tools
from tickloom.operators.aggregates import P
from tickloom.views import Profile

SUBS_HEADER, EDGES_HEADER = "name,returns,incl,excl", "caller,called,count,incl,excl"


def _lines(df: DataFrame, *order) -> Iterator[str]:
    """The column `line` in order; fetched a partition at a time."""
    for r in df.orderBy(*order).select("line").toLocalIterator():
        yield r.line


def summary(p: Profile, label: str) -> str:
    """Counters, subs by name with their times, the ten lines that ran most often."""
    c = agg.counters(p).first()
    get = lambda k: c[k] if c else 0
    out = ["Profile summary report", f"profile: {label}", *[f"{k}: {get(k)}" for k in ("time_line_events", "time_block_events", "discount_events")], "", "Subroutines (from SUB_RETURN)"]
    subs = agg.sub_totals(p["SUB_RETURN"]).withColumn("line", F.concat(F.lit("  "), "name", F.lit("  returns="), F.col("returns").cast("string"), F.lit("  excl="), fn.format_ticks("excl"), F.lit("  incl="), fn.format_ticks("incl")))
    out += list(_lines(subs, "name")) or ["  (none)"]
    out += ["", "Top lines (by calls)", "  fid  line  calls  ticks  file"]
    out += [f"  {r.fid}  {r.line}  {r.calls}  {r.ticks}  {r.file}" for r in derived.top_lines(p).orderBy("rank").collect()]
    return "\n".join(out) + "\n"


def _csv(*columns: Column) -> Column:
    return F.concat_ws(",", *columns)


def subs_rows(p: Profile) -> DataFrame:
    return agg.sub_totals(p["SUB_RETURN"]).select(P, "name", _csv(fn.csv_field("name"), F.col("returns").cast("string"), fn.format_ticks("incl"), fn.format_ticks("excl")).alias("line"))


def edge_rows(p: Profile) -> DataFrame:
    return agg.call_edges(p["SUB_CALLERS"]).select(P, "caller", "called", _csv(fn.csv_field("caller"), fn.csv_field("called"), F.col("calls").cast("string"), fn.format_ticks("incl"), fn.format_ticks("excl")).alias("line"))


def subs_csv(p: Profile) -> str:
    return "\n".join([SUBS_HEADER, *_lines(subs_rows(p), "name")]) + "\n"


def edges_csv(p: Profile) -> str:
    return "\n".join([EDGES_HEADER, *_lines(edge_rows(p), "caller", "called")]) + "\n"


def csv_report(p: Profile) -> str:
    """Both, a blank line between them."""
    return subs_csv(p) + "\n" + edges_csv(p)


def write_csv(p: Profile, folder: str) -> None:
    """The same rows as files written by the executors, range-sorted: for profiles too large to print."""
    agg.sub_totals(p["SUB_RETURN"]).select("name", "returns", "incl", "excl").orderBy("name").write.option("header", True).option("escape", '"').csv(f"{folder}/subs")
    agg.call_edges(p["SUB_CALLERS"]).select("caller", "called", F.col("calls").alias("count"), "incl", "excl").orderBy("caller", "called").write.option("header", True).option("escape", '"').csv(f"{folder}/edges")


def folded(p: Profile) -> str:
    rows = list(_lines(graph.folded(agg.call_edges(p["SUB_CALLERS"])), "line"))
    return "".join(f"{x}\n" for x in rows)


def callgrind(p: Profile) -> str:
    out = ["# callgrind format", "positions: line", "events: Ticks"]
    for r in graph.callgrind(agg.call_edges(p["SUB_CALLERS"]), agg.sub_totals(p["SUB_RETURN"])).orderBy("name", "part", "called").toLocalIterator():
        out += ["", f"fn={r.name}", f"0 {r.cost}"] if r.part == 0 else [f"cfn={r.called}", f"calls={r.calls} 0", f"0 {r.cost}"]
    return "\n".join(out) + "\n"


def dot(p: Profile, packages: bool = False) -> str:
    g = graph.package_graph(p["SUB_CALLERS"]) if packages else graph.sub_graph(p["SUB_CALLERS"])
    return "\n".join(["digraph {", "graph [overlap=false]", *_lines(graph.dot_lines(g), "line"), "}"]) + "\n"


def _number(v: float):
    return int(v) if v == int(v) else v


def aggregates(p: Profile, label: str, *, leaf: str = "main::leaf", mid: str = "main::mid", line: tuple[int, int] = (1, 5), block: tuple[int, int] = (1, 4), fid: int = 1) -> dict:
    """One object of the counters, lookups at the places named, and all subs and edges (keyed caller TAB called)."""
    c = agg.counters(p).first()
    whole = tools.completeness(p).first()
    one = lambda df, col: (lambda r: r[col] if r else None)(df.first())
    subs = {r["name"]: {"returns": r.returns, "incl": _number(r.incl), "excl": _number(r.excl)} for r in agg.sub_totals(p["SUB_RETURN"]).toLocalIterator()}
    edges = {f"{r.caller}\t{r.called}": {"count": r.calls, "incl": _number(r.incl), "excl": _number(r.excl), "reci": _number(r.reci), "max_rec_depth": r.max_rec_depth} for r in agg.call_edges(p["SUB_CALLERS"]).toLocalIterator()}
    spot = lambda name: (lambda r: {"fid": r.fid, "first_line": r.first_line, "last_line": r.last_line} if r else None)(agg.sub_defs(p).where(F.col("name") == name).first())
    attrs = {r.key: r.value for r in agg.attributes(p).where(F.col("key").isin("ticks_per_sec", "basetime")).collect()}
    file = one(agg.files(p).where(F.col("fid") == fid), "name")
    names = ["discount", "sub_entry", "time_line", "time_block", "pid_start", "pid_end", "sub_return", "new_fid", "sub_callers", "src_line", "sub_info"]
    return {
        "ok": True, "profile": label, "leaf_returns": subs.get(leaf, {}).get("returns", 0), "mid_returns": subs.get(mid, {}).get("returns", 0), "mid_leaf_edge": edges.get(f"{mid}\t{leaf}", {}).get("count", 0),
        **{f"{n}_events": (c[f"{n}_events"] if c else 0) for n in names}, "total_events": c.dump_records if c else 0,
        "is_stream_complete": bool(whole and whole.complete), "incompleteness_reasons": [x for x in (whole.reasons if whole else tools.NO_TIMING).split(",") if x],
        f"line_calls_{line[0]}_{line[1]}": one(agg.line_totals(p).where((F.col("fid") == line[0]) & (F.col("line") == line[1])), "calls"), f"block_line_calls_{block[0]}_{block[1]}": one(agg.block_totals(p).where((F.col("fid") == block[0]) & (F.col("block_line") == block[1])), "calls"),
        "sub_def_leaf": spot(leaf), "sub_def_mid": spot(mid), f"source_line_{line[0]}_{line[1]}": one(agg.source_lines(p).where((F.col("fid") == line[0]) & (F.col("line") == line[1])), "text"),
        "attribute_ticks_per_sec": attrs.get("ticks_per_sec"), "attribute_basetime": attrs.get("basetime"), "option_calls": one(agg.options(p).where("key = 'calls'"), "value"),
        f"file_{fid}": file, f"file_{fid}_basename": one(agg.files(p).where(F.col("fid") == fid).select(fn.basename("name").alias("b")), "b"), "subs": subs, "edges": edges,
    }


#: Keys that come first, and how many others are listed.
FIRST_ATTRIBUTES, FIRST_OPTIONS, MOST_KEYS, MOST_BLOCKS = ["ticks_per_sec", "basetime", "application", "xs_version"], ["calls", "blocks", "stmts", "compress"], 24, 8


def query_json(p: Profile) -> str:
    """aggregates() with the number of returns of each sub and of calls of each edge."""
    said = aggregates(p, "")
    said.pop("profile")
    said["subs"] = {k: v["returns"] for k, v in said["subs"].items()}
    said["edges"] = {k: v["count"] for k, v in said["edges"].items()}
    return json.dumps(said, sort_keys=True)


def query_text(p: Profile, *, line: tuple[int, int] = (1, 5), block: tuple[int, int] = (1, 4), first: tuple[str, ...] = ("main::leaf", "main::mid")) -> Iterator[str]:
    """Lines: returns of subs, calls of edges, definitions, a line of source, calls of lines and blocks, processes,
    attributes and options. Rows are fetched a partition at a time."""
    for r in agg.returns_by_name(p["SUB_RETURN"]).orderBy("name").toLocalIterator():
        yield f"{r['name']} returns={r.returns}"
    for r in agg.call_edges(p["SUB_CALLERS"]).orderBy("caller", "called").toLocalIterator():
        yield f"{r.caller} -> {r.called} count={r.calls}"
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in first]), F.col("name")), F.lit(0)), F.lit(len(first) + 1))
    for r in agg.sub_defs(p).orderBy(place, "name").toLocalIterator():
        yield f"sub_def {r['name']} fid={r.fid} first={r.first_line} last={r.last_line}"
    source = agg.source_lines(p).where((F.col("fid") == line[0]) & (F.col("line") == line[1])).first()
    if source:
        yield f"source_line {line[0]}:{line[1]}={source.text.removesuffix(chr(10)).removesuffix(chr(13))}"
    calls = agg.line_totals(p).where((F.col("fid") == line[0]) & (F.col("line") == line[1])).first()
    if calls:
        yield f"line_calls {line[0]}:{line[1]}={calls.calls}"
    asked = ~((F.col("fid") == block[0]) & (F.col("block_line") == block[1]))
    for r in agg.block_totals(p).withColumn("key", F.concat_ws(":", F.col("fid").cast("string"), F.col("block_line").cast("string"))).orderBy(asked, "key").limit(MOST_BLOCKS).collect():
        yield f"block_line_calls {r.key}={r.calls}"
    starts, ends = agg.pid_starts(p), agg.pid_ends(p)
    counts = starts.count(), ends.count()
    if any(counts):
        yield f"pid_start_count={counts[0]}"
        yield f"pid_end_count={counts[1]}"
        for r in starts.withColumn("t", fn.format_ticks("start_time")).orderBy("place").toLocalIterator():
            yield " ".join([f"pid_start pid={r.pid}", *([f"ppid={r.ppid}"] if r.ppid is not None else []), *([f"start_time={r.t}"] if r.t is not None else [])])
        for r in ends.withColumn("t", fn.format_ticks("end_time")).orderBy("place").toLocalIterator():
            yield f"pid_end pid={r.pid}" + (f" end_time={r.t}" if r.t is not None else "")
    for word, df, keys in (("attribute", agg.attributes(p), FIRST_ATTRIBUTES), ("option", agg.options(p), FIRST_OPTIONS)):
        total = df.count()
        held = {r.key: r.value for r in (df if total <= MOST_KEYS + len(keys) else df.where(F.col("key").isin(keys))).collect() if r.value is not None}
        for k in [*[k for k in keys if k in held], *sorted(k for k in held if k not in keys)]:
            yield f"{word} {k}={held[k]}"
        if total > MOST_KEYS + len(keys):
            yield f"{word}_count={total}"


def aggregates_json(p: Profile, label: str, **places) -> str:
    return json.dumps(aggregates(p, label, **places), sort_keys=True)
