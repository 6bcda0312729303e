"""Flame SVG and the HTML report: an index, a page for each file with source, graphs, all published at once.

Every table has all its rows. Rows are sorted by the executors and come to the driver a partition at a time, for all
files of a site in one pass, so neither the number of jobs nor the driver's memory follows the number of files or rows.
"""

from __future__ import annotations

import html
import os
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom.operators import aggregates as agg
from tickloom.operators import derived, graph, tools
from tickloom.operators.aggregates import P
from tickloom.sinks import text
from tickloom.views import Profile

STYLE = "body{font:14px system-ui,sans-serif;margin:1.5em}table{border-collapse:collapse;margin:1em 0}td,th{padding:.15em .6em;border-bottom:1px solid #ddd}td.n{text-align:right}.hot{background:#f99}.high{background:#fc9}.mid{background:#ff9}.low{background:#cfc}tr.note td{color:#666}pre{margin:0}"
SORT = "document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const t=h.closest('table'),i=[...h.parentNode.children].indexOf(h),n=x=>{const c=x.children[i];return c.dataset.v??c.textContent};const d=h.dataset.d=h.dataset.d==='1'?'-1':'1';[...t.tBodies[0].rows].sort((a,b)=>{const x=n(a),y=n(b);return d*(isNaN(x)||isNaN(y)?x.localeCompare(y):x-y)}).forEach(r=>t.tBodies[0].append(r))})"
#: Where a page has its style and script: in itself, or in files of the site.
_INSIDE = (f"<style>{STYLE}</style>", f"<script>{SORT}</script>")
_BESIDE = ('<link rel="stylesheet" href="style.css">', '<script src="sort.js"></script>')


class BadFolder(ValueError):
    """A place where no site is written."""


def fill(name: str) -> str:
    """One of 24 warm hues, by a checksum of the name: a sub has one colour wherever it stands."""
    return f"hsl({zlib.crc32(name.encode()) % 24 * 3},85%,74%)"


def flame_svg(p: Profile, listed: set[int] = frozenset()) -> str:
    edges, subs = agg.call_edges(p["SUB_CALLERS"]), agg.sub_totals(p["SUB_RETURN"])
    frames = graph.flame_layout(edges, subs).join(subs, [P, "name"], "left")
    at = agg.sub_defs(p).select(P, "name", F.col("fid").alias("at_fid"), "first_line")
    frames = frames.join(at, [P, "name"], "left").orderBy("depth", "x").collect()  # bounded by the canvas
    rows = 1 + max((f.depth for f in frames), default=0)
    height = graph.PADDING * 2 + rows * graph.ROW_HEIGHT
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<svg xmlns="http://www.w3.org/2000/svg" width="{graph.WIDTH:.0f}" height="{height:.0f}" viewBox="0 0 {graph.WIDTH:.0f} {height:.0f}" role="img">', "<title>Call tree</title>"]
    if not frames:
        out.append('<text x="8" y="16" font-size="12">No call edges</text>')
    for f in frames:
        y = height - graph.PADDING - (f.depth + 1) * graph.ROW_HEIGHT
        calls = f.returns or f.calls
        incl = f.incl if f.incl and f.incl > 0 else f.weight
        name = html.escape(f.name)
        label = name if f.width > 7 * len(f.name) else ""
        box = f'<g><title>{name}: {calls} calls, {incl:g} inclusive</title><rect x="{f.x:.2f}" y="{y:.2f}" width="{f.width:.2f}" height="{graph.ROW_HEIGHT - 1:.0f}" fill="{fill(f.name)}" rx="2"/><text x="{f.x + 3:.2f}" y="{y + 15:.2f}" font-size="11">{label}</text></g>'
        out.append(f'<a href="file-{f.at_fid}.html#L{f.first_line}">{box}</a>' if f.at_fid in listed else box)
    return "\n".join([*out, "</svg>"]) + "\n"


def _page(title: str, body: Iterable[str], parts: tuple[str, str] = _INSIDE) -> Iterator[str]:
    yield f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title>{parts[0]}</head><body>\n<h1>{html.escape(title)}</h1>\n'
    for piece in body:
        yield piece + "\n"
    yield f"{parts[1]}\n</body></html>\n"


def _cell(c) -> str:
    """Text, or (value to sort by, text, heat), or (text, link), or a number that is the place for links."""
    if isinstance(c, int):
        return f'<td class="n" id="L{c}">{c}</td>'
    if isinstance(c, tuple) and len(c) == 3:
        return f'<td class="n {c[2] or ""}" data-v="{c[0]}">{html.escape(str(c[1]))}</td>'
    if isinstance(c, tuple):
        return f'<td><a href="{html.escape(c[1])}">{html.escape(c[0])}</a></td>'
    return f"<td>{html.escape(str(c))}</td>"


def _table(heads: list[str], rows: Iterable[list]) -> Iterator[str]:
    """A row that is text is one note over all columns."""
    yield "<table><thead><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in heads) + "</tr></thead><tbody>"
    for r in rows:
        yield f'<tr class="note"><td colspan="{len(heads)}">{html.escape(r)}</td></tr>' if isinstance(r, str) else "<tr>" + "".join(map(_cell, r)) + "</tr>"
    yield "</tbody></table>"


def _scale(p: Profile):
    r = agg.attributes(p).where("key = 'ticks_per_sec'").select(fn.ticks_per_second(F.col("value")).alias("v")).first()
    return F.lit(r.v if r else None).cast("double")


def _subs(p: Profile, scale, defs: DataFrame) -> DataFrame:
    """What tables of subs show: totals, heat, times as text, places and files of callers, where each is defined."""
    out = derived.sub_heat(p["SUB_RETURN"]).join(derived.places_and_files(p["SUB_CALLERS"], defs).withColumnRenamed("called", "name"), [P, "name"], "left")
    out = out.join(defs.select(P, "name", F.col("fid").alias("at_fid"), F.col("first_line").alias("at_line")), [P, "name"], "left")
    return out.withColumn("excl_text", fn.time_cell("excl", scale)).withColumn("incl_text", fn.time_cell("incl", scale))


SUB_HEADS = ["Calls", "P", "F", "Exclusive", "Inclusive", "Subroutine"]


def _sub_row(r: Row, listed: set[int]) -> list:
    name = (r["name"], f"file-{r.at_fid}.html#L{r.at_line}") if r.at_fid in listed else r["name"]
    return [(r.returns, r.returns, ""), (r.places or 0, r.places or 0, ""), (r["files"] or 1, r["files"] or 1, ""), (r.excl, r.excl_text, r.excl_heat), (r.incl, r.incl_text, r.incl_heat), name]


def _by_excl(subs: DataFrame, n: int | None = None) -> Iterator[Row]:
    subs = subs.orderBy(F.desc("excl"), "name")
    return (subs.limit(n) if n else subs).toLocalIterator()


def summary(p: Profile, title: str = "Profile", flame: bool = True) -> str:
    """One page: totals, all subs, edges, definitions, blocks, the flame and the primary file's source."""
    primary = derived.primary_file(p).first()
    fid = primary.fid if primary else 1
    named = agg.files(p).where(F.col("fid") == fid).first()
    scale, defs = _scale(p), agg.sub_defs(p)

    def body():
        yield from _index(p, flame, scale, defs)
        yield f"<h2>Source of {html.escape((named and named['name']) or f'fid {fid}')}</h2>"
        yield from _source(_file_lines(p, scale, defs).where(F.col("fid") == fid).orderBy("line", "kind", "text").toLocalIterator())

    return "".join(_page(title, body()))


def _index(p: Profile, flame: bool, scale, defs: DataFrame, files: list | None = None) -> Iterator[str]:
    """All rows of each table; only with files, whose site has a page of all subs, are subs the top 15."""
    t = derived.index_totals(p, p["SUB_RETURN"]).first()
    if t:
        active = f"{t.active:g} s" if t.active is not None else f"{t.ticks} ticks"
        yield f"<p>{t.statements} statements and {t.sub_calls} subroutine calls in {t['files']} files, {active}.</p>"
    listed = {f.fid for f in files or ()}
    if files is None:
        yield "<h2>Subroutines</h2>"
        yield from _table(SUB_HEADS, (_sub_row(r, listed) for r in _by_excl(_subs(p, scale, defs))))
    else:
        yield '<h2>Top 15 subroutines</h2>\n<p><a href="index-subs-excl.html">All subroutines</a>, <a href="source.html">primary source</a></p>'
        yield from _table(SUB_HEADS, (_sub_row(r, listed) for r in _by_excl(_subs(p, scale, defs), 15)))
        totals = {r.fid: r for r in derived.with_heat(agg.file_totals(p), "ticks").withColumn("shown", fn.time_cell("ticks", scale)).toLocalIterator()}
        rows = []
        for f in files:
            r = totals.get(f.fid)
            rows.append([(r.calls, r.calls, "") if r else "-", (r.ticks, r.shown, r.heat) if r else "-", (f.name or f"fid {f.fid}", f"file-{f.fid}.html")])
        foot = agg.timings(p).agg(F.count("*").alias("c"), fn.saturating_sum("ticks").alias("t")).first()
        yield "<h2>Files</h2>"
        yield from _table(["Statements", "Exclusive", "File"], rows)
        yield f"<p>{foot.c} statements, {foot.t} ticks in all.</p>"
    edges = derived.with_heat(agg.call_edges(p["SUB_CALLERS"]), "excl").orderBy(F.desc("calls"), "caller", "called").toLocalIterator()
    yield "<h2>Calls</h2>"
    yield from _table(["Caller", "Called", "Count", "Inclusive", "Exclusive"], ([e.caller, e.called, (e.calls, e.calls, ""), (e.incl, e.incl, e.heat), (e.excl, e.excl, e.heat)] for e in edges))
    yield "<h2>Definitions</h2>"
    yield from _table(["Name", "File", "First", "Last"], ([d["name"], (d.fid, d.fid, ""), (d.first_line, d.first_line, ""), (d.last_line, d.last_line, "")] for d in defs.orderBy("name").toLocalIterator()))
    blocks = agg.block_totals(p).orderBy("fid", "block_line").toLocalIterator()
    first = next(blocks, None)
    if first:
        yield "<h2>Blocks</h2>"
        yield from _table(["File", "Line", "Calls", "Ticks"], ([(b.fid, b.fid, ""), (b.block_line, b.block_line, ""), (b.calls, b.calls, ""), (b.ticks, b.ticks, "")] for b in _chain(first, blocks)))
    if flame:
        yield "<h2>Flame</h2>"
        yield flame_svg(p, listed).split("\n", 1)[1]


def _chain(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def _file_lines(p: Profile, scale, defs: DataFrame) -> DataFrame:
    """Rows of all files' source tables: fid, line, kind (0 called from, 1 the line, 2 calls), text, and the line's
    figures."""
    lines = derived.line_heat(p, per_file=True).withColumn("shown", fn.time_cell("ticks", scale)).drop("calls", "ticks")
    out = derived.calls_from_lines(p["SUB_CALLERS"], defs)
    per_line = out.groupBy(P, "fid", "line").agg(F.sum("calls").alias("sub_calls"), F.sum("incl").alias("sub_incl"))
    code = derived.source_page(p).join(lines, [P, "fid", "line"], "left").join(per_line, [P, "fid", "line"], "left")
    code = code.select("fid", "line", F.lit(1).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "calls", "ticks", "shown", "calls_heat", "ticks_heat", "sub_calls", "sub_incl")
    into = derived.calls_into_lines(p["SUB_CALLERS"], defs)
    said = [F.concat(F.lit("# called by "), F.concat_ws(":", "caller", *[F.col(c).cast("string") for c in ("from_fid", "from_line", "calls")])), F.concat(F.lit("# calls "), F.concat_ws(":", "called", F.col("calls").cast("string"), fn.format_ticks("incl")))]
    for kind, df, note in ((0, into, said[0]), (2, out, said[1])):
        code = code.unionByName(df.select("fid", "line", F.lit(kind).alias("kind"), note.alias("text")), allowMissingColumns=True)
    return code


def _source(rows: Iterable[Row]) -> Iterator[str]:
    def cells(r):
        if r.kind != 1:
            return f"{r.line} {r.text}"
        return [r.line, (r.calls, r.calls, r.calls_heat) if r.calls is not None else "-", (r.ticks, r.shown, r.ticks_heat) if r.ticks is not None else "-", (r.sub_calls, r.sub_calls, "") if r.sub_calls is not None else "-", (r.sub_incl, r.sub_incl, "") if r.sub_incl is not None else "-", r.text]

    return _table(["Line", "Statements", "Time", "Calls", "Time in subs", "Code"], map(cells, rows))


class _Runs:
    """Rows sorted by fid, given out a file at a time to a caller who goes through the files in order."""

    def __init__(self, rows: Iterator[Row]):
        self.rows, self.held = rows, None

    def of(self, fid: int) -> Iterator[Row]:
        while True:
            r, self.held = self.held or next(self.rows, None), None
            if r is None:
                return
            if r.fid > fid:
                self.held = r
                return
            if r.fid == fid:
                yield r


def check_folder(out: str) -> Path:
    if not out or "\0" in out or ".." in Path(out).parts:
        raise BadFolder(f"{out!r}")
    return Path(out)


def pages(p: Profile, title: str = "Profile", flame: bool = True) -> Iterator[tuple[str, Iterator[str]]]:
    """(name, pieces of text) of each file of a site of one profile; each is to be read before the next is asked for."""
    scale, defs = _scale(p), agg.sub_defs(p)
    files = derived.eligible_files(p).join(agg.files(p), [P, "fid"]).select("fid", "name").orderBy("fid").collect()
    listed = {f.fid for f in files}
    found = derived.primary_file(p).first()
    primary = found.fid if found else 1
    yield "style.css", iter([STYLE])
    yield "sort.js", iter([SORT])
    yield "index.html", _page(title, _index(p, flame, scale, defs, files), _BESIDE)
    subs = _subs(p, scale, defs)
    yield "index-subs-excl.html", _page(f"{title}: subroutines", _table(SUB_HEADS, (_sub_row(r, listed) for r in _by_excl(subs))), _BESIDE)
    yield "packages.dot", iter([text.dot(p, packages=True)])
    yield "subs.dot", iter([text.dot(p)])
    if flame:
        yield "flame.svg", iter([flame_svg(p, listed)])
    shown = derived.subs_of_file(p["SUB_CALLERS"], p["SUB_RETURN"], defs, derived.primary_file(p)).join(subs, [P, "name"])
    own = _Runs(shown.orderBy("fid", F.desc("excl"), "name").toLocalIterator())
    code = _Runs(_file_lines(p, scale, defs).orderBy("fid", "line", "kind", "text").toLocalIterator())

    def page(f):
        yield '<p><a href="index.html">Index</a></p>'
        yield from _table(SUB_HEADS, (_sub_row(r, listed) for r in own.of(f.fid)))
        yield from _source(code.of(f.fid))
        if f.fid == primary:
            yield "<h2>Built-in operations</h2>"
            for s in derived.undefined_calls(p["SUB_CALLERS"], defs).orderBy("called").toLocalIterator():
                yield f'<p id="{html.escape(s.called)}">{html.escape(s.called)}: {s.calls} calls</p>'

    for f in files:
        yield f"file-{f.fid}.html", _page(f.name or f"fid {f.fid}", page(f), _BESIDE)
    if primary not in listed:
        yield "source.html", _page(f"fid {primary}", ['<p><a href="index.html">Index</a></p>', "<p>No source.</p>"], _BESIDE)


def site(p: Profile, title: str = "Profile", flame: bool = True) -> dict[str, str]:
    """Name -> text of a site, for small ones: all of it is held."""
    out = {name: "".join(pieces) for name, pieces in pages(p, title, flame)}
    return out | {"source.html": out.get("source.html") or out[_primary_page(p)]}


def _primary_page(p: Profile) -> str:
    r = derived.primary_file(p).first()
    return f"file-{r.fid if r else 1}.html"


def write_site(p: Profile, out: str, title: str = "Profile", flame: bool = True, allow_incomplete: bool = False) -> None:
    """Write the site to a folder of the driver, which is replaced as a whole or not at all. Pages are written as their
    rows come."""
    target = check_folder(out)
    tools.require_complete(p, allow_incomplete)
    target.parent.mkdir(parents=True, exist_ok=True)
    new, old = (target.parent / f".{target.name}.{k}-{uuid.uuid4().hex}" for k in ("new", "old"))
    new.mkdir()
    try:
        for name, pieces in pages(p, title, flame):
            with open(new / name, "w", encoding="utf-8") as f:
                f.writelines(pieces)
                f.flush()
                os.fsync(f.fileno())
        if not (new / "source.html").exists():
            shutil.copyfile(new / _primary_page(p), new / "source.html")
        if target.exists():
            os.rename(target, old)
        os.rename(new, target)
    except OSError:
        if old.exists() and not target.exists():
            os.rename(old, target)
        raise
    finally:
        shutil.rmtree(new, ignore_errors=True)
        shutil.rmtree(old, ignore_errors=True)
