"""Scalar and aggregate expressions, all built from Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    """After the last slash of either kind; the whole path where that is empty."""
    p = _c(path)
    last = F.regexp_extract(p, r"([^/\\]*)\z", 1)
    return F.when(last == "", p).otherwise(last)


def stripped_basename(path) -> Column:
    """The same after trailing slashes are taken off; a path of slashes alone stays."""
    p = _c(path)
    bare = F.regexp_replace(p, r"[/\\]+\z", "")
    return F.when(bare == "", p).otherwise(F.regexp_extract(bare, r"([^/\\]*)\z", 1))


def is_path_like(text) -> Column:
    t = _c(text)
    return t.rlike(r"[/\\]")


def package_of(sub) -> Column:
    """Before the last `::`, unless that is at the start; else `main`."""
    found = F.regexp_extract(_c(sub), r"(?s)\A(.+)::", 1)
    return F.when(found == "", F.lit("main")).otherwise(found)


def edge_key(caller, called, separator: str = " -> ") -> Column:
    return F.concat(_c(caller), F.lit(separator), _c(called))


def dot_quote(text) -> Column:
    escaped = F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def fragment_id(text) -> Column:
    """A character that isn't an ASCII letter or digit becomes `_`."""
    return F.regexp_replace(_c(text), "[^A-Za-z0-9]", "_")


def csv_field(text) -> Column:
    """Quoted where a comma, quote or line end is in it, quotes doubled."""
    t = _c(text)
    return F.when(t.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def format_ticks(value) -> Column:
    """Integers without a point; other numbers in full."""
    v = _c(value).cast("double")
    return F.when((v == F.floor(v)) & (F.abs(v) < F.lit(float(LONG_MAX))), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string"))


def normalized_number(value) -> Column:
    """A float in one stable form: whole ones of at most 2**53 as integers, what isn't finite as a mark, others in full
    (the shortest text that reads back as the same number)."""
    v = _c(value).cast("double")
    endless = F.when(F.isnan(v), F.lit("<NAN>")).when(v == F.lit(float("inf")), F.lit("<INF>")).when(v == F.lit(float("-inf")), F.lit("<-INF>"))
    whole = (v == F.floor(v)) & (F.abs(v) <= F.lit(float(1 << 53)))
    return F.coalesce(endless, F.when(whole, F.when(whole, v).cast("long").cast("string")).otherwise(v.cast("string")))


def ticks_per_second(value) -> Column:
    """A positive integer attribute as a number, else null."""
    n = F.expr("try_cast({} as bigint)".format(value)) if isinstance(value, str) else value.try_cast("bigint")
    return F.when(n > 0, n)


def finite(value) -> Column:
    """An attribute as a finite number, else null."""
    v = _c(value).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def compact_seconds(seconds) -> Column:
    """Three significant digits with a unit: ns and µs without decimals, ms and s with up to two, s from 100 with none. Halves go to even."""
    s = _c(seconds).cast("double")
    a = F.abs(s)

    def scaled(factor, unit):
        v = a * F.lit(factor)
        digits = F.length(F.floor(v).cast("string"))
        return F.concat(F.when(digits >= 3, F.format_string("%.0f", F.rint(v))).when(digits == 2, F.format_string("%.1f", F.rint(v * 10) / 10)).otherwise(F.format_string("%.2f", F.rint(v * 100) / 100)), F.lit(unit))

    text = (
        F.when(a < 1e-6, F.concat(F.format_string("%.0f", F.rint(a * 1e9)), F.lit("ns")))
        .when(a < 1e-3, F.concat(F.format_string("%.0f", F.rint(a * 1e6)), F.lit("µs")))
        .when(a < 1, scaled(1e3, "ms"))
        .when(a < 100, scaled(1.0, "s"))
        .otherwise(F.concat(F.format_string("%.0f", F.rint(a)), F.lit("s")))
    )
    return F.when(F.isnan(s) | (a == F.lit(float("inf"))), format_ticks(s)).when(s == 0, F.lit("0s")).otherwise(F.concat(F.when(s < 0, F.lit("-")).otherwise(F.lit("")), text))


def time_cell(ticks, per_second) -> Column:
    """Ticks as time; as they are without a scale, or where they are so small that they must be seconds already."""
    t, p = _c(ticks).cast("double"), _c(per_second).cast("double")
    already = (F.abs(t) > 0) & (F.abs(t) < 1) & (F.abs(t / p) < 1e-9)
    return F.when(p.isNull(), format_ticks(t)).when(already, compact_seconds(t)).otherwise(compact_seconds(t / p))


def callgrind_cost(value, fallback) -> Column:
    """A whole, non-negative cost as it is, else the fallback if above 0, else the cost rounded if above 0, else 0."""
    v, f = _c(value).cast("double"), _c(fallback).cast("long")
    whole = (v >= 0) & (v == F.floor(v)) & (v < F.lit(float(LONG_MAX)))
    return F.when(whole, F.when(whole, v).cast("long")).when(f > 0, f).when((v > 0) & (v < F.lit(float(LONG_MAX))), F.when((v > 0) & (v < F.lit(float(LONG_MAX))), F.floor(v + 0.5)).cast("long")).otherwise(F.lit(0).cast("long"))


def unsigned_ticks(ticks) -> Column:
    """A negative 32-bit tick count read again as unsigned."""
    t = _c(ticks).cast("long")
    return F.when(t < 0, t.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(t)


def close(a, b, tolerance: float = 1e-9) -> Column:
    """Equal, or within tolerance absolutely or relative to the larger."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    return (x == y) | (F.abs(x - y) <= tolerance) | (F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)))


def fits_double(value) -> Column:
    """An integer that a double holds exactly."""
    v = _c(value)
    return v.cast("double").cast("decimal(38,0)") == v.cast("decimal(38,0)")


def saturating_sum(value) -> Column:
    """A 64-bit sum that stops at the ends of its range instead of failing. Exact whenever nothing overflows on the way."""
    v = _c(value).cast("long")
    rough = F.sum(v.cast("double"))
    held = F.when(rough > 0, F.lit(LONG_MAX)).when(rough < 0, F.lit(LONG_MIN))
    return F.coalesce(F.try_sum(v), held, F.lit(0).cast("long"))


def heat(value, q1, q2, q3, spread) -> Column:
    """Class by quartile: hot, high, mid or low; empty for zero or where all values are the same."""
    v = _c(value)
    return F.when((v == 0) | ~_c(spread), F.lit("")).when(v >= _c(q3), "hot").when(v >= _c(q2), "high").when(v >= _c(q1), "mid").otherwise("low")


#: File names and directory fragments of a language's own library.
LIBRARY_FILES = ["config_heavy.pl", "config.pm", "sitecustomize.pl", "warnings.pm"]
LIBRARY_PARTS = ["/lib/perl", "/lib64/perl", "site_perl", "vendor_perl", "/usr/share/perl", "/usr/lib/perl", "/usr/lib64/perl"]


def is_library(path) -> Column:
    slashed = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    out = F.lower(basename(path)).isin(LIBRARY_FILES)
    for part in LIBRARY_PARTS:
        out = out | slashed.contains(part)
    return out


def is_workload(name) -> Column:
    n = _c(name)
    return n.endswith("::leaf") | n.endswith("::mid") | n.contains("main::leaf") | n.contains("main::mid")


#: Keys that attribute and option records are known to have.
ATTRIBUTE_KEYS = ["basetime", "ticks_per_sec", "application", "xs_version", "perl_version", "nv_size", "PL_perldb", "clock_id", "cumulative_overhead_ticks"]
OPTION_KEYS = [
    "file", "format", "start", "end", "compress", "stmts", "blocks", "subs", "calls", "leave", "slowops", "durable", "aggregate", "usecputime", "clock", "trace", "findcaller", "forkdepth",
    "addpid", "nameevals", "nameanonsubs", "evals", "sigexit", "posix_exit", "perldb", "use_db_sub", "expand", "log", "optimize", "optimise", "savesrc", "endatexit", "libcexit", "addtimestamp", "wrap", "entersub",
]


def parse_options(said: str | None) -> dict[str, str]:
    """key=value pairs between colons, a backslash before a character that stands for itself; the last of a key counts.
    A pair without = or key, or an unknown key, is an error."""
    out = {}
    for pair in re.findall(r"(?:[^\\:]|\\.)+", said or "", re.DOTALL):
        key, eq, value = re.sub(r"\\(.)", r"\1", pair, flags=re.DOTALL).partition("=")
        if not eq or not key:
            raise ValueError(f"malformed option: {pair}")
        if key not in OPTION_KEYS:
            raise ValueError(f"unknown option: {key}")
        out[key] = value
    return out


def is_known_key(tag, key) -> Column:
    """Whether the key of an ATTRIBUTE or OPTION record is a known one."""
    return F.when(_c(tag) == "ATTRIBUTE", _c(key).isin(ATTRIBUTE_KEYS)).when(_c(tag) == "OPTION", _c(key).isin(OPTION_KEYS)).otherwise(F.lit(False))
