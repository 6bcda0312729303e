"""The event relation: one wide, typed row for each record of a profile stream.

A record has a tag and positional arguments. Each argument has a column of its own name here, null in records of other
tags, so that Parquet stores the nulls for next to nothing, a query reads only the columns it names, and filters on
`tag` reach the scan. `(profile_id, seq)` identifies a record; seq is the order within a profile, and order counts.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Tag -> arguments in order, as (column, kind). u: integer >= 0, i: integer, n: float, s: string.
TAGS: dict[str, list[tuple[str, str]]] = {
    "VERSION": [("major", "u"), ("minor", "u")],
    "COMMENT": [("text", "s")],
    "ATTRIBUTE": [("key", "s"), ("value", "s")],
    "OPTION": [("key", "s"), ("value", "s")],
    "START_DEFLATE": [],
    "PID_START": [("pid", "u"), ("ppid", "u"), ("time", "n")],
    "PID_END": [("pid", "u"), ("time", "n")],
    "NEW_FID": [("fid", "u"), ("eval_fid", "u"), ("eval_line", "u"), ("flags", "u"), ("size", "u"), ("mtime", "u"), ("name", "s")],
    "TIME_LINE": [("ticks", "i"), ("fid", "u"), ("line", "u")],
    "TIME_BLOCK": [("ticks", "i"), ("fid", "u"), ("line", "u"), ("block_line", "u"), ("sub_line", "u")],
    "DISCOUNT": [],
    "SUB_ENTRY": [("fid", "u"), ("line", "u")],
    "SUB_RETURN": [("depth", "u"), ("incl", "n"), ("excl", "n"), ("name", "s")],
    "SUB_INFO": [("fid", "u"), ("first_line", "u"), ("last_line", "u"), ("name", "s")],
    "SUB_CALLERS": [("fid", "u"), ("line", "u"), ("calls", "u"), ("incl", "n"), ("excl", "n"), ("reci", "n"), ("depth", "u"), ("called", "s"), ("caller", "s")],
    "SRC_LINE": [("fid", "u"), ("line", "u"), ("text", "s")],
}
#: Closes a dump; not an event.
END = "_END"

KINDS = {"u": T.LongType(), "i": T.LongType(), "n": T.DoubleType(), "s": T.StringType()}
COLUMNS: dict[str, str] = {}
for _args in TAGS.values():
    for _name, _kind in _args:
        COLUMNS.setdefault(_name, _kind)

EVENTS = T.StructType([T.StructField("profile_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("tag", T.StringType()), *[T.StructField(c, KINDS[k]) for c, k in COLUMNS.items()]])


def view_columns(tag: str) -> list[str]:
    """Columns of the typed view of a tag."""
    return ["profile_id", "seq", *[c for c, _ in TAGS[tag]]]
