"""Queries over the projected tables and their DuckDB SQL, which is written from the rules, not from the Spark code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views as SQL, by name.
VIEWS = {
    "time_line": "SELECT CAST(round(l_extendedprice*100) AS BIGINT) AS ticks, l_suppkey AS fid, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_linestatus = 'O'",
    "time_block": "SELECT CAST(round(l_extendedprice*100) AS BIGINT) AS ticks, l_suppkey AS fid, CAST(l_linenumber AS BIGINT) AS line, CAST(l_linenumber - (l_linenumber - 1) % 3 AS BIGINT) AS block_line FROM lineitem WHERE l_linestatus = 'F'",
    "timing": "SELECT ticks, fid, line FROM time_line UNION ALL SELECT ticks, fid, line FROM time_block",
    "discount": "SELECT 1 AS one FROM lineitem WHERE l_discount = 0",
    "sub_entry": "SELECT user_id % 50 AS fid, event_id % 97 AS line FROM events WHERE event_type = 'click'",
    "sub_return": "SELECT 1 + event_id % 5 AS depth, CAST(CAST(round(value*100) AS BIGINT) AS DOUBLE) AS incl, CAST(CAST(round(value*100) AS BIGINT) - CAST(round(value*100) AS BIGINT) % 7 AS DOUBLE) AS excl, 'main::' || event_type AS name FROM events",
    "sub_callers": "SELECT l_suppkey AS fid, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS calls, CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS DOUBLE) AS incl, CAST(CAST(round(l_extendedprice*100) AS BIGINT) // 2 AS DOUBLE) AS excl, CAST(CAST(round(l_tax*100) AS BIGINT) AS DOUBLE) AS reci, CAST(l_linenumber AS BIGINT) AS depth, 'P' || (l_partkey % 10) || '::f' || (l_partkey % 40) AS called, 'P' || (l_suppkey % 10) || '::f' || (l_suppkey % 40) AS caller FROM lineitem",
    "call_return": "SELECT called AS name, incl, excl FROM sub_callers",
    "new_fid": "SELECT s_suppkey AS fid, '/app/lib/' || s_name || CASE WHEN s_suppkey % 5 = 0 THEN '.pl' ELSE '.pm' END AS name FROM supplier",
    "sub_info": "SELECT p_partkey AS seq, p_partkey % 100 AS fid, CAST(p_size AS BIGINT) AS first_line, p_size + p_partkey % 20 AS last_line, 'P' || (p_partkey % 10) || '::f' || (p_partkey % 40) AS name FROM part",
    "src_line": "SELECT p_partkey AS seq, p_partkey % 100 AS fid, CAST(p_size AS BIGINT) AS line, p_name AS text FROM part",
    "attribute": "SELECT r_name AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT 'ticks_per_sec', '10000000'",
    "option": "SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation",
    "pid_start": "SELECT o_orderkey AS pid, epoch(o_orderdate) AS time FROM orders",
    "pid_end": "SELECT o_orderkey AS pid, epoch(o_orderdate) AS time FROM orders WHERE o_orderstatus = 'F'",
    "lines": "SELECT fid, line, count(*) AS calls, CAST(sum(ticks) AS BIGINT) AS ticks FROM timing GROUP BY 1, 2",
    "blocks": "SELECT fid, block_line, count(*) AS calls, CAST(sum(ticks) AS BIGINT) AS ticks FROM time_block GROUP BY 1, 2",
    "edges": "SELECT caller, called, CAST(sum(calls) AS BIGINT) AS calls, sum(incl) AS incl, sum(excl) AS excl, sum(reci) AS reci, max(depth) AS max_rec_depth, count(*) AS sites FROM sub_callers GROUP BY 1, 2",
    "subs": "SELECT name, count(*) AS returns, sum(incl) AS incl, sum(excl) AS excl FROM call_return GROUP BY 1",
    "defs": "SELECT name, arg_max(fid, seq) AS fid, arg_max(first_line, seq) AS first_line, arg_max(last_line, seq) AS last_line FROM sub_info GROUP BY 1",
    "sites": "SELECT caller, called, fid, line, CAST(sum(calls) AS BIGINT) AS calls, sum(incl) AS incl, sum(excl) AS excl FROM sub_callers GROUP BY 1, 2, 3, 4",
    "usable": "SELECT s.* FROM sites s WHERE fid <> 0 AND line <> 0 AND (NOT (fid = 1 AND line = 1) OR EXISTS (SELECT 1 FROM defs d WHERE d.name = s.caller AND d.fid = 1 AND d.first_line = 1))",
    "tree": "SELECT 'main::RUNTIME' AS caller, 'R::' || r_name AS called, 1 AS calls, 0 AS incl FROM region UNION ALL SELECT 'R::' || r_name, 'N::' || n_name, 1, 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'N::' || n_name, 'S::f' || s_suppkey, s_suppkey % 9 + 1, s_suppkey % 50 + 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "kids": "SELECT e.caller, e.called, e.calls, CASE WHEN s.incl > 0 THEN s.incl WHEN e.incl > 0 THEN e.incl ELSE CAST(e.calls AS DOUBLE) END AS weight FROM edges e LEFT JOIN subs s ON s.name = e.called WHERE e.calls > 0 AND e.called <> '' AND e.caller <> e.called",
}
#: Which views a view is made of, in the order in which they have to stand.
_NEEDS = {
    "timing": ["time_line", "time_block"], "lines": ["timing"], "blocks": ["time_block"], "call_return": ["sub_callers"], "edges": ["sub_callers"], "subs": ["call_return"],
    "defs": ["sub_info"], "sites": ["sub_callers"], "usable": ["sites", "defs"], "kids": ["edges", "subs"],
}


def sql(names: str, body: str) -> str:
    """body after WITH of the named views and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not head:
        return body
    if body.startswith("RECURSIVE "):
        body, rest = body.removeprefix("RECURSIVE ").split(" SELECT_FROM ", 1)
        return f"WITH RECURSIVE {head}, {body} {rest}"
    return f"WITH {head} {body}"


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""

    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep
