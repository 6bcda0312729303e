"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import DATA, rows_of

from tickloom import plans

Q, O = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_sql(spark, duck, name):
    got, want = Q[name](spark, DATA).toPandas(), duck.sql(O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_cyclic_flame_layout(spark, duck):
    """Against a plain walk over the same edges."""
    edges = duck.sql("WITH c AS (SELECT 'P' || (l_partkey % 10) || '::f' || (l_partkey % 40) AS called, 'P' || (l_suppkey % 10) || '::f' || (l_suppkey % 40) AS caller, l_extendedprice AS p FROM lineitem) SELECT caller, called, sum(round(p * 100)) FROM c GROUP BY 1, 2").fetchall()
    incl = {}
    for _, called, w in edges:
        incl[called] = incl.get(called, 0) + w
    kids = {}
    for caller, called, _ in edges:
        if caller != called:
            kids.setdefault(caller, []).append((called, incl[called]))
    called = {n for v in kids.values() for n, _ in v}
    roots = [c for c in kids if c not in called] or list(kids)
    weight = {r: max(incl.get(r, 0), sum(w for _, w in kids[r]), 1) for r in roots}
    total, found = sum(weight.values()), []

    def walk(name, w, width, depth, path):
        if width < 1 or depth >= 16:
            return
        found.append((depth, "/".join([*path, name]), round(width, 6)))
        if name in path or name not in kids:
            return
        s = sum(x for _, x in kids[name])
        for n, x in kids[name]:
            walk(n, x, x / s * width * min(1, s / max(w, s)), depth + 1, [*path, name])

    for r in roots:
        walk(r, weight[r], weight[r] / total * 1200, 0, [])
    got = [(r.depth, r.path, r.width_milli / 1000) for r in Q["flame_layout_cyclic"](spark, DATA).collect()]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(found)]
    assert all(abs(a[2] - b[2]) < 2e-3 for a, b in zip(sorted(got), sorted(found)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10


@pytest.mark.parametrize("gone", ["'corpus_pipeline', 'tickloom.llm'", "'xxhash',"])
def test_imports_without_the_optional_part(gone):
    """The entry module works where the subpackage and the pipeline are gone, or a library that they alone need."""
    import subprocess
    import sys

    code = "import re, sys; import importlib.abc\nclass F(importlib.abc.MetaPathFinder):\n def find_spec(self, n, p, t=None):\n  if n in (GONE): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nassert 'top_lines' in e.queries() and not any(re.match(r'op\\d+_', k) for k in e.queries())"
    code = code.replace("GONE", gone)
    import os

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)
