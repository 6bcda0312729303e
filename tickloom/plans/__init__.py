"""Registered queries: each a plan over the table projections with SQL that says the same."""

from __future__ import annotations

from tickloom.plans import core, registry, reports, roundtrips, sequences  # noqa: F401  the modules register their queries


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
