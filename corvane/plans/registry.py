"""The queries of the core and the SQL that says the same."""

from __future__ import annotations

from corvane.plans import campaign, cases, evaluation, language, pool, relational, trials

MODULES = (pool, evaluation, trials, language, relational, cases, campaign)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
