"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from corvane.llm import merkle, metric_join, mixing, overlap, pairs, spans, subjects, tokens, truncation

MODULES = (metric_join, merkle, spans, truncation, overlap, pairs, tokens, mixing, subjects)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in vars(m).items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
