"""Validators of program texts. Each is a plain function and an Arrow UDF giving struct(passed, violations)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

REPORT = "passed boolean, violations array<struct<kind: string, name: string, line: string>>"


def as_udf(check):
    """An Arrow UDF of a function text -> list of (kind, name, line); distinct texts of a batch are checked once. Null is null."""

    @F.pandas_udf(REPORT)
    def run(s: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        rows = []
        for t in s:
            if t is not None and t not in memo:
                memo[t] = check(t)
            v = memo.get(t)
            rows.append((None, None) if v is None else (not v, [{"kind": k, "name": n, "line": x} for k, n, x in v]))
        return pd.DataFrame(rows, columns=["passed", "violations"])

    return run
