"""Verifiers outside of this process: a command that reads a text and says by its exit code whether it is valid."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of our own: timed out, no such row, not run because the text can't be an input.
TIMED_OUT, MISSING, UNFIT = -1, -2, -3


def run_command(rows: DataFrame, text: str, command: list[str], timeout: float = 10.0, needs: str | None = None) -> DataFrame:
    """rows with returncode, stdout and stderr of the command on each text, given on its standard input. Equal texts of a batch are run
    once. A command that takes too long has code -1; a null text, or one without `needs`, isn't run and has code -3."""

    def one(s: str | None) -> tuple[int, str, str]:
        if s is None or (needs is not None and needs not in s):
            return UNFIT, "", f"the text has no {needs}" if s is not None else "no text"
        try:
            p = subprocess.run(command, input=s, capture_output=True, text=True, timeout=timeout, check=False)
            return p.returncode, p.stdout, p.stderr
        except subprocess.TimeoutExpired:
            return TIMED_OUT, "", f"no answer in {timeout} s"

    @F.pandas_udf(T.StructType.fromDDL("returncode int, stdout string, stderr string"))
    def run(s: pd.Series) -> pd.DataFrame:
        known = {x: one(x) for x in s.drop_duplicates()}
        return pd.DataFrame([known[x] for x in s], columns=["returncode", "stdout", "stderr"])

    return rows.withColumn("_r", run(text)).select(*rows.columns, "_r.*")
