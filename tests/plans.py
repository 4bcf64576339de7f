"""What the plan of a DataFrame holds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def planned(df: DataFrame) -> str:
    """The physical plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df: DataFrame) -> int:
    """How many file scans ran, after adaptive execution reused what it could."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    # Only scans that ran stand below a row conversion. A subquery is printed
    # wherever it is used, but its columns are numbered once.
    ran = re.findall(r"ColumnarToRow\n[^\n]*FileScan parquet \[([^\]]*)\]", plan.toString())
    return len(set(ran))
