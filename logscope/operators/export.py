"""Exports as a folder of JSON, CSV or XML files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame, functions as F

from logscope.operators.paging import Sort, sorted_rows

# Rows per file, and the usual ceiling of an export.
ROWS_PER_FILE = 20_000
MAX_EXPORT_ROWS = 200_000


class TooManyRows(ValueError):
    """The export is larger than its ceiling."""


def over_ceiling(df: DataFrame, ceiling: int) -> DataFrame:
    """``(refused)``, one row: whether ``df`` has more rows than ``ceiling``.

    Every task counts its own rows, and only counts leave the tasks.
    """
    return df.agg((F.count(F.lit(1)) > ceiling).alias("refused"))


def check_ceiling(df: DataFrame, ceiling: int | None) -> None:
    """Raise if ``df`` has more rows than ``ceiling``; ``None`` allows any number."""
    if ceiling is not None and over_ceiling(df, ceiling).first()["refused"]:
        raise TooManyRows(f"the result has more than {ceiling} rows; narrow the query")


def export(
    df: DataFrame, path: str, kind: Literal["json", "csv", "xml"],
    columns: Sequence[str] | None = None, sort: Sort | None = None, key: Sequence[str] = (),
    time: str = "ts", header: bool = False, rows_per_file: int = ROWS_PER_FILE,
    ceiling: int | None = None, mode: str = "errorifexists",
) -> None:
    """Write rows as files of at most ``rows_per_file`` rows.

    ``columns`` picks what is written; it does not limit what is sorted on. A
    sorted export is in order over the files by name. JSON is one object a line.
    CSV repeats its header in each file. XML has ``<response>`` around ``<doc>`` rows.
    """
    check_ceiling(df, ceiling)
    rows = df if sort is None else sorted_rows(df, sort, key, time)
    if columns is not None:
        rows = rows.select(*columns)
    out = rows.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    # Times are written as they are; pinning the formats keeps all six fraction digits.
    out = out.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if kind == "json":
        out.option("ignoreNullFields", False).json(path)
    elif kind == "csv":
        out.option("header", header).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "xml":
        out.option("rootTag", "response").option("rowTag", "doc").option("nullValue", "").xml(path)
    else:
        raise ValueError(f"export kind not recognised: {kind}")
