"""Column types, display names and row keys of log records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.times import epoch_millis

# Index types and what they decode to. The list is closed.
INDEX_TYPES = {
    "string": "string",
    "text_general": "string",
    "long_n": "bigint",
    "integer": "int",
    "double_n": "double",
    "float_n": "float",
    "tdate": "timestamp_ntz",
}


def decode(df: DataFrame, types: Mapping[str, str], absent_as_empty: bool = True) -> DataFrame:
    """Cast raw text columns to their index types; an absent text becomes ``""``.

    Columns without a type stay text. A type outside the list raises before any job.
    """
    columns = []
    for name in df.columns:
        kind = types.get(name, "string")
        if kind not in INDEX_TYPES:
            raise ValueError(f"index type not supported: {kind}")
        column = F.col(name).try_cast(INDEX_TYPES[kind])
        if absent_as_empty and INDEX_TYPES[kind] == "string":
            column = F.coalesce(column, F.lit(""))
        columns.append(column.alias(name))
    return df.select(*columns)


def with_display_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename short codes; columns without a display name keep theirs."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def project(df: DataFrame, key: str, columns: Sequence[str] = ()) -> DataFrame:
    """The chosen columns, or just the key."""
    return df.select(*(columns or [key]))


def row_key(time: Column, task: Column) -> Column:
    """``"<millis>#<task>"``."""
    return F.concat_ws("#", epoch_millis(time).cast("string"), task.cast("string"))


def row_key_time(key: Column) -> Column:
    """The milliseconds in a row key."""
    return F.split_part(key, F.lit("#"), F.lit(1)).cast("bigint")


def row_key_task(key: Column) -> Column:
    """The task number in a row key."""
    return F.split_part(key, F.lit("#"), F.lit(2)).cast("int")


def storage_key(key: Column) -> Column:
    """The stored form as hex: eight time bytes, last first, then two task bytes."""
    time = F.lpad(F.hex(row_key_time(key)), 16, "0")
    turned = F.concat(*(F.substring(time, i, 2) for i in range(15, 0, -2)))
    task = F.lpad(F.hex(F.pmod(row_key_task(key), F.lit(65536))), 4, "0")
    return F.concat(turned, task)


def from_storage_key(stored: Column) -> Column:
    """The inverse of :func:`storage_key`."""
    time = F.conv(F.concat(*(F.substring(stored, i, 2) for i in range(15, 0, -2))), 16, 10)
    task = F.conv(F.substring(stored, 17, 4), 16, 10).cast("int")
    signed = F.when(task > 32767, task - 65536).otherwise(task)
    return F.concat_ws("#", time, signed.cast("string"))
