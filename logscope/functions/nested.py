"""Nested JSON held in a text column."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T


def value_at(json_text: Column, path: str) -> Column:
    """The value at a path such as ``a.b[2].c``, as text."""
    return F.get_json_object(json_text, f"$.{path}")


def _object_list_text(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda item: F.to_json(item)), ", ")


def _leaves(column: Column, name: str, kind: T.DataType) -> Iterator[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from _leaves(column[field.name], f"{name}.{field.name}" if name else field.name,
                               field.dataType)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        yield name, _object_list_text(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        yield name, F.when(F.size(column) == 1, F.get(column, F.lit(0)).cast("string")).otherwise(
            F.to_json(column)
        )
    else:
        yield name, column


def flatten_json(
    df: DataFrame, column: str, schema: T.StructType, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One column per leaf of the JSON text, named by its dotted path, sorted by name.

    A list of objects becomes the JSON texts joined by ``", "``; a list of
    numbers becomes text, the bare number when it holds just one.
    """
    parsed = df.select(*keep, F.from_json(F.col(column), schema).alias("_parsed"))
    leaves = sorted(_leaves(F.col("_parsed"), "", schema), key=lambda leaf: leaf[0])
    return parsed.select(*keep, *(leaf.alias(name) for name, leaf in leaves))
