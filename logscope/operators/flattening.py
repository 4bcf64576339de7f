"""JSON text flattened to columns without a schema given by the caller.

The leaves are found by a mergeable aggregate over the parsed values, so only the list of
names reaches the driver, as it must to become columns. A name that holds an object in some
rows and something else in others gives both its own column and those of the object's leaves;
such names cost one further pass for each level at which they nest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

Path = tuple[str, ...]

_NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _step(key: str) -> str:
    if not key or ("'" in key and '"' in key):
        raise ValueError(f"a key that cannot be addressed: {key!r}")
    return f'["{key}"]' if "'" in key else f"['{key}']"


def _at(value: Column, path: Path) -> Column:
    return F.variant_get(value, "$" + "".join(map(_step, path)), "variant")


def _starts(kind: Column, *words: str) -> Column:
    return kind.rlike("^(" + "|".join(words) + ")")


def _data_type(text: str) -> T.DataType:
    """The type that the aggregate names; quoted keys are left as they are."""
    return T.DataType.fromDDL(re.sub(r"`(?:[^`]|``)*`|OBJECT<",
                                     lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text))


def _walk(path: Path, kind: T.DataType, leaves: set[Path], mixed: list[Path]) -> None:
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            _walk((*path, field.name), field.dataType, leaves, mixed)
    elif path and not isinstance(kind, T.NullType):
        leaves.add(path)
        if isinstance(kind, T.VariantType):
            mixed.append(path)


def json_leaves(df: DataFrame, column: str) -> list[Path]:
    """The keys that lead to each leaf of a column of JSON text, in any row, sorted."""
    parsed = df.select(F.try_parse_json(F.col(column)).alias("v"))
    leaves: set[Path] = set()
    asked: list[Path] = [()]
    while asked:
        inner = [_at(F.col("v"), path) if path else F.col("v") for path in asked]
        found = parsed.agg(*[
            F.schema_of_variant_agg(F.when(_starts(F.schema_of_variant(x), "OBJECT"), x)).alias(f"c{i}")
            for i, x in enumerate(inner)]).first()
        mixed: list[Path] = []
        for path, text in zip(asked, found, strict=True):
            kind = _data_type(text)
            if isinstance(kind, T.StructType):
                _walk(path, kind, leaves, mixed)
        asked = mixed
    return sorted(leaves)


def _leaf_text(value: Column) -> Column:
    kind, first = F.schema_of_variant(value), F.variant_get(value, "$[0]", "variant")
    elements = F.try_variant_get(value, "$", "array<variant>")
    inner = F.schema_of_variant(first)
    listed = F.array_join(F.transform(elements, lambda x: F.coalesce(F.to_json(x), F.lit("null"))), ", ")
    return F.when(_starts(kind, "OBJECT", "VOID"), F.lit(None)).when(
        ~_starts(kind, "ARRAY"), F.try_variant_get(value, "$", "string")).when(
        _starts(inner, "OBJECT", "ARRAY", "VOID"), listed).when(
        (F.size(elements) == 1) & inner.rlike(_NUMBERS), F.variant_get(first, "$", "string")).otherwise(
        F.to_json(value))


def flatten_any_json(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One text column per leaf found in the JSON text, named by its dotted path, sorted.

    A list that starts with an object, a list or a null becomes the JSON texts of its
    elements joined by ``", "``; a list of one number becomes the number; other lists are
    JSON text. Nulls, empty objects and text that is no JSON object have no leaves. Where a
    nested key and a key with a dot give one name, the nested one wins; where a leaf has the
    name of a kept column, its own name ends in ``_json``.
    """
    named: dict[str, list[Path]] = {}
    for path in json_leaves(df, column):
        named.setdefault(".".join(path), []).append(path)
    taken = set(keep)
    parsed = df.select(*[F.col(f"`{k}`") for k in keep], F.try_parse_json(F.col(column)).alias("_parsed"))
    columns = []
    for name, paths in sorted(named.items()):
        texts = [_leaf_text(_at(F.col("_parsed"), p)) for p in sorted(paths, key=len, reverse=True)]
        while name in taken:
            name += "_json"
        taken.add(name)
        columns.append(F.coalesce(*texts).alias(name))
    return parsed.select(*[F.col(f"`{k}`") for k in keep], *columns)
