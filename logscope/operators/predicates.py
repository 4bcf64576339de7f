"""Predicates over log fields. Each returns a boolean Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.numbers import latitude, longitude
from logscope.functions.text import expand_synonyms, phrase_pattern, query_words


def match_all() -> Column:
    """Every row."""
    return F.lit(True)


def term(field: str, value) -> Column:
    """The field is exactly this value."""
    return F.col(field) == F.lit(value)


def _text_test(field: str, test: Callable[[Column], Column]) -> Column:
    """A test of a field's lower-case text. The one-item list binds it, so it is made once a row."""
    return F.exists(F.array(F.lower(F.col(field))), test)


def _has_phrase(text: Column, wanted: Sequence[str], stop_words: Sequence[str]) -> Column:
    # The plain searches are cheap and drop most rows before the pattern runs.
    plain = [F.contains(text, F.lit(w)) for w in wanted]
    return reduce(and_, [*plain, F.rlike(text, F.lit(phrase_pattern(wanted, stop_words)))])


def _every_word(text: Column, choices: Sequence[Sequence[str]], stop_words: Sequence[str]) -> Column:
    """Of each list of choices the text holds at least one."""
    return reduce(and_, [
        reduce(or_, [_has_phrase(text, query_words(c, stop_words), stop_words) for c in each])
        for each in choices
    ])


def phrase(field: str, text: str, stop_words: Sequence[str] = ()) -> Column:
    """The analysed field holds these words next to each other, in this order."""
    wanted = query_words(text, stop_words)
    if not wanted:
        return match_all()
    return _text_test(field, lambda t: _has_phrase(t, wanted, stop_words))


def all_words(field: str, text: str, stop_words: Sequence[str] = ()) -> Column:
    """The analysed field holds every word of the query text."""
    wanted = [[w] for w in query_words(text, stop_words)]
    if not wanted:
        return match_all()
    return _text_test(field, lambda t: _every_word(t, wanted, stop_words))


def any_field_word(fields: Sequence[str], text: str, stop_words: Sequence[str] = ()) -> Column:
    """Every query word occurs in at least one of the fields (the catch-all search)."""
    every = []
    for word in query_words(text, stop_words):
        every.append(any_of(*(all_words(field, word, stop_words) for field in fields)))
    return all_of(*every)


def any_value_word(field: str, text: str, stop_words: Sequence[str] = ()) -> Column:
    """Every query word occurs in at least one value of a list field (the catch-all field)."""
    def held(word: str) -> Column:
        return F.exists(F.col(field), lambda value: _has_phrase(F.lower(value), [word], stop_words))

    return all_of(*(held(word) for word in query_words(text, stop_words)))


def words_or_synonyms(
    field: str, text: str, synonyms: Mapping[str, Sequence[str]], stop_words: Sequence[str] = ()
) -> Column:
    """Every query word, or one of its synonyms, occurs in the analysed field."""
    found = (expand_synonyms(w, synonyms) for w in query_words(text, stop_words))
    # A synonym of nothing but stop words can match nothing.
    wanted = [[c for c in choices if query_words(c, stop_words)] for choices in found]
    if not wanted:
        return match_all()
    return _text_test(field, lambda t: _every_word(t, wanted, stop_words))


def all_of(*predicates: Column) -> Column:
    """AND; true when there are none."""
    return reduce(and_, predicates, F.lit(True)) if predicates else F.lit(True)


def any_of(*predicates: Column) -> Column:
    """OR; false when there are none."""
    return reduce(or_, predicates) if predicates else F.lit(False)


def negate(predicate: Column) -> Column:
    """NOT; a row the predicate cannot decide (null) counts as not matching, so it is kept."""
    return ~F.coalesce(predicate, F.lit(False))


def between(field: str, low, high) -> Column:
    """Range, both ends inclusive; ``None`` leaves an end open."""
    bounds = []
    if low is not None:
        bounds.append(F.col(field) >= low)
    if high is not None:
        bounds.append(F.col(field) <= high)
    return all_of(*bounds)


def exists(field: str, is_text: bool = True) -> Column:
    """The field has a value; empty text counts as none."""
    present = F.col(field).isNotNull()
    return present & (F.col(field) != "") if is_text else present


def missing(field: str, is_text: bool = True) -> Column:
    """The opposite of :func:`exists`."""
    absent = F.col(field).isNull()
    return absent | (F.col(field) == "") if is_text else absent


def has_all_values(field: str, values: Sequence) -> Column:
    """A list field holds every one of the values."""
    return all_of(*(F.array_contains(F.col(field), F.lit(v)) for v in values))


def excludes(field: str, values: Sequence) -> Column:
    """None of the values; rows without a value stay."""
    return negate(F.col(field).isin(list(values))) if values else match_all()


def in_box(point: str, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """A ``"lat,lon"`` field lies in the box between two corners, edges included."""
    lat, lon = latitude(F.col(point)), longitude(F.col(point))
    return lat.between(low[0], high[0]) & lon.between(low[1], high[1])


@dataclass(frozen=True)
class Query:
    """A named predicate; ``pinned`` is the user's mark."""

    name: str
    predicate: Column
    pinned: bool = False


def choose(
    queries: Sequence[Query],
    mode: Literal["all", "pinned", "unpinned", "selected"] = "all",
    names: Sequence[str] = (),
) -> list[Query]:
    """The queries a panel works on."""
    if mode == "all":
        return list(queries)
    if mode == "selected":
        return [q for q in queries if q.name in set(names)]
    return [q for q in queries if q.pinned == (mode == "pinned")]


def any_query(queries: Sequence[Query]) -> Column:
    """A row that at least one of the queries matches."""
    return any_of(*(q.predicate for q in queries)) if queries else match_all()


def flags(queries: Sequence[Query]) -> list[Column]:
    """Per query, whether a row matches it, among rows that :func:`any_query` let pass."""
    if len(queries) == 1:
        return [F.lit(True)]
    return [F.coalesce(q.predicate, F.lit(False)) for q in queries]


@dataclass(frozen=True)
class Filter:
    """A predicate with its mandate; inactive filters do nothing."""

    predicate: Column
    mandate: Literal["must", "mustNot", "either"] = "must"
    active: bool = True


def combine(filters: Sequence[Filter]) -> Column:
    """Every ``must``, no ``mustNot`` and, if there are any, one ``either``."""
    live = [f for f in filters if f.active]
    parts = [f.predicate for f in live if f.mandate == "must"]
    parts += [negate(f.predicate) for f in live if f.mandate == "mustNot"]
    either = [f.predicate for f in live if f.mandate == "either"]
    if either:
        parts.append(any_of(*either))
    return all_of(*parts)


def keep(df: DataFrame, where: Column | None) -> DataFrame:
    """``df`` with the optional extra predicate every operator accepts."""
    return df if where is None else df.where(where)
