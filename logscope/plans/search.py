"""The search page: total, one page of rows with highlights, and facets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.text import highlight, query_words, snippet
from logscope.operators.export import check_ceiling
from logscope.operators.facets import facets, total
from logscope.operators.paging import Sort, page
from logscope.operators.predicates import all_words, keep
from logscope.sources.postings import TextIndex


@dataclass(frozen=True)
class SearchPage:
    """Three lazy results over one filtered base; :meth:`release` drops its cached rows."""

    base: DataFrame
    total: DataFrame
    rows: DataFrame
    facets: DataFrame

    def release(self) -> None:
        self.base.unpersist()


def search(
    df: DataFrame, body: str, text: str, key: Sequence[str], facet_fields: Sequence[str],
    sort: Sort = (), time: str | None = None, number: int = 0, size: int = 10,
    facet_limit: int = 10, stop_words: Sequence[str] = (), snippet_length: int | None = None,
    where: Column | None = None, cache: bool = False, ceiling: int | None = None,
    index: TextIndex | None = None,
) -> SearchPage:
    """Rows whose body holds every word of ``text``.

    With an ``index`` of the body, made with the same stop words, the rows are found by their
    keys: no text is searched, and only those of the page are read.

    Only the rows of the page are highlighted, after they are picked. With
    ``cache`` the facet fields of the matching rows are kept (memory, then disk) for
    total and facets; bodies never are. More matches than ``ceiling`` are refused.
    """
    rest = keep(df, where)
    if index is None:
        found = rest.where(all_words(body, text, stop_words))
    elif set(index.stop_words) != set(stop_words):
        raise ValueError("the index was made with other stop words")
    else:
        found = rest.join(index.all_words(body, text), list(key), "left_semi")
    fields = list(dict.fromkeys([*key, *(f for f, _ in sort), *facet_fields, body]))
    check_ceiling(found, ceiling)
    base = found.select(*dict.fromkeys([*key, *facet_fields]))
    if cache:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    if index is None:
        picked = page(found.select(*fields), sort, key, time or key[0], number, size, analysed=[body])
    else:
        slim = page(found.select(*(f for f in fields if f != body)), sort, key, time or key[0], number,
                    size, analysed=[body])
        # A page of keys is small whatever the table's size; the rest of its rows is fetched by key.
        picked = slim.join(df.select(*key, body), list(key)).select(*fields)
    shown = highlight(F.col(body), query_words(text, stop_words))
    rows = picked.withColumn("highlight", shown)
    if snippet_length is not None:
        rows = rows.withColumn("snippet", snippet(F.col(body), snippet_length))
    return SearchPage(base, total(base), rows, facets(base, facet_fields, facet_limit))
