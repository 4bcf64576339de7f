"""Text analysis, highlighting and escaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Naming the common characters first spares most of them the look-up of their class.
_BREAK = r"[^a-z0-9\p{L}\p{N}]+"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

# Patterns of the three kinds of link.
LINK_PATTERNS = {
    "url": r"(?i)\b(?:https?|ftp)://[-A-Z0-9+&@#/%?=~_|!:,.;]*[-A-Z0-9+&@#/%=~_|*]",
    "host": r"(?i)(?:^|[^/])(www\.\S+)\b",
    "mail": r"[a-zA-Z_0-9.]+@[a-zA-Z_0-9.]+",
}

# The five XML entities; the ampersand goes first.
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def words(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case word list without stop words, in text order."""
    parts = F.array_remove(F.split(F.lower(text), _BREAK), "")
    if not stop_words:
        return parts
    drop = sorted({w.lower() for w in stop_words})
    return F.filter(parts, lambda w: ~w.isin(drop))


def distinct_words(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """The different words of :func:`words`."""
    drop = ["", *sorted({w.lower() for w in stop_words})]
    return F.array_except(F.split(F.lower(text), _BREAK), F.array(*(F.lit(w) for w in drop)))


def phrase_pattern(phrase: Sequence[str], stop_words: Sequence[str] = ()) -> str:
    """A pattern for words next to each other in lower-case text; stop words between do not count."""
    gap = _BREAK
    if stop_words:
        dropped = "|".join(re.escape(w) for w in sorted({w.lower() for w in stop_words}))
        gap = f"{_BREAK}(?:(?:{dropped}){_BREAK})*"
    return _NO_WORD_BEFORE + gap.join(re.escape(w) for w in phrase) + _NO_WORD_AFTER


def query_words(text: str, stop_words: Sequence[str] = ()) -> list[str]:
    """Query text analysed as :func:`words` analyses a column."""
    drop = {w.lower() for w in stop_words}
    return [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in drop]


def expand_synonyms(word: str, synonyms: Mapping[str, Sequence[str]]) -> list[str]:
    """A query word with its synonyms, lower case, in a stable order."""
    return sorted({word.lower(), *(s.lower() for s in synonyms.get(word.lower(), ()))})


def highlight(
    text: Column, terms: Sequence[str], before: str = "<em>", after: str = "</em>"
) -> Column:
    """Wrap each whole-word match, whatever its case; without terms the text as it is."""
    if not any(terms):
        return text
    choices = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    pattern = f"(?i){_NO_WORD_BEFORE}({choices}){_NO_WORD_AFTER}"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")


def snippet(text: Column, length: int, columns: int = 1) -> Column:
    """Text cut to ``length / columns`` characters plus three dots; null becomes ``""``."""
    keep = length // columns
    cut = F.when(F.char_length(text) > keep, F.concat(F.left(text, F.lit(keep)), F.lit("...")))
    return F.coalesce(cut, text, F.lit(""))


def links(text: Column, kind: str) -> Column:
    """All links of one kind in a text, in text order."""
    group, sign = (1, "www.") if kind == "host" else (0, "://" if kind == "url" else "@")
    found = F.regexp_extract_all(text, F.lit(LINK_PATTERNS[kind]), F.lit(group))
    # Most texts hold none; a plain search tells so before the pattern has to.
    possible = F.contains(F.lower(text) if kind == "host" else text, F.lit(sign))
    return F.when(possible, found).when(text.isNotNull(), F.array().cast("array<string>"))


def xml_escape(text: Column) -> Column:
    """Text with the five XML entities escaped; null becomes ``""``."""
    text = F.coalesce(text, F.lit(""))
    for plain, entity in XML_ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def csv_quote(text: Column) -> Column:
    """Text in double quotes when it holds a comma; null becomes ``""``."""
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.contains(text, F.lit(",")), quoted).otherwise(text)


def shard_number(label: Column) -> Column:
    """The number in a label that ends in ``_shardN``; null without one."""
    return F.regexp_extract(label, r"_shard(\d+)$", 1).try_cast("int")


def row_json(*columns: str) -> Column:
    """The named columns of a row as JSON text."""
    return F.to_json(F.struct(*columns))
