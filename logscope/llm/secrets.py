"""Secret scans through a trigram index, with built-in functions only.

From each rule's regular expression, parsed, comes a Boolean trigram query: an OR over the
ways a match can be spelt, each an AND of the trigrams it must hold. The index
lists, for each trigram of any query, the documents that hold it. Intersecting these
postings leaves candidates, and only they are searched with the expression itself. A rule
without mandatory trigrams searches every text.

Spans come from running sums over the matches of a text, taken a square root of them at a
time, so a text with very many matches costs little more than their number.

Defined results: a null or empty text has no spans; rows that share a ``doc_id`` share
postings, which can only add candidates, and are then searched each by itself; null ids
join as one id; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """An expression, the group whose length counts (0: the match) and the least length."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    # The method's own kinds.
    Rule("private", r"-----BEGIN[\x20A-Z]*PRIVATE\x20KEY-----", 0, 1, False),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 20, False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 36, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", 0, 30, False),
)

#: Ways to spell a match that are told apart; beyond them trigrams across the place are given up.
_WAYS = 64


#: What is known of one way to spell the part of a match read so far: the trigrams it holds
#: and its last two characters (fewer after a place where anything may stand).
Way = tuple[frozenset[str], str]


def _read(way: Way, c: str) -> Way:
    held, tail = way
    seen = tail + c.lower()
    return (held | {seen} if len(seen) == 3 else held), seen[-2:]


def _anything(ways: set[Way]) -> set[Way]:
    return {(held, "") for held, _ in ways}


def _few(ways: set[Way]) -> set[Way]:
    """Ways that hold more than another with the same ending say nothing new."""
    if len(ways) > _WAYS:
        ways = _anything(ways)
    return {w for w in ways if not any(o[1] == w[1] and o[0] < w[0] for o in ways)}


def _ways(items: Sequence, ways: set[Way]) -> set[Way]:
    """The ways after these parsed items, from the ways before them."""
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            ways = {_read(w, chr(arg)) for w in ways}
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL and a < 128 for o, a in arg):
            ways = {_read(w, chr(a)) for w in ways for _, a in arg}
        elif op is sre.SUBPATTERN:
            ways = _ways(arg[3], ways)
        elif op is sre.BRANCH:
            ways = {w for branch in arg[1] for w in _ways(branch, ways)}
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            once = _ways(inner, ways)
            if (least, most) == (0, 1):
                ways = ways | once
            elif least == 0:
                ways = _anything(ways)
            elif (least, most) == (1, 1):
                ways = once
            else:
                ways = _anything(once)
        elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            ways = _anything(ways)
        ways = _few(ways)
    return ways


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """The rule's query, from its expression: any of these sets, whole, in lower case.

    None where some match may lack trigrams.
    """
    clauses = {held for held, _ in _ways(parser.parse(rule.pattern), {(frozenset(), "")})}
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def postings(docs: DataFrame, grams: Sequence[str], key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The inverted index: a row ``(gram, key)`` for each trigram a text holds."""
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    held = F.filter(F.array(*[F.when(F.col("low").contains(g), F.lit(i))
                              for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule], grams: Sequence[str]) -> DataFrame:
    """For each key, the numbers of the rules whose trigram query its postings meet.

    The postings of a key meet as bits of a few numbers, summed up before they are shuffled.
    """
    at = {g: i for i, g in enumerate(grams)}
    words = [f"bits{w}" for w in range(-(-len(grams) // _BITS))]
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") % _BITS).cast("int"))
    bits = index.groupBy("key").agg(*[
        F.coalesce(F.bit_or(F.when(F.floor(F.col("gram") / _BITS) == w, one)), F.lit(0).cast("long")).alias(name)
        for w, name in enumerate(words)])

    def holds(clause: frozenset[str]) -> Column:
        masks = [sum(1 << at[g] % _BITS for g in clause if at[g] // _BITS == w) for w in range(len(words))]
        return F.forall(F.array(*[F.col(n).bitwiseAND(F.lit(m)) == m
                                  for n, m in zip(words, masks, strict=True) if m]), lambda x: x)

    tests = [F.when(F.exists(F.array(*map(holds, query)), lambda x: x), F.lit(number))
             for number, rule in enumerate(rules) if (query := trigram_query(rule)) is not None]
    hit = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return bits.select("key", hit.alias("rules")).where(F.size("rules") > 0)


#: Trigrams of one number.
_BITS = 62


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is named: a list of one binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, begun: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]],
            ) -> Column:
    """The lists that ``step(state, item)`` gives beside its new state, one after the other.

    Adding to a list copies it, so lists are made for a square root of the items at a time.
    """
    none = F.array().cast(f"array<{kind}>")

    def inside(state: Column, x: Column) -> Column:
        new, made = step(state["at"], x)
        return F.struct(new.alias("at"), F.concat(state["made"], made).alias("made"))

    def across(state: Column, block: Column) -> Column:
        whole = F.aggregate(block, F.struct(state["at"].alias("at"), none.alias("made")), inside)
        return bound(whole, lambda r: F.struct(
            r["at"].alias("at"), F.concat(state["made"], F.array(r["made"])).alias("made")))

    def over(xs: Column) -> Column:
        n = F.size(xs)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        blocks = F.when(n > 0, F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
            lambda i: F.slice(xs, i * width + 1, width)))
        start = F.struct(begun.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("made"))
        return F.coalesce(F.aggregate(blocks, start, across, lambda s: F.flatten(s["made"])), none)

    return bound(items, over)


def _long_runs(rule: Rule) -> str:
    """The pattern of a rule that is one run of a class, for runs long enough only.

    A run is matched whole, so leaving out short ones moves no other match.
    """
    return f"{rule.pattern[:-1]}{{{rule.least},}}"


def spans(text: Column, number: int, rule: Rule, pattern: str) -> Column:
    """Start, rule number and end of each leftmost non-overlapping match long enough.

    The pieces between matches and the matches themselves add up to the positions.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    sizes = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(0))).alias("gap"),
                         F.transform(whole, lambda x: F.length(x)).alias("size"),
                         F.transform(part, lambda x: F.length(x)).alias("counts"))
    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + x["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return end, F.when(x["counts"] >= rule.least, span).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return running(sizes, F.lit(0), _SPAN, step)


_SPAN = "struct<start:int,rule:int,end:int>"


def scanned(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``row`` (a struct of the input) and ``spans``, sorted by start, then by rule."""
    queries = [trigram_query(r) for r in rules]
    grams = sorted({g for q in queries if q for clause in q for g in clause})
    rows = docs.select(F.struct("*").alias("row"))
    if grams:
        found = candidates(postings(docs, grams, key, text), rules, grams)
        joined = rows.join(found, F.col(f"row.{key}").eqNullSafe(F.col("key")), "left")
    else:
        joined = rows.withColumn("rules", F.array().cast("array<int>"))
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    each = []
    for number, rule in enumerate(rules):
        run = re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and rule.group == 0
        pattern = _long_runs(rule) if run else rule.pattern
        # Without mandatory trigrams every text is scanned, once, for whether there is a match.
        test = (body.rlike(pattern) if queries[number] is None
                else F.coalesce(F.array_contains("rules", number), F.lit(False)))
        each.append(F.when(test, spans(body, number, rule, pattern)).otherwise(none))
    return joined.select("row", F.sort_array(F.concat(*each)).alias("spans"))


def named(found: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = [i for i, r in enumerate(RULES) if r.base]
    found = F.col("spans")
    count = lambda i: F.size(F.filter(found, lambda x: x["rule"] == i)).cast("long")
    return scanned(docs).select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(named(F.filter(found, lambda x: x["rule"].isin(base)), RULES), 256)
        .alias("base_sha256"), named(found, RULES).alias("spans"))


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one mark.

    Pieces are cut out of blocks of the text, since a text is walked from its start to any place.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def cut(blocks: Column) -> Column:
        def piece(begin: Column, size: Column) -> Column:
            first, skipped = F.floor(begin / _BLOCK).cast("int"), begin % _BLOCK
            some = F.array_join(F.slice(blocks, first + 1, F.ceil((skipped + size) / _BLOCK).cast("int")), "")
            return F.substring(some, skipped + 1, size)

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            new = F.array(piece(at, x["start"] - at), F.lit(mark))
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, new).otherwise(
                F.array().cast("array<string>"))

        end = F.array_max(F.transform(found, lambda x: x["end"]))
        return F.concat(F.array_join(running(found, F.lit(0), "string", step), ""),
                        bound(end, lambda e: piece(e, F.length(text) - e)))

    return F.when(F.size(found) > 0, bound(blocks, cut)).otherwise(text)


#: Characters of a block.
_BLOCK = 64


def _either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, without an engine's own case folding."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_SQL_PATTERNS = {
    "assign": rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "bearer": rf"{_either_case('bearer')}\x20+([A-Za-z0-9._~+/=-]+)",
}


def _kind_sql(number: int, rule: Rule) -> str:
    pattern = _SQL_PATTERNS.get(rule.kind, rule.pattern).replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda k: {{
    'start': list_sum(list_transform(g[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0),
    'size': length(m[k]), 'counts': length(c[k])}})) AS s
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g,
    regexp_extract_all(text, '{pattern}') AS m,
    regexp_extract_all(text, '{pattern}', {rule.group}) AS c FROM documents
    WHERE regexp_matches(text, '{pattern}'))"""


OP2_SQL = f"""
WITH every AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))}
), found AS (
  SELECT doc_id, number, CAST(s.start AS BIGINT) AS start,
    kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.size AS BIGINT) AS span
  FROM every WHERE s.counts >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END
)
SELECT d.doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
  count(*) FILTER (number = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, number), '') AS spans
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""
