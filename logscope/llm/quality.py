"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every measure is an expression over the words or lines of one row, so the rules need no
shuffle, no Python and no state beyond a row.

Defined results: a null or empty text has no words and fails; repeated rows are judged
alike; an empty table gives an empty table; further columns of the input are passed by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import SPACES, words

#: Frequent function words of the languages in the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be this have from or by not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a bound of ``None`` is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. A measure that a text has not (no words, no lines) breaks no rule.
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.005, None),
    Rule("digits", "digit_ratio", None, 0.5),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.3),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5),
)


def _placed(hashes: Column) -> Column:
    """The windows' hashes with their positions, sorted; empty where no hash repeats."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(empty)


def measured(docs: DataFrame, text: str = "text",
             stop_words: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with one struct column ``_m`` of counts and ratios.

    Windows of five words are compared by a 64-bit hash within one text.
    """
    given = set(stop_words if stop_words is not None else sum(STOP_WORDS.values(), []))
    stop = sorted(given | {w.capitalize() for w in given})
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        F.struct("*").alias("_row"), body.alias("_text"), words(body).alias("_words"),
        F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
    )
    step = step.withColumn("_marks", F.transform("_words", lambda w: F.xxhash64(w)))
    # The size keeps the optimiser from computing the marks anew in every window.
    n = F.size("_marks")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    step = step.withColumn("_hashes", F.transform(at, lambda i: F.xxhash64(
        F.slice(F.col("_marks"), i + 1, WINDOW))))
    step = step.withColumn("_placed", _placed(F.col("_hashes")))
    again = F.filter(F.col("_placed"), lambda x, i: F.coalesce(
        (x["h"] == F.get(F.col("_placed"), i - 1)["h"]), F.lit(False)) | F.coalesce(
        (x["h"] == F.get(F.col("_placed"), i + 1)["h"]), F.lit(False)))
    step = step.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["p"])))
    covered = F.aggregate(F.transform(F.col("_starts"), lambda x, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    chars = F.length(F.array_join("_words", ""))
    symbols = F.length(F.regexp_replace("_text", "[^#*$%&|<>]", ""))
    lines = F.size("_lines")
    share = lambda some, of: F.when(of > 0, some / of)
    step = step.select("_row", F.struct(
        n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), lines.cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).alias("n_stop"),
        F.length(F.regexp_replace("_text", "[^0-9]+", "")).alias("n_digits"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).alias("n_bullets"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))).alias("n_dots"),
    ).alias("_m"))
    m = F.col("_m")
    return step.withColumn("_m", F.struct(
        "_m.*", share(m["word_chars"], m["n_words"]).alias("mean_word_length"),
        share(m["n_symbols"], m["word_chars"]).alias("symbol_ratio"),
        share(m["n_stop"], m["n_words"]).alias("stop_word_ratio"),
        share(m["n_digits"], m["word_chars"]).alias("digit_ratio"),
        share(m["n_dup_lines"], m["n_lines"]).alias("duplicate_line_ratio"),
        share(m["n_bullets"], m["n_lines"]).alias("bullet_line_ratio"),
        share(m["n_dots"], m["n_lines"]).alias("ellipsis_line_ratio"),
    ))


def broken(rule: Rule, measures: Column) -> Column:
    """Whether a row breaks ``rule``; a missing measure breaks none."""
    value, tests = measures[rule.measure], []
    if rule.low is not None:
        tests.append(value < rule.low)
    if rule.high is not None:
        tests.append(value > rule.high)
    if not tests:
        raise ValueError(f"rule without a bound: {rule.name}")
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return F.coalesce(test, F.lit(False))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
           least_words: int = 10, most_repeated: float = 0.2) -> DataFrame:
    """A struct ``row`` of the input, the ``measures``, ``base_failed`` and the ``broken`` rules."""
    found = measured(docs, text)
    m = F.col("_m")
    failed = (m["n_words"] < least_words) | (
        100 * m["n_repeat_words"] > round(100 * most_repeated) * m["n_words"])
    names = F.array(*[F.when(broken(r, m), F.lit(r.name)) for r in rules])
    return found.select(
        F.col("_row").alias("row"), m.alias("measures"), failed.alias("base_failed"),
        F.filter(names, lambda x: x.isNotNull()).alias("broken"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = F.col("measures")
    return judged(docs).select(
        F.col("row.doc_id").alias("doc_id"), m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def _listed(names: Sequence[str]) -> str:
    return ", ".join(f"'{n}'" for n in sorted(names))


_STOP = {w for words_ in STOP_WORDS.values() for w in words_}

OP1_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), windows AS (
  SELECT doc_id, i AS p, array_to_string(w[i:i + 4], ' ') AS words
  FROM t, unnest(range(1, len(w) - 3)) AS r(i)
), again AS (
  SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1
), steps AS (
  SELECT doc_id, least(5, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 5)) AS n FROM again
), covered AS (SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: x IN ({_listed(_STOP | {w.capitalize() for w in _STOP})}))) AS n_stop,
    length(regexp_replace(body, '[^0-9]', '', 'g')) AS n_digits,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_dots
  FROM t LEFT JOIN covered USING (doc_id)
), r AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(word_chars, 0) AS symbol_ratio,
    n_stop / nullif(n_words, 0) AS stop_word_ratio, n_digits / nullif(word_chars, 0) AS digit_ratio,
    n_dup_lines / nullif(n_lines, 0) AS duplicate_line_ratio, n_bullets / nullif(n_lines, 0) AS bullet_line_ratio,
    n_dots / nullif(n_lines, 0) AS ellipsis_line_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed {" ".join(
      f"AND coalesce({r.measure} {sign} {bound}, true)" for r in RULES
      for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)} AS kept
FROM r
"""
