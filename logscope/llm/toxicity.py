"""Toxicity by a lexicon that is learnt, matched with misspellings and weighed in context.

Words and word stems that labelled toxic documents hold and others do not make up a trie.
Each distinct word of a text is run through the trie together with its Levenshtein
automaton, so a term with a typing error still counts, though less. Around each hit a
window is read for quotation marks and words of reporting: quoted hits and abusive ones are
separate inputs of a logistic regression.

A term counts by its weight: how much commoner it is in toxic rows, shrunk where chance
could explain it. No share of all rows is asked for, so the marker of a language or source
with few rows takes part as soon as its own rows bear it out.

Learning takes at most ``SAMPLE`` labelled rows, chosen by a hash of their id; everything
else reads all rows. Defined results: a null or empty text has no hits and the score of a
text without hits; a null ``doc_id`` is never held out; several labels of one id count as
the highest; without labels of both kinds every score is 0; rows that share a ``doc_id``
are scored each by itself.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import importable, written

#: The labelled rows learnt from; everything learnt is bounded by their texts.
SAMPLE = 20_000
#: Toxic rows that must hold a term; the ratio of uses up to which it is none, since whole
#: languages or sources may differ by that with all their words; the ratio that weighs 1.
LEAST = 5
NO_RATIO, FULL_RATIO = 3, 50
WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
STEMS = (4, 5, 6, 7)
#: Words that announce a quotation or a report, and how far around a hit they count.
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes word term reported insult insults "
    "sagte schrieb nannte zitat wort begriff dijo escribió llamó cita palabra dit écrit appelé "
    "citation mot".split())
REACH = 60
_OPEN = re.compile("[\"“«„][^\"”»]*$")
_CLOSE = re.compile("^[^\"“«]*[\"”»]")
_REMEMBERED = 200_000


def _one_less(word: str) -> list[str]:
    return [word[:i] + word[i + 1:] for i in range(len(word))]


class _Remembered(dict):
    """Values of ``work``, kept for the keys met lately: at most ``_REMEMBERED`` twice over."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        if len(self) >= _REMEMBERED:
            # What is met again comes back from the older half.
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


@dataclass
class Lexicon:
    """Terms in a trie; a term ending in ``*`` is a stem, open to any ending."""

    terms: frozenset[str]
    #: Misspelt forms that clean documents hold: words of their own, so no hits.
    own_words: frozenset[str] = frozenset()
    errors: int = 1
    #: Weights of terms, up to 1; terms without one weigh 1. Only those of 1 match with errors.
    strength: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._forget()
        self.trie: dict = {}
        self.firm: dict = {}
        self.longest = 0
        # Strong terms and what is left of them without one of their letters.
        self.near_words: set[str] = set()
        self.near_stems: set[str] = set()
        self.stem_sizes: set[int] = set()
        # Both halves of strong words, by the size of the word: one error leaves one half whole.
        self.halves: dict[int, tuple[set[str], set[str]]] = {}
        for term in self.terms:
            word, strength = term.rstrip("*"), self.strength.get(term, 1.0)
            for trie in (self.trie, self.firm) if strength >= 1 else (self.trie,):
                node = trie
                for c in word:
                    node = node.setdefault(c, {})
                node["*" if term.endswith("*") else "."] = strength
            if strength >= 1:
                self.longest = max(self.longest, len(word))
            if len(word) > 4 and strength >= 1:
                held = self.near_stems if term.endswith("*") else self.near_words
                held.update((word, *_one_less(word)))
                if term.endswith("*"):
                    self.stem_sizes.update(range(len(word) - 1, len(word) + 2))
                else:
                    begins, ends = self.halves.setdefault(len(word), (set(), set()))
                    begins.add(word[:len(word) // 2])
                    ends.add(word[len(word) // 2:])

    def _forget(self) -> None:
        self._memory = _Remembered(self._weigh)
        self._begun = _Remembered(lambda begin: self._meets(begin, self.near_stems))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_memory", "_begun")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def weight(self, word: str) -> float:
        """A term's strength (1 if none is given), less for a term with errors, 0 for any other word."""
        return self._memory[word]

    def _weigh(self, word: str) -> float:
        exact = self._exact(word)
        # A weak stem must not hide a strong term with an error.
        return exact if exact >= 0.6 else max(exact, self._misspelt(word))

    def _misspelt(self, word: str) -> float:
        if word in self.own_words or not self._near(word):
            return 0.0
        found = self._distance(word)
        return 0.0 if found is None else 1.0 - 0.4 * found

    def is_misspelt(self, word: str) -> bool:
        """Whether a word counts, or counts more, as a term with errors."""
        exact = self._exact(word)
        return exact < 0.6 and self._misspelt(word) > exact

    def _exact(self, word: str) -> float:
        """The strongest of the word and its stems, 0 if none is a term."""
        node, best = self.trie, 0.0
        for c in word:
            best = max(best, node.get("*", 0.0))
            node = node.get(c)
            if node is None:
                return best
        return max(best, node.get(".", 0.0), node.get("*", 0.0))

    def _near(self, word: str) -> bool:
        """With one error, the word or the term, or both, lose one letter and are the same.

        Of a stem the word's beginning is compared. What passes is measured by the automaton.
        """
        if self.errors != 1:
            return self.errors > 0
        if self._half(word) and self._meets(word, self.near_words):
            return True
        # Words share their beginnings, so few of those are new.
        return any(self._begun[word[:n]] for n in self.stem_sizes if n <= len(word))

    def _half(self, word: str) -> bool:
        """Whether a word begins or ends like half of a strong word of about its size."""
        for size in (len(word) - 1, len(word), len(word) + 1):
            held = self.halves.get(size)
            if held and (word[:size // 2] in held[0] or word[size // 2 - size:] in held[1]):
                return True
        return False

    @staticmethod
    def _meets(word: str, held: set[str]) -> bool:
        return word in held or any(x in held for x in _one_less(word))

    def _distance(self, word: str) -> int | None:
        """Least errors to a term of five letters or more: rows of the automaton along the trie."""
        # Letters further on could only be the open ending of a stem.
        word = word[:self.longest + self.errors + 1]
        errors, size, best = self.errors, len(word), self.errors + 1
        # Cells further than ``errors`` from the diagonal cost more than that: a row holds a band,
        # whose cell i stands for the first depth - errors + i letters of the word.
        band = 2 * errors + 1
        stack = [(self.firm, [max(0, i - errors) if i >= errors and i - errors <= size else best
                              for i in range(band)], 0)]
        while stack:
            node, row, depth = stack.pop()
            if depth > 4:
                if "." in node and 0 <= size - depth + errors < band:
                    best = min(best, row[size - depth + errors])
                if "*" in node:
                    best = min(best, min(row))
            for c, child in node.items():
                if len(c) != 1 or c in ".*":
                    continue
                new, left, least = [], errors + 1, errors + 1
                for i in range(band):
                    j, cell = depth + 1 - errors + i, errors + 1
                    if 0 <= j <= size:
                        if i + 1 < band and row[i + 1] < cell:
                            cell = row[i + 1] + 1
                        if left < cell:
                            cell = left + 1
                        if j and row[i] + (word[j - 1] != c) < cell:
                            cell = row[i] + (word[j - 1] != c)
                    new.append(cell)
                    left = cell
                    if cell < least:
                        least = cell
                if least < best:
                    stack.append((child, new, depth + 1))
        return best if best <= self.errors else None

    def features(self, text: str) -> tuple[float, float, float]:
        """Weights of abusive hits and of quoted hits, and the abusive share of the words."""
        low = text.lower()
        words = WORD.findall(low)
        memory = self._memory
        hits = {w for w in set(words) if memory[w]}
        if not hits:
            return 0.0, 0.0, 0.0
        abuse = quoted = 0.0
        for m in WORD.finditer(low):
            if m.group() in hits:
                if self._is_quoted(low, m.start(), m.end()):
                    quoted += self.weight(m.group())
                else:
                    abuse += self.weight(m.group())
        return math.log1p(abuse), math.log1p(quoted), min(1.0, 10 * abuse / len(words))

    @staticmethod
    def _is_quoted(text: str, start: int, end: int) -> bool:
        before, after = text[max(0, start - REACH):start], text[end:end + REACH]
        if _OPEN.search(before) and _CLOSE.search(after):
            return True
        near = WORD.findall(before.rsplit(".", 1)[-1])[-4:]
        return not REPORTING.isdisjoint(near)


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...] | None

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = (1.0, *self.lexicon.features(text or ""))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, sum(
            a * b for a, b in zip(x, self.weights, strict=True))))))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                  sample: int = SAMPLE) -> DataFrame:
    """``(text, toxic)`` of at most about ``sample`` labelled rows that are not held out."""
    own = labels.select(labels[key].alias("label_key"), labels[label].alias("toxic")).where(
        ~held_out(F.col("label_key")) & F.col("toxic").isNotNull()).groupBy("label_key").agg(
        F.max("toxic").alias("toxic"))
    n = own.count()
    if n > sample:
        own = own.where(F.shiftrightunsigned(F.xxhash64("label_key"), 1) < (1 << 63) * sample // n)
    # At most about ``sample`` ids of a few bytes each are broadcast.
    rows = docs.select(docs[key].alias("doc_key"), docs[text].alias("text"))
    return rows.join(F.broadcast(own), F.col("doc_key") == F.col("label_key")).select(
        "text", (F.col("toxic") > 0).cast("int").alias("toxic")).dropDuplicates()


def _stems(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def learnt_terms(rows: DataFrame) -> dict[str, float]:
    """Words and stems that toxic documents hold more often than others, with their weights."""

    def counted(own: DataFrame, among: frozenset[str] | None) -> DataFrame:
        """``(term, n, uses)``: texts that hold a term, and its uses; the empty term: all texts."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, uses = Counter(), Counter()
            terms_of = _Remembered(lambda w: tuple(t for t in _stems(w) if among is None or t in among))
            for batch in batches:
                for body in batch["text"]:
                    found: Counter = Counter()
                    for w, n in Counter(WORD.findall((body or "").lower())).items():
                        for t in terms_of[w]:
                            found[t] += n
                    uses.update(found)
                    counts.update(found.keys())
                    counts[""] += 1
            terms, sizes = np.array(list(counts), object), list(counts.values())
            for at in range(0, len(terms), 50_000):
                some = terms[at:at + 50_000]
                yield pd.DataFrame({"term": some, "n": sizes[at:at + 50_000], "uses": [uses[t] for t in some]})

        return own.mapInPandas(run, "term string, n bigint, uses bigint").groupBy("term").agg(
            F.sum("n").alias("n"), F.sum("uses").alias("uses"))

    toxic = counted(rows.where("toxic = 1"), None)
    total = toxic.where("term = ''").first()
    if total is None:
        return {}
    # The texts of the sample bound these: about a hundred thousand.
    often = {r["term"]: (r["n"], r["uses"])
             for r in toxic.where((F.col("n") >= LEAST) & (F.col("term") != "")).collect()}
    clean = {r["term"]: (r["n"], r["uses"]) for r in counted(
        rows.where("toxic = 0"), frozenset(often)).collect()}
    if not clean or not often:
        return {}
    support = {t: n for t, (n, _) in often.items()}
    found = {t: strength(often[t], total["n"], clean.get(t, (0, 0)), clean[""][0], len(often)) for t in often}
    found = {t: v for t, v in found.items() if v[0] > 0}
    kept = chosen({t: support[t] for t in found}, {t: v[0] for t, v in found.items()})
    return {t: found[t][0] for t in sorted(kept)}


def strength(toxic: tuple[int, int], all_toxic: int, clean: tuple[int, int], all_clean: int,
             among: int) -> tuple[float, float]:
    """Weight and evidence of a term, from the texts that hold it and its uses in them.

    The weight is the logarithm of the ratio of uses a text, 1 from ``FULL_RATIO`` on and 0 up
    to ``NO_RATIO``. It is shrunk by the evidence (a likelihood ratio of texts) that the best
    of ``among`` terms reaches by chance.
    """
    (a, uses), (b, clean_uses) = toxic, clean
    p, ratio = (a + b) / (all_toxic + all_clean), (uses + 0.5) * all_clean / (clean_uses + 0.5) / all_toxic
    if p >= 1 or a * all_clean <= b * all_toxic or ratio <= NO_RATIO:
        return 0.0, 0.0

    def likelihood(n: int, of: int) -> float:
        return (n and n * math.log(n / of / p)) + (of - n and (of - n) * math.log((1 - n / of) / (1 - p)))

    evidence = 2 * (likelihood(a, all_toxic) + likelihood(b, all_clean))
    shrunk = max(0.0, 1 - 2 * math.log(max(2, among)) / evidence) if evidence > 0 else 0.0
    return min(1.0, shrunk * math.log(ratio) / math.log(FULL_RATIO)), evidence


def chosen(support: dict[str, int], weights: dict[str, float] | None = None) -> frozenset[str]:
    """Of a word and its stems, the longest that is hardly rarer than the shortest.

    A term gives way only to one of at least half its weight.
    """
    kept, weights, ordered = set(), weights or {}, sorted(support)

    def stands_for(other: str, term: str) -> bool:
        return weights.get(other, 1.0) >= 0.5 * weights.get(term, 1.0)

    for term in support:
        word = term.rstrip("*")
        shorter = [s for s in _stems(word) if s != term and s in support and len(s) <= len(term)
                   and s.endswith("*") and stands_for(s, term)]
        base = max([support[s] for s in shorter], default=support[term])
        size = len(word) + (not term.endswith("*"))
        longer = False
        for t in ordered[bisect_left(ordered, word):] if term.endswith("*") else ():
            if not t.startswith(word):
                break
            longer = longer or (t != term and len(t.rstrip("*")) + (not t.endswith("*")) > size
                                and support[t] >= 0.9 * support[term] and stands_for(t, term))
        if support[term] >= 0.9 * base and not longer:
            kept.add(term)
    return frozenset(kept)


def fitted(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the first weight, of the constant, is free."""
    x = np.column_stack([np.ones(len(features)), features])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [penalty] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge,
                               x.T @ (p - labels) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learnt(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
           label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights, from labelled rows that are not held out."""
    importable(docs.sparkSession)
    # Written, so that the documents are read once for it, however often it is used.
    rows = written(training_rows(docs, labels, key, text, label, sample), "labelled")
    terms = learnt_terms(rows)
    if not terms:
        return Model(Lexicon(frozenset()), None)
    rough = Lexicon(frozenset(terms), strength=terms)

    def misspelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[str] = set()
        for batch in batches:
            for body in batch["text"]:
                new = set(WORD.findall((body or "").lower())) - met
                # Words met before in this task are not looked at again.
                met = new if len(met) >= _REMEMBERED else met | new
                found = [w for w in new if rough.is_misspelt(w)]
                if found:
                    yield pd.DataFrame({"word": found})

    own = rows.where("toxic = 0").mapInPandas(misspelt, "word string").distinct()
    lexicon = Lexicon(frozenset(terms), frozenset(r["word"] for r in own.collect()),
                      strength=terms)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([lexicon.features(b or "") for b in batch["text"]],
                                 columns=["abuse", "quoted", "share"], dtype=float)
            yield found.assign(toxic=batch["toxic"].to_numpy())

    # One row for each combination of measures: as many as the sample at most.
    table = rows.mapInPandas(measure, "abuse double, quoted double, share double, toxic int").toPandas()
    return Model(lexicon, fitted(table[["abuse", "quoted", "share"]].to_numpy(),
                                 table["toxic"].to_numpy().astype(float)))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (a struct of the input) and ``score``."""
    importable(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(text)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[model.score(b) for b in batch[body]])

    types = ", ".join(f"{n} {f.dataType.simpleString()}"
                      for n, f in zip(names, docs.schema, strict=True))
    row = F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    return docs.toDF(*names).mapInPandas(run, f"{types}, score double").select(
        row.alias("row"), "score")


def op8(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    key = F.col("row.doc_id")
    return scored(docs, learnt(docs, labels)).select(
        key.alias("doc_id"), held_out(key).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
