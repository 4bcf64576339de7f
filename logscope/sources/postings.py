"""A positional inverted index over text fields.

Each row of the index is a posting: a field, a token, the key of a row whose field holds the
token, and the places where it does. Postings lie in folders by field and by a checksum of
the token, sorted by token and key, so a search opens only the folders of its own tokens and
skips row groups without them. The text is not read again.

A phrase is found by shifting each token's places back by its place in the phrase: where the
shifted lists meet, the phrase begins. Searches return keys; join them to fetch rows.

Keys must be unique and without nulls; rows that share a key are searched as one. The list of
a row and token is made inside the row, so only whole lists are shuffled, once. A folder with
much in it, such as that of a token that most rows hold, is split over several files and tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logscope.functions.text import expand_synonyms, query_words, words

BUCKETS = 64


def _bucket(token: Column, buckets: int) -> Column:
    return (F.crc32(token.cast("binary")) % buckets).cast("int")


def _token_lists(pairs: str, starts: str) -> Column:
    """``(token, places)`` of a row, from its sorted pairs and where each token's run of them starts."""

    def place(at: Column) -> Column:
        return F.get(pairs, at).getField("place")

    def one(start: Column, i: Column) -> Column:
        last = F.coalesce(F.get(starts, i + 1), F.size(pairs)) - 1
        # Most tokens of a row come once.
        places = F.when(start == last, F.array(place(start))).otherwise(
            F.transform(F.sequence(start, last), place))
        return F.struct(F.get(pairs, start).getField("token").alias("token"), places.alias("places"))

    return F.transform(starts, one)


def _keyed(key: Sequence[str], day: str | None) -> list[Column]:
    return [(F.col(day).cast("string") if day else F.lit("")).alias("day"),
            *(F.col(k).alias(f"key{i}") for i, k in enumerate(key))]


def postings_of(
    df: DataFrame, key: Sequence[str], fields: Sequence[str], buckets: int = BUCKETS,
    stop_words: Sequence[str] = (), day: str | None = None,
) -> DataFrame:
    """``(day, field, bucket, token, key0 …, places)`` in the order they are written in."""
    ids = [f"key{i}" for i in range(len(key))]
    texts = F.array(*(F.struct(F.lit(f).alias("field"), words(F.col(f), stop_words).alias("tokens"))
                      for f in fields))
    pairs = df.select(*_keyed(key, day), F.inline(texts)).withColumn("pairs", F.sort_array(F.transform(
        "tokens", lambda t, i: F.struct(t.alias("token"), i.alias("place")))))
    starts = pairs.withColumn("starts", F.array_compact(F.transform("pairs", lambda x, i: F.when(
        ~x.getField("token").eqNullSafe(F.get("pairs", i - 1).getField("token")), i))))
    lists = starts.select("day", *ids, "field", F.inline(_token_lists("pairs", "starts")))
    # Adaptive execution splits and merges the folders, so what a task sorts fits its memory.
    folder = ["day", "field", "bucket"]
    return lists.withColumn("bucket", _bucket(F.col("token"), buckets)).hint(
        "rebalance", *(F.col(c) for c in folder)).select(
            *folder, "token", *ids, "places").sortWithinPartitions(*folder, "token", *ids)


def write_index(
    df: DataFrame, path: str, key: Sequence[str], fields: Sequence[str], buckets: int = BUCKETS,
    stop_words: Sequence[str] = (), day: str | None = None, mode: str = "errorifexists",
) -> None:
    """Write the index of text fields; with ``day`` its folders are also by that column.

    ``append`` adds the postings of new rows to an index made with the same options.
    """
    df.select(*_keyed(key, day)).write.mode(mode).partitionBy("day").parquet(f"{path}/rows")
    postings_of(df, key, fields, buckets, stop_words, day).write.mode(mode).partitionBy(
        "day", "field", "bucket").parquet(f"{path}/postings")
    options = df.sparkSession.createDataFrame(
        [(list(fields), buckets, list(stop_words))], "fields array<string>, buckets int, stop_words array<string>")
    options.coalesce(1).write.mode("overwrite").json(f"{path}/options")


@dataclass(frozen=True)
class TextIndex:
    """Searches over a written index; every one returns the keys of the rows found."""

    spark: SparkSession
    path: str
    key: tuple[T.StructField, ...]
    fields: tuple[str, ...]
    buckets: int
    stop_words: tuple[str, ...]
    days: tuple[str, str] | None = None

    @property
    def _ids(self) -> list[str]:
        return [f"key{i}" for i in range(len(self.key))]

    def _id_fields(self) -> list[T.StructField]:
        return [T.StructField(i, k.dataType) for i, k in zip(self._ids, self.key, strict=True)]

    def _of_days(self, rows: DataFrame) -> DataFrame:
        return rows if self.days is None else rows.where(F.col("day").between(*self.days))

    def _named(self, found: DataFrame) -> DataFrame:
        return found.select(*(F.col(i).alias(k.name) for i, k in zip(self._ids, self.key, strict=True)))

    def rows(self) -> DataFrame:
        """The keys of all rows."""
        schema = T.StructType([*self._id_fields(), T.StructField("day", T.StringType())])
        return self._named(self._of_days(self.spark.read.schema(schema).parquet(f"{self.path}/rows")))

    def postings(self, fields: Sequence[str], tokens: Sequence[str]) -> DataFrame:
        """``(day, field, token, key0 …, places)``: only the folders of these tokens are opened."""
        schema = T.StructType([
            T.StructField("token", T.StringType()), *self._id_fields(),
            T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("day", T.StringType()),
            T.StructField("field", T.StringType()), T.StructField("bucket", T.IntegerType())])
        unknown = set(fields) - set(self.fields)
        if unknown:
            raise ValueError(f"fields without an index: {sorted(unknown)}")
        numbers = sorted({zlib.crc32(t.encode()) % self.buckets for t in tokens})
        found = self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(
            F.col("field").isin(list(fields)) & F.col("bucket").isin(numbers)
            & F.col("token").isin(sorted(set(tokens))))
        return self._of_days(found)

    def all_words(self, field: str, text: str) -> DataFrame:
        """Rows whose field holds every word."""
        return self.any_field_word([field], text)

    def any_field_word(self, fields: Sequence[str], text: str) -> DataFrame:
        """Rows of which each word is held by at least one of the fields."""
        wanted = sorted(set(query_words(text, self.stop_words)))
        if not wanted:
            return self.rows()
        # A token can come from several fields, or from several rows of a key.
        held = [F.bool_or(F.col("token") == w).alias(f"held{i}") for i, w in enumerate(wanted)]
        found = self.postings(fields, wanted).groupBy(*self._ids).agg(*held)
        return self._named(found.where(reduce(Column.__and__, [F.col(f"held{i}") for i in range(len(wanted))])))

    def phrase(self, field: str, text: str) -> DataFrame:
        """Rows whose field holds these words next to each other, in this order."""
        return self._named(self._phrase(field, query_words(text, self.stop_words)))

    def _phrase(self, field: str, wanted: Sequence[str]) -> DataFrame:
        if not wanted:
            return self.rows().toDF(*self._ids)
        tokens = sorted(set(wanted))
        held = self.postings([field], tokens)
        if len(wanted) == 1:
            return held.select("day", *self._ids).distinct().select(*self._ids)
        # Rows that share a key add up their places.
        lists = held.groupBy(*self._ids).agg(F.collect_list(F.struct("token", "places")).alias("lists"))

        def begins(i: int) -> Column:
            own = F.filter("lists", lambda x: x.getField("token") == wanted[i])
            return F.transform(F.flatten(F.transform(own, lambda x: x.getField("places"))), lambda x: x - i)

        met = reduce(F.array_intersect, [begins(i) for i in range(len(wanted))])
        return lists.where(F.size(met) > 0).select(*self._ids)

    def words_or_synonyms(self, field: str, text: str, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
        """Rows that hold every word or one of its synonyms, which may be phrases."""
        groups = [[query_words(c, self.stop_words) for c in expand_synonyms(w, synonyms)]
                  for w in query_words(text, self.stop_words)]
        if not groups:
            return self.rows()
        found = reduce(DataFrame.unionByName, [
            self._phrase(field, choice).withColumn("word", F.lit(i))
            for i, choices in enumerate(groups) for choice in choices if choice])
        return self._named(found.distinct().groupBy(*self._ids).agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") == len(groups)))


def open_index(spark: SparkSession, path: str, key: Sequence[T.StructField],
               days: tuple[str, str] | None = None) -> TextIndex:
    """A written index; ``key`` are the fields of its key, ``days`` the first and last day to search."""
    options = spark.read.schema("fields array<string>, buckets int, stop_words array<string>").json(
        f"{path}/options").first()
    return TextIndex(spark, path, tuple(key), tuple(options.fields), options.buckets,
                     tuple(options.stop_words), days)
