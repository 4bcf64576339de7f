"""Line dedup with built-in functions: lines that many documents share stay in one of them.

Lines become 128-bit hashes of their keys. Their counts are summed by key and document
slice before they are range-partitioned by hash, with documents in falling order inside a
hash, so the first row of a hash names the document that keeps the line. A key holds at
most ``SLICES`` rows there, however many documents hold it. The decision goes back to the
lines by a join that adaptive execution splits for hot keys, and ends as one short list of
dropped runs per document: a compressed keep bitmap, not text.

Defined results: null and empty texts are one empty line; rows that share a ``doc_id``
count as one document and are treated alike; a null ``doc_id`` is never the largest and
its lines count for one document; ties cannot occur, as the largest id is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.support import SPACES, ascii_lower, written

SLICES = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def hashed_lines(docs: DataFrame, least_length: int, key: str, text: str) -> DataFrame:
    """``(doc, pos, h1, h2)`` for each line whose key is long enough."""
    keys = F.transform(split_lines(F.col(text)), lambda x: F.btrim(x, F.lit(SPACES)))
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(keys).alias("pos", "line")).where(
        F.length("line") >= least_length).withColumn("line", ascii_lower(F.col("line")))
    return lines.select("doc", "pos", F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def decisions(lines: DataFrame, least_docs: int) -> DataFrame:
    """``(h1, h2, keeper)`` of the lines found in at least ``least_docs`` documents."""
    slices = lines.groupBy("h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(SLICES)).alias("slice")).agg(
        F.count_distinct("doc", F.lit(0)).alias("n"), F.max("doc").alias("last"),
        F.max(F.col("doc").isNull().cast("int")).alias("unnamed"))
    ordered = slices.repartitionByRange("h1", "h2").sortWithinPartitions(
        "h1", "h2", F.desc_nulls_last("last"))
    group = Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("last"))
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ordered.select(
        "h1", "h2", F.row_number().over(group).alias("place"), F.col("last").alias("keeper"),
        F.sum(F.col("n") + F.col("unnamed")).over(whole).alias("n"),
    ).where((F.col("place") == 1) & (F.col("n") >= least_docs)).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, least_length: int = 40, least_docs: int = 5,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, drops)``: the sorted runs ``(first, last)`` of lines to drop, where there are any."""
    lines = written(hashed_lines(docs, least_length, key, text), "line-hashes")
    found = decisions(lines, least_docs)
    dropped = lines.join(found, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    runs = dropped.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: F.coalesce(
        F.get(F.col("at"), i - 1) != x - 1, F.lit(True)))
    ends = F.filter("at", lambda x, i: F.coalesce(
        F.get(F.col("at"), i + 1) != x + 1, F.lit(True)))
    return runs.select("doc", F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("drops"),
                       F.size("at").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, least_length: int = 40, least_docs: int = 5,
                         key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of the input), ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    bitmaps = keep_bitmaps(docs, least_length, least_docs, key, text)
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(bitmaps, F.col(f"row.{key}").eqNullSafe(F.col("doc")), "left")
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    # What lies between the dropped runs, as (first, size) slices of the lines.
    firsts = F.concat(F.array(F.lit(0)), F.transform("drops", lambda x: x["last"] + 1))
    stops = F.concat(F.transform("drops", lambda x: x["first"]), F.array(F.size("lines")))
    pieces = F.zip_with(firsts, stops, lambda a, b: F.when(
        b > a, F.array_join(F.slice(F.col("lines"), a + 1, b - a), "\n")))
    kept = F.when(F.col("drops").isNull(), body).otherwise(
        F.array_join(F.filter(pieces, lambda x: x.isNotNull()), "\n"))
    return joined.withColumn("lines", split_lines(F.col(f"row.{text}"))).select(
        "row", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Lines before and lines dropped, and the digest of what stays, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_shared_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT d.doc_id, p.pos, string_split(coalesce(d.text, ''), chr(10))[p.pos] AS line
  FROM documents d, unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS p(pos)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM keyed l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
