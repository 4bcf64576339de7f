"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(a, b)``: the least node each node can reach.

    Large-star and small-star take turns until every link leads to the least node. Each
    turn is written, so a lost executor costs one turn; minima are taken before rows are
    shuffled, and the joins are left to adaptive execution to split where a node is hot.
    """
    pairs = written(links.where("a <> b").select(
        F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "links")
    before = None
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(
            F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                             F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, hang on the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        pairs = written(small.unionByName(low.select("a", F.col("least").alias("b"))).where(
            "a <> b").distinct(), "stars")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == before:
            break
        before = state
    found = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return written(found.unionByName(roots), "components")
