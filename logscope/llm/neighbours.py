"""Nearest neighbours by a vantage-point tree per shard.

Vectors are dealt to shards by place: a small vantage-point tree, fitted on at most ``FIT``
vectors, sends each vector inside or outside a ball at each of its nodes, and a leaf of it is
a shard. A leaf that holds more than ``shard`` vectors is cut into parts of that size. Each
query searches its own shard first. The distance of its k-th find then rules out, by the
triangle inequality, every shard that lies wholly further away, before any vector is copied
for it; only the shards left are searched. Each task builds the tree of one part and searches
it for one block of queries, where subtrees are left out likewise. The inequality applies to
``factor`` times the gap between a query and a ball. Factor one, the default, is exact search; a
larger factor prunes more and loses neighbours, the more the fewer dimensions the data fill.
The nearest of each part are few and are merged at the end.

Defined results: vectors that are null, zero or hold null or non-finite components take no
part, neither as queries nor as candidates; ties go to the smaller id; with fewer
candidates than asked for, all are returned; null ids take no part; rows that share an id
are several candidates, and a query leaves out all rows of its own id; vectors whose length
differs from the query's are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.support import importable, written

SHARD = 8192
BLOCK = 1024
LEAF = 64
#: Vectors that the dealing tree is fitted on, and how many of them each of its leaves has.
FIT, FIT_LEAF = 8192, 8
#: Exact search.
FACTOR = 1.0


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed up in the order of the components."""
    total = np.zeros(len(points))
    for c in range(points.shape[1]):
        d = points[:, c] - to[..., c]
        total += d * d
    return np.sqrt(total)


class Tree:
    """A vantage-point tree over the rows of ``points``; the leaves are ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(points), leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        """Node: (vantage, inner low, inner high, outer low, outer high, inner, outer), or a leaf."""
        here = len(self.nodes)
        if b - a <= leaf:
            self.nodes.append((a, b))
            return here
        self.nodes.append(())
        own = self.order[a:b]
        # The vantage point lies furthest from the first row: it sees the most spread.
        start = np.sqrt(((self.points[own] - self.points[own[0]]) ** 2).sum(axis=1))
        pick = int(start.argmax())
        vantage = int(own[pick])
        rest = np.delete(own, pick)
        gaps = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(axis=1))
        middle = len(rest) // 2
        by = np.argpartition(gaps, middle)
        rest, gaps = rest[by], gaps[by]
        self.order[a], self.order[a + 1:b] = vantage, rest
        inner = self._build(a + 1, a + 1 + middle, leaf)
        outer = self._build(a + 1 + middle, b, leaf)
        low, high = gaps[:middle], gaps[middle:]
        self.nodes[here] = (vantage, low.min(), low.max(), high.min(), high.max(), inner, outer)
        return here

    def search(self, query: np.ndarray, banned: np.ndarray, k: int, factor: float,
               bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and rough distances of at least the ``k`` nearest found, and rows measured.

        Rows further than ``bound`` may be left out.
        """
        rows, gaps, seen = np.empty(0, int), np.empty(0), 0
        stack = [(0.0, self.root)]
        while stack:
            low, at = stack.pop()
            if factor * low > bound:
                continue
            node = self.nodes[at]
            new = self.order[node[0]:node[1]] if len(node) == 2 else np.array([node[0]])
            far = np.sqrt(((self.points[new] - query) ** 2).sum(axis=1))
            seen += len(new)
            if len(node) > 2:
                _, in_low, in_high, out_low, out_high, inner, outer = node
                sides = [(max(low, far[0] - in_high, in_low - far[0]), inner),
                         (max(low, far[0] - out_high, out_low - far[0]), outer)]
                stack += sorted(sides, reverse=True)
            ok = ~banned[new]
            rows, gaps = np.concatenate([rows, new[ok]]), np.concatenate([gaps, far[ok]])
            if len(rows) > k:
                # A little more than the k-th distance stays: ties are settled exactly later.
                kth = np.partition(gaps, k - 1)[k - 1]
                keep = gaps <= kth * (1 + 1e-9)
                rows, gaps = rows[keep], gaps[keep]
            if len(rows) >= k:
                bound = min(bound, np.partition(gaps, k - 1)[k - 1] * (1 + 1e-9))
        return rows, gaps, seen


class Places:
    """Balls that deal vectors of one length to shards.

    A shard is known by the balls around it alone, so what it rules out holds for every
    vector, whether the tree was fitted on it or not.
    """

    def __init__(self, points: np.ndarray, shards: int) -> None:
        #: (vantage vector, radius, inner node, outer node), or the number of a shard.
        self.nodes: list[tuple | int] = []
        self.shards = 0
        self._build(points, min(shards, len(points) // FIT_LEAF))

    def _build(self, points: np.ndarray, shards: int) -> int:
        here = len(self.nodes)
        self.nodes.append(self.shards)
        if shards > 1:
            vantage = points[_gaps(points, points[0]).argmax()]
            gaps = _gaps(points, vantage)
            radius = np.partition(gaps, len(gaps) * (shards // 2) // shards)[
                len(gaps) * (shards // 2) // shards]
            inside = gaps <= radius
            # Where most vectors are the same no ball parts them.
            if not inside.all() and inside.any():
                inner = self._build(points[inside], shards // 2)
                outer = self._build(points[~inside], shards - shards // 2)
                self.nodes[here] = (vantage, radius, inner, outer)
                return here
        self.shards += 1
        return here

    def deal(self, points: np.ndarray) -> np.ndarray:
        """The shard of each row."""
        found, stack = np.zeros(len(points), int), [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                found[rows] = node
                continue
            vantage, radius, inner, outer = node
            inside = _gaps(points[rows], vantage) <= radius
            stack += [(child, own) for child, own in ((inner, rows[inside]), (outer, rows[~inside]))
                      if len(own)]
        return found

    def within(self, query: np.ndarray, bound: float, factor: float) -> list[int]:
        """The shards that may hold a vector no further than ``bound``."""
        found, stack = [], [(0, 0.0)]
        while stack:
            at, low = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                found.append(node)
                continue
            vantage, radius, inner, outer = node
            gap = float(_gaps(query[None, :], vantage)[0])
            # Rounding of either distance must not rule out what lies on the ball.
            slack = 1e-9 * (gap + radius)
            for child, least in ((inner, gap - radius - slack), (outer, radius - gap - slack)):
                least = max(low, least)
                if not factor * least > bound:
                    stack.append((child, least))
        return found


def _gaps(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vector)`` as doubles, of the rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("key"),
                          F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("key").isNotNull() & v.isNotNull()).where(
        F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))


def fitted(vectors: DataFrame, shard: int = SHARD, fit: int = FIT) -> dict[int, Places]:
    """Places by length of vectors, from at most ``fit`` of them chosen by hash."""
    n = vectors.count()
    mark = F.shiftrightunsigned(F.xxhash64("key", "vector"), 1)
    some = vectors if n <= fit else vectors.where(mark < (1 << 63) * fit // n)
    # Repeated rows share their hash: the limit bounds the sample, not the search.
    points = [np.array(r["vector"]) for r in some.select("vector").limit(fit).collect()]
    by_size: dict[int, list] = {}
    for p in points:
        by_size.setdefault(len(p), []).append(p)
    return {size: Places(np.stack(own), max(1, -(-n * len(own) // (len(points) * shard))))
            for size, own in by_size.items()}


def placed(vectors: DataFrame, places: dict[int, Places]) -> DataFrame:
    """``(key, vector, size, place, at)``, written: the shard of every vector and its number in its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for batch in batches:
            sizes = batch["vector"].map(len).to_numpy()
            found = np.zeros(len(batch), int)
            for size in set(sizes) & set(places):
                own = sizes == size
                found[own] = places[size].deal(np.stack(batch["vector"].to_numpy()[own]))
            yield batch.assign(size=sizes, place=found, at=np.arange(done, done + len(batch)))
            done += len(batch)

    return written(vectors.select("key", "vector").mapInPandas(
        run, "key bigint, vector array<double>, size int, place int, at bigint"), "placed-vectors")


def visits(queries: DataFrame, places: dict[int, Places], factor: float) -> DataFrame:
    """``(key, vector, bound, size, place)``, written: the other shards that queries have to search."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["place"] = [
                [x for x in places[size].within(np.asarray(vector), bound, factor) if x != own]
                if size in places else []
                for vector, bound, size, own in batch[["vector", "bound", "size", "place"]].itertuples(index=False)]
            yield batch.explode("place").dropna(subset=["place"]).astype({"place": int})

    return written(queries.select("key", "vector", "bound", "size", "place").mapInPandas(
        run, "key bigint, vector array<double>, bound double, size int, place int"), "visits")


def _searched(vectors: DataFrame, asking: DataFrame, k: int, factor: float, shard: int,
              block: int) -> DataFrame:
    """``(query_id, vec_id, score)``: at least each query's nearest in the shards it visits."""
    where = ["size", "place"]
    held = vectors.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
    asked = asking.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # Shards that no query visits drop out here.
    both = held.join(asked, where)
    left = vectors.join(both, where).select(
        *where, F.pmod(F.col("at"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "vector")
    right = asking.join(both, where).select(
        *where, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("key", "vector"), F.col("blocks")).cast("int").alias("block"),
        "key", "vector", "bound")

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            rows = own.sort_values("key")
            ids, points = rows["key"].to_numpy(), np.stack(rows["vector"].to_numpy())
            tree = Tree(points)
            for q, vector, bound in asked[["key", "vector", "bound"]].itertuples(index=False):
                found, _, _ = tree.search(np.asarray(vector), ids == q, k, factor, bound)
                exact = distances(points[found], np.asarray(vector))
                best = np.lexsort((ids[found], exact))[:k]
                out += [(q, int(ids[found[i]]), float(exact[i])) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    place = [*where, "part", "block"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(
        run, "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR,
            shard: int = SHARD, block: int = BLOCK, fit: int = FIT) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; both inputs as :func:`usable` gives them."""
    importable(vectors.sparkSession)
    places = fitted(vectors, shard, fit)
    rows, asking = placed(vectors, places), placed(queries, places)
    far = F.lit(float("inf"))
    own = written(_best(_searched(rows, asking.withColumn("bound", far), k, factor, shard, block), k),
                  "own-shard")
    # The k-th find so far, a little enlarged: ties are settled at the end.
    bounds = own.where(F.col("rank") == k).select(
        F.col("query_id").alias("key"), (F.col("score") * (1 + 1e-9)).alias("bound"))
    bounded = asking.join(bounds, "key", "left").withColumn("bound", F.coalesce("bound", far))
    others = _searched(rows, visits(bounded, places, factor), k, factor, shard, block)
    return _best(own.drop("rank").unionByName(others), k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("key") % 100 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(
    list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM pairs QUALIFY rank <= 10
"""
