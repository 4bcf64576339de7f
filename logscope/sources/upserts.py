"""A stored day table that takes feeds of new and changed rows.

Beside the rows, laid out by day, lies a map from each key to its day and version, in
folders by a hash of the key and with Parquet's Bloom filters on it. A feed is compared
with the map alone, in the folders its keys hash to: rows that are new or of a higher version
are changes, all others are ignored. Only the days that changes come from or go to are
written anew, into the folder of the next version; a manifest then names, for each day and
each map folder, the version that holds it. The manifest appears by one rename, so readers
see the table before or after a feed, and a load that dies leaves the table as it was. A
feed that comes again changes nothing and writes nothing, also after a restart.

Keys compare null-safe. Of rows that share key and version the stored one stays, and among
rows of one feed the first by all columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from logscope.functions.times import day_key
from logscope.scratch import hadoop_path, scratch_path
from logscope.sources.tables import latest_by_key

#: The day of rows without a time.
NO_DAY = "00000000"


@dataclass(frozen=True)
class Manifest:
    """Which version's folder holds each day and each part of the key map."""

    version: int = 0
    days: dict[str, int] = field(default_factory=dict)
    parts: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class UpsertTable:
    """A table at ``path``; rows have the columns of ``schema``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    version: tuple[str, ...]
    time: str
    parts: int = 64

    # Versions.

    def manifest(self) -> Manifest:
        """The newest version; number 0 before the first load."""
        names = [f.getPath().getName() for f in self._glob("versions/*.json")]
        if not names:
            return Manifest()
        newest = max(names, key=lambda n: int(n.removesuffix(".json")))
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{newest}").first()[0]
        return Manifest(**json.loads(text))

    def _glob(self, pattern: str) -> list:
        place = hadoop_path(self.spark, f"{self.path}/{pattern}")
        return list(place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or [])

    def _commit(self, manifest: Manifest) -> None:
        """Make a version visible; fails if another load has taken its number."""
        done = hadoop_path(self.spark, f"{self.path}/versions/{manifest.version}.json")
        files = done.getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft = hadoop_path(self.spark, f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        files.mkdirs(done.getParent())
        out = files.create(draft)
        try:
            out.write(bytearray(json.dumps(vars(manifest)), "utf-8"))
        finally:
            out.close()
        if files.exists(done) or not files.rename(draft, done):
            files.delete(draft, False)
            raise RuntimeError(f"another load has written version {manifest.version}")

    # Rows.

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        return reduce(and_, [left[k].eqNullSafe(right[f"_of_{i}"]) for i, k in enumerate(self.key)])

    def _named(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(self.key)), *more)

    def _day(self) -> Column:
        return F.coalesce(day_key(F.col(self.time)), F.lit(NO_DAY))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("string")

    def _read(self, what: str, by: str, schema: T.StructType, chosen: dict[str, int]) -> DataFrame:
        kind = T.StructType([*schema.fields, T.StructField("_version", T.IntegerType()),
                             T.StructField(by, T.StringType())])
        if not chosen:
            return self.spark.createDataFrame([], kind).drop("_version")
        folders = [f"{self.path}/{what}/_version={v}/{by}={name}" for name, v in sorted(chosen.items())]
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/{what}").parquet(
            *folders).drop("_version")

    def rows(self, days: tuple[str, str] | None = None) -> DataFrame:
        """The live rows with their ``day``; ``days`` are the first and last to open."""
        held = self.manifest().days
        chosen = {d: v for d, v in held.items() if days is None or days[0] <= d <= days[1]}
        return self._read("rows", "day", self.schema, chosen)

    def _map_schema(self) -> T.StructType:
        return T.StructType([*(self.schema[c] for c in dict.fromkeys([*self.key, *self.version])),
                             T.StructField("_day", T.StringType())])

    # Loads.

    def merge(self, feed: DataFrame) -> bool:
        """Load a feed; whether it changed anything."""
        spark, now = self.spark, self.manifest()
        wanted = feed.select(*self.schema.names).withColumn("_rest", F.to_json(F.struct(*self.schema.names)))
        news = latest_by_key(wanted, self.key, [*self.version, "_rest"]).drop("_rest").withColumns(
            {"_day": self._day(), "_part": self._part()})
        staged = scratch_path(spark, "feed")
        news.write.parquet(staged)
        news = spark.read.schema(news.schema).parquet(staged)
        # At most ``parts`` names, then at most one for each day.
        touched = [r[0] for r in news.select("_part").distinct().collect()]
        known = self._read("keys", "_part", self._map_schema(),
                           {p: now.parts[p] for p in touched if p in now.parts})
        old = self._named(known, F.struct(*self.version).alias("_old"), F.col("_day").alias("_from"))
        compared = news.join(old, self._same(news, old), "left")
        newer = F.col("_from").isNull() | (F.struct(*self.version) > F.col("_old"))
        changes = compared.where(newer).select(*news.columns, "_from")
        staged = scratch_path(spark, "changes")
        changes.write.parquet(staged)
        changes = spark.read.schema(changes.schema).parquet(staged)
        days = {r[0] for r in changes.select(F.explode(F.array("_day", "_from"))).distinct().collect()} - {None}
        if not days:
            return False
        parts = [r[0] for r in changes.select("_part").distinct().collect()]
        version = now.version + 1
        gone = self._named(changes)
        stored = self._read("rows", "day", self.schema, {d: now.days[d] for d in days if d in now.days})
        whole = stored.join(gone, self._same(stored, gone), "left_anti").unionByName(
            changes.select(*self.schema.names, F.col("_day").alias("day")))
        self._write(whole, "rows", "day", version)
        keys = self._read("keys", "_part", self._map_schema(), {p: now.parts[p] for p in parts if p in now.parts})
        keys = keys.join(gone, self._same(keys, gone), "left_anti").unionByName(
            changes.select(*self._map_schema().names, "_part"))
        self._write(keys, "keys", "_part", version)
        self._commit(Manifest(version, self._moved(now.days, days, "rows", "day", version),
                              self._moved(now.parts, parts, "keys", "_part", version)))
        return True

    def _write(self, rows: DataFrame, what: str, by: str, version: int) -> None:
        writer = rows.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by)
        for k in self.key if what == "keys" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/{what}/_version={version}")

    def _moved(self, before: dict[str, int], touched, what: str, by: str, version: int) -> dict[str, int]:
        """The folders after a load: a touched one without rows is gone."""
        made = {f.getPath().getName().removeprefix(f"{by}=") for f in self._glob(
            f"{what}/_version={version}/{by}=*")}
        return {n: v for n, v in before.items() if n not in touched} | {n: version for n in made}

    def clean(self) -> None:
        """Remove folders that the newest version no longer names, once no reader uses older ones."""
        now = self.manifest()
        for what, by, held in (("rows", "day", now.days), ("keys", "_part", now.parts)):
            for found in self._glob(f"{what}/_version=*/{by}=*"):
                place = found.getPath()
                version = int(place.getParent().getName().removeprefix("_version="))
                if held.get(place.getName().removeprefix(f"{by}=")) != version and version <= now.version:
                    place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert_sink(stream: DataFrame, table: UpsertTable, checkpoint: str) -> DataStreamWriter:
    """Merge a stream into a table; a micro-batch that runs again changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
