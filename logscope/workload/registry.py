"""The catalogue of registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logscope.scratch import scratch_path, scratch_root, stamp

_STORED: dict[tuple, str] = {}


@dataclass(frozen=True)
class Tables:
    """The input tables of one data folder."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def stored(self, name: str, sources: Sequence[str], write: Callable[[str], None]) -> str:
        """The path of a table laid out from the input, written once a session.

        It is written again when the files of its sources changed.
        """
        seen = tuple(stamp(self.spark, self.path(s)) for s in sources)
        key = (self.spark.sparkContext.applicationId, scratch_root(self.spark), self.folder, name, seen)
        if key not in _STORED:
            path = scratch_path(self.spark, name)
            write(path)
            _STORED[key] = path
        return _STORED[key]


@dataclass(frozen=True)
class Entry:
    """A query over the tables, the operators it covers and its SQL, if there is one."""

    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None) -> Callable:
    """Register a function of :class:`Tables` under its own name."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = run.__name__
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(name, tuple(covers.split()), run, sql)
        return run

    return add
