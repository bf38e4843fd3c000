"""Delta stores: a Parquet table, or a view in memory, behind one interface.

A stored log keeps arrival order in `ingest_seq`; of rows with equal ids the last that arrived counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.targets import is_reference
from strandlake.operators.compose import deduplicated
from strandlake.sources.wire import content_hash
from strandlake.types import DELTA


@dataclass(frozen=True)
class LogQuery:
    """Criteria; 0, empty or None mean that one isn't set. Times are inclusive."""

    creator: str | None = None
    host: str | None = None
    created_after: int | None = None
    created_before: int | None = None
    entities: tuple[str, ...] = ()
    contexts: tuple[str, ...] = ()
    limit: int | None = None
    offset: int | None = None

    def condition(self) -> Column:
        """One conjunction; what compares plain columns reaches the scan."""
        tests = [F.lit(True)]
        if self.creator:
            tests.append(F.col("creator") == self.creator)
        if self.host:
            tests.append(F.col("host") == self.host)
        if self.created_after:
            tests.append(F.col("time_created") >= self.created_after)
        if self.created_before:
            tests.append(F.col("time_created") <= self.created_before)
        if self.entities:
            tests.append(F.exists("pointers", lambda p: is_reference(p) & p["target"]["s"].isin(list(self.entities))))
        if self.contexts:
            tests.append(F.exists("pointers", lambda p: F.coalesce(p["target_context"].isin(list(self.contexts)), F.lit(False))))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Store:
    """Reads of a log. Subclasses say where it is and how rows are added."""

    def log(self) -> DataFrame:
        raise NotImplementedError

    def append(self, deltas: DataFrame) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def get(self, delta_id: str) -> DataFrame:
        return self.log().where(F.col("delta_id") == delta_id)

    def scan(self, where: Column | str | None = None) -> DataFrame:
        return self.log() if where is None else self.log().where(where)

    def for_entity(self, entity_id: str) -> DataFrame:
        return self.log().where(LogQuery(entities=(entity_id,)).condition())

    def by_context(self, entity_id: str, context: str) -> DataFrame:
        return self.log().where(F.exists("pointers", lambda p: is_reference(p) & (p["target"]["s"] == entity_id) & (p["target_context"] == context)))

    def find(self, query: LogQuery) -> DataFrame:
        """In order of time; a limit with the order is one top-k, not a sort of the log."""
        rows = self.log().where(query.condition()).orderBy("time_created", "ingest_seq")
        if query.offset:
            rows = rows.offset(query.offset)
        return rows.limit(query.limit) if query.limit else rows

    def count(self, query: LogQuery) -> int:
        return self.log().where(query.condition()).count()

    def statistics(self) -> DataFrame:
        return statistics(self.log())

    def next_seq(self) -> int:
        last = self.log().agg(F.max("ingest_seq")).first()[0]
        return 0 if last is None else last + 1


def statistics(log: DataFrame) -> DataFrame:
    """One row: total_deltas, total_entities (distinct referenced), oldest, newest."""
    null = F.lit(None)
    targets = log.select(null.cast("long").alias("time"), F.explode(F.transform(F.filter("pointers", is_reference), lambda p: p["target"]["s"])).alias("entity"), F.lit(0).alias("one"))
    rows = log.select(F.col("time_created").alias("time"), null.cast("string").alias("entity"), F.lit(1).alias("one")).unionByName(targets)
    return rows.agg(
        F.coalesce(F.sum("one"), F.lit(0)).alias("total_deltas"), F.min("time").alias("oldest"), F.max("time").alias("newest"), F.countDistinct("entity").alias("total_entities")
    )


class MemoryStore(Store):
    def __init__(self, spark: SparkSession, deltas: DataFrame | list[dict[str, Any]] | None = None):
        self.spark = spark
        self._log = spark.createDataFrame([], DELTA)
        if deltas is not None:
            self.append(deltas)

    def log(self) -> DataFrame:
        return self._log

    def append(self, deltas: DataFrame | list[dict[str, Any]]) -> None:
        more = deltas if isinstance(deltas, DataFrame) else self.spark.createDataFrame(deltas, DELTA)
        self._log = deduplicated(self._log.unionByName(more.select(*DELTA.names)))

    def clear(self) -> None:
        self._log = self.spark.createDataFrame([], DELTA)


class ParquetStore(Store):
    """A folder of Parquet files. Appends only add files; duplicates are resolved when reading, or by compact().

    files: how many files compact() writes; each then has a range of times, so that time filters skip files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def log(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], DELTA)
        return deduplicated(self.spark.read.schema(DELTA).parquet(self.path))

    def append(self, deltas: DataFrame) -> None:
        deltas.select(*DELTA.names).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], DELTA).write.mode("overwrite").parquet(self.path)

    def compact(self, to: str, files: int = 8) -> ParquetStore:
        """The log without duplicates in another folder."""
        self.log().repartitionByRange(files, "time_created").write.mode("overwrite").parquet(to)
        return ParquetStore(self.spark, to)


def open_store(spark: SparkSession, kind: str = "memory", path: str | None = None) -> Store:
    if kind == "memory":
        return MemoryStore(spark)
    if kind == "parquet":
        if not path:
            raise ValueError("a Parquet store needs a path")
        return ParquetStore(spark, path)
    raise ValueError(f"no such kind of store: {kind}")


def migrate(source: Store, target: Store, batches: int = 1) -> int:
    """Copies a log, in so many batches by hash of the ids, and raises unless every delta arrived with its content."""
    rows = source.log()
    for k in range(batches):
        target.append(rows if batches == 1 else rows.where(F.pmod(F.xxhash64("delta_id"), F.lit(batches)) == k))
    said = lambda log: content_hash(log).select("delta_id", "content_hash")
    lost = said(rows).join(said(target.log()), ["delta_id", "content_hash"], "left_anti").count()
    if lost:
        raise RuntimeError(f"{lost} deltas did not arrive as they were")
    return target.log().count()
