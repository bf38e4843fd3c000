"""Transactions: members stay hidden until as many have arrived as the transaction declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.targets import first_target, is_reference, value_of
from strandlake.types import MEMBERS, SIZE, TRANSACTION


def _named(pointers: Column, context: str) -> Column:
    found = first_target(pointers, lambda p: (p["local_context"] == TRANSACTION) & (p["target"]["kind"] == "string") & (p["target_context"] == context))
    return found["s"]


def transaction_of(pointers: Column) -> Column:
    """The transaction that a delta is a member of, or null."""
    return _named(pointers, MEMBERS)


def declared(log: DataFrame) -> DataFrame:
    """(transaction_id, size): the last declaration that arrived; 0 is none. Members declare nothing."""
    size = value_of(F.col("pointers"), SIZE)
    rows = log.where(transaction_of(F.col("pointers")).isNull()).select(
        _named(F.col("pointers"), SIZE).alias("transaction_id"), F.when(size["kind"] == "number", size["n"]).alias("size"), "ingest_seq"
    )
    rows = rows.where("transaction_id IS NOT NULL AND size IS NOT NULL AND size <> 0")
    return rows.groupBy("transaction_id").agg(F.max_by("size", "ingest_seq").alias("size"))


def members(log: DataFrame) -> DataFrame:
    """(transaction_id, received): distinct member deltas."""
    rows = log.select(transaction_of(F.col("pointers")).alias("transaction_id"), "delta_id").where("transaction_id IS NOT NULL")
    return rows.groupBy("transaction_id").agg(F.countDistinct("delta_id").alias("received"))


def status(log: DataFrame) -> DataFrame:
    """(transaction_id, size, received, complete) of every transaction that is declared or has a member."""
    return _status(log).drop("last_seq")


def one(log: DataFrame, transaction_id: str) -> DataFrame:
    """The status of one transaction; no row if nothing is known of it."""
    return status(log).where(F.col("transaction_id") == transaction_id)


def member_ids(log: DataFrame) -> DataFrame:
    """(transaction_id, delta_id): the deltas received for each transaction."""
    rows = log.select(transaction_of(F.col("pointers")).alias("transaction_id"), "delta_id").where("transaction_id IS NOT NULL")
    return rows.distinct()


def completed(log: DataFrame) -> DataFrame:
    """(transaction_id, completed_seq) of every complete transaction: the last arrival of a member or a size."""
    return _status(log).where("complete").select("transaction_id", F.col("last_seq").alias("completed_seq"))


def _status(log: DataFrame) -> DataFrame:
    """One pass over the log: members and declarations meet in one aggregation by transaction."""
    own = transaction_of(F.col("pointers"))
    size = value_of(F.col("pointers"), SIZE)
    rows = log.select(own.alias("own"), _named(F.col("pointers"), SIZE).alias("named"), F.when(size["kind"] == "number", size["n"]).alias("size"), "delta_id", "ingest_seq")
    rows = rows.withColumn("says", F.coalesce(F.col("own").isNull() & (F.col("size") != 0), F.lit(False))).where("own IS NOT NULL OR (says AND named IS NOT NULL)")
    both = rows.groupBy(F.coalesce("own", "named").alias("transaction_id")).agg(
        F.max_by(F.when(F.col("says"), F.col("size")), F.when(F.col("says"), F.col("ingest_seq"))).alias("size"),
        F.countDistinct(F.when(F.col("own").isNotNull(), F.col("delta_id"))).alias("received"),
        F.max("ingest_seq").alias("last_seq"),
    )
    return both.select("transaction_id", "size", "received", F.coalesce(F.col("size") == F.col("received"), F.lit(False)).alias("complete"), "last_seq")


def gate(seen: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of `seen` outside transactions or in complete ones, as counted over the whole log."""
    complete = status(log).where("complete").select(F.col("transaction_id").alias("_tx"))
    marked = seen.withColumn("_of", transaction_of(F.col("pointers")))
    free = marked.where("_of IS NULL").drop("_of")
    return free.unionByName(marked.join(complete, F.col("_of") == F.col("_tx"), "left_semi").drop("_of"))


def entities_of(log: DataFrame) -> DataFrame:
    """(transaction_id, entity_id): what a transaction's members point at, the transaction included."""
    at = F.array_distinct(F.transform(F.filter("pointers", is_reference), lambda p: p["target"]["s"]))
    rows = log.select(transaction_of(F.col("pointers")).alias("transaction_id"), F.explode(at).alias("entity_id"))
    return rows.where("transaction_id IS NOT NULL").distinct()
