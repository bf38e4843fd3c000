"""Compose and decompose: between the delta log and what is claimed about each entity's properties.

`claims` is the hub: one row per entity, property and delta that targets it. Order of visibility: negation
first, by all deltas, then the caller's filter, then transaction completeness.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.targets import is_reference, value_of
from strandlake.operators.negation import visible_deltas
from strandlake.operators.transactions import gate, status, transaction_of


def deduplicated(log: DataFrame) -> DataFrame:
    """One row per delta id: the last that arrived."""
    last = log.groupBy("delta_id").agg(F.max_by(F.struct(*log.columns), "ingest_seq").alias("row"))
    return last.select("row.*")


def pointers(log: DataFrame) -> DataFrame:
    """One row per pointer."""
    return log.select("delta_id", F.posexplode("pointers").alias("pos", "p")).select("delta_id", "pos", "p.*")


def claims_of(log: DataFrame) -> DataFrame:
    """All claims of a log, visible or not. A delta that targets a property twice claims it once; nth counts its claims from 0.

    Narrow projections: `pointers` is carried as a column that column pruning drops where it isn't used."""
    targets = F.array_distinct(F.transform(F.filter("pointers", is_reference), lambda p: F.struct(p["target"]["s"].alias("entity_id"), p["target_context"].alias("property"))))
    texts = F.transform("pointers", lambda p: F.when(p["target"]["kind"] == "string", p["target"]["s"]))
    each = log.withColumn("transaction_id", transaction_of(F.col("pointers"))).withColumn("_texts", texts).select("*", F.posexplode(targets).alias("nth", "at"))
    entity = F.col("at.entity_id")
    # the label of the first pointer at the entity
    label = F.get(F.col("pointers"), (F.array_position("_texts", entity) - 1).cast("int"))["local_context"]
    return each.select(
        entity.alias("entity_id"),
        F.col("at.property").alias("property"),
        "delta_id",
        "time_created",
        "host",
        "creator",
        "ingest_seq",
        label.alias("local_context"),
        value_of(F.col("pointers"), F.col("at.property")).alias("value"),
        "pointers",
        "transaction_id",
        "nth",
    )


def claims(
    log: DataFrame,
    entity_ids: list[str] | DataFrame | None = None,
    where: Column | str | None = None,
    negations: bool = True,
    transactions: bool = True,
    strict_arrival: bool = False,
) -> DataFrame:
    """Visible claims. entity_ids: a list, or a frame with a column entity_id; where: a condition on deltas.

    negations and transactions say whether the log may hold any: without, their joins are left out."""
    seen = visible_deltas(log, strict_arrival) if negations else log
    if where is not None:
        seen = seen.where(where)
    if transactions:
        seen = gate(seen, log)
    found = claims_of(seen)
    if isinstance(entity_ids, DataFrame):
        return found.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return found if entity_ids is None else found.where(F.col("entity_id").isin(list(entity_ids)))


def property_counts(found: DataFrame) -> DataFrame:
    """Summary: how many deltas claim each property of each entity."""
    return found.groupBy("entity_id", "property").agg(F.count("*").alias("n_deltas"))


def referenced_as(found: DataFrame) -> DataFrame:
    """The labels under which deltas point at each entity, in order of first arrival."""
    first = found.groupBy("entity_id", "local_context").agg(F.min("ingest_seq").alias("first_seq"))
    in_order = F.array_sort(F.collect_list(F.struct("first_seq", "local_context")))
    return first.groupBy("entity_id").agg(F.transform(in_order, lambda x: x["local_context"]).alias("referenced_as"))


#: What views hold of a delta besides its id and its place in the order of arrival.
CONTENT = ("time_created", "host", "creator", "pointers")


def views(found: DataFrame, content: tuple[str, ...] = CONTENT) -> DataFrame:
    """Nested form: entity_id, referenced_as, property_deltas (property to its deltas, in order of arrival).

    content: the columns of found that are kept of each delta. One exchange, by entity."""
    return _views(found.repartition("entity_id"), content)


def _views(found: DataFrame, content: tuple[str, ...], labels: bool = True) -> DataFrame:
    """Views of claims that lie together by entity already; labels: whether referenced_as is asked for."""
    label = F.struct("ingest_seq", "local_context" if labels else F.lit(None).cast("string").alias("local_context"))
    grouped = found.groupBy("entity_id", "property").agg(
        F.array_sort(F.collect_list(F.struct("ingest_seq", "delta_id", *content, "nth"))).alias("deltas"), F.collect_list(label).alias("labels")
    )
    seen = F.transform(F.array_sort(F.flatten(F.collect_list("labels"))), lambda x: x["local_context"])
    nested = grouped.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("property", "deltas"))).alias("property_deltas"), F.array_distinct(seen).alias("referenced_as"))
    return nested if labels else nested.drop("referenced_as")


def decompose(view: DataFrame, whole: bool = False) -> DataFrame:
    """Distinct deltas of nested views.

    whole: the views hold every claim of their deltas, and deliveries of one id are of equal pointers, as in an
    unfiltered log. Each delta is then taken from the view of its first claim, and nothing is exchanged."""
    each = view.select("entity_id", F.explode(F.flatten(F.map_values("property_deltas"))).alias("d"))
    if whole:
        each = each.where("d.nth = 0").select("entity_id", "d.*").dropDuplicates(["entity_id", "delta_id"])
    else:
        each = each.select("entity_id", "d.*").dropDuplicates(["delta_id"])
    return each.drop("entity_id", "nth")


def recomposed(found: DataFrame, content: tuple[str, ...] = CONTENT, rounds: int = 3) -> DataFrame:
    """Distinct deltas, by way of every entity's view; found holds every claim of its deltas (see `decompose`).

    For whole logs, whose views need several times the log's disk: each round composes a share of the entities from
    claims that are stored compressed in buckets by entity, and drops them when its deltas are written."""
    spark = found.sparkSession
    shared = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}").rstrip("/")
    name = f"strandlake_views_{uuid.uuid4().hex}"
    claimed = found.select("entity_id", "property", "ingest_seq", "delta_id", "nth", *content)
    out, schema = f"{shared}/{name}_deltas", None
    for k in range(rounds):
        store = f"{name}_{k}"
        share = claimed.where(F.pmod(F.xxhash64("entity_id"), F.lit(rounds)) == k)
        try:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            share.write.format("parquet").option("compression", "zstd").option("path", f"{shared}/{store}").bucketBy(buckets, "entity_id").saveAsTable(store)
            deltas = decompose(_views(spark.table(store), content, labels=False), whole=True)
            deltas.write.mode("append").option("compression", "zstd").parquet(out)
            schema = deltas.schema
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {store}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared}/{store}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(schema).parquet(out)


def with_status(found: DataFrame, log: DataFrame) -> DataFrame:
    """Claims made without the transaction gate, with `complete`: whether the claim's transaction is, null outside any."""
    states = status(log).select("transaction_id", "complete")
    inside = found.where("transaction_id IS NOT NULL").join(states, "transaction_id", "left").select(*found.columns, "complete")
    return inside.unionByName(found.where("transaction_id IS NULL").withColumn("complete", F.lit(None).cast("boolean")))


def entity_ids(found: DataFrame) -> DataFrame:
    return found.select("entity_id").distinct()


def at_time(log: DataFrame, time: int) -> DataFrame:
    """The log as of a time."""
    return log.where(F.col("time_created") <= time)

