"""Negation: deltas that take others back, themselves open to being taken back."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.targets import first_target, is_reference
from strandlake.types import NEGATED_BY, NEGATES


def is_negation(pointers: Column) -> Column:
    return F.exists(pointers, lambda p: (p["local_context"] == NEGATES) & (p["target_context"] == NEGATED_BY))


def negated_id(pointers: Column) -> Column:
    """The delta that a negation takes back, or null."""
    found = first_target(pointers, lambda p: (p["local_context"] == NEGATES) & (p["target_context"] == NEGATED_BY))
    return F.when(found["kind"] == "string", found["s"])


def edges(log: DataFrame) -> DataFrame:
    """(negation_id, negated_id, time_created, ingest_seq): narrow, and few against the log."""
    return (
        log.where(F.coalesce(is_negation(F.col("pointers")), F.lit(False)))
        .select(F.col("delta_id").alias("negation_id"), negated_id(F.col("pointers")).alias("negated_id"), "time_created", "ingest_seq")
        .where("negated_id IS NOT NULL")
        .dropDuplicates(["negation_id"])
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut in the folder that the session names; a local one where it names none (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            import tempfile

            named = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        context.setCheckpointDir(named)
    return df.checkpoint()


def active_negations(found: DataFrame) -> DataFrame:
    """Negations that are in force: (negation_id, negated_id). One is unless one in force takes it back.

    Without chains that is one semi join's finding. Else levels are settled from the ends of the chains on,
    one round for two of them, until a round settles nothing. Members of cycles, which nothing settles, count as in force."""
    chained = found.join(found.select(F.col("negated_id").alias("negation_id")), "negation_id", "left_semi")
    if chained.isEmpty():
        return found.select("negation_id", "negated_id")
    open_ = checkpointed(found.select("negation_id", "negated_id"))
    settled = None
    for done in itertools.count(1):
        # nothing open takes these back, so they are in force ...
        active = open_.join(open_.select(F.col("negated_id").alias("negation_id")), "negation_id", "left_anti")
        active = checkpointed(active)
        if active.isEmpty():
            break
        settled = active if settled is None else settled.unionByName(active)
        if done % 32 == 0:  # the plan of a long chain's union stays short
            settled = checkpointed(settled)
        # ... and what they take back isn't; what those took back may be in force again
        fallen = active.select(F.col("negated_id").alias("negation_id")).distinct()
        open_ = checkpointed(open_.join(active.select("negation_id"), "negation_id", "left_anti").join(fallen, "negation_id", "left_anti"))
        if open_.isEmpty():
            return settled
    return open_ if settled is None else settled.unionByName(open_)


def visible_deltas(log: DataFrame, strict_arrival: bool = False) -> DataFrame:
    """The log without negations and without what negations in force take back.

    strict_arrival: a negation that arrived before its target has no effect."""
    found = edges(log)
    if strict_arrival:
        arrived = log.select(F.col("delta_id").alias("negated_id"), F.col("ingest_seq").alias("target_seq"))
        found = found.join(arrived, "negated_id").where("ingest_seq > target_seq").drop("target_seq")
    gone = active_negations(found).select(F.col("negated_id").alias("delta_id")).distinct()
    plain = log.where(~F.coalesce(is_negation(F.col("pointers")), F.lit(False)))
    return plain.join(gone, "delta_id", "left_anti")


def chronological(log: DataFrame) -> DataFrame:
    """The log without negations and without deltas that a later negation names; no chains."""
    later = edges(log).select(F.col("negated_id").alias("delta_id"), F.col("time_created").alias("n_time"), F.col("ingest_seq").alias("n_seq"))
    latest = later.groupBy("delta_id").agg(F.max(F.struct("n_time", "n_seq")).alias("last"))
    plain = log.where(~F.coalesce(is_negation(F.col("pointers")), F.lit(False)))
    after = (F.col("last.n_time") > F.col("time_created")) | ((F.col("last.n_time") == F.col("time_created")) & (F.col("last.n_seq") > F.col("ingest_seq")))
    return plain.join(latest, "delta_id", "left").where(~F.coalesce(after, F.lit(False))).drop("last")


def is_negated(log: DataFrame, delta_id: str) -> bool:
    """Whether a negation in force takes the delta back."""
    return not active_negations(edges(log)).where(F.col("negated_id") == delta_id).isEmpty()


def negation_status(log: DataFrame) -> DataFrame:
    """(delta_id, negated) of every delta, negations included: whether a negation in force takes it back."""
    gone = active_negations(edges(log)).select(F.col("negated_id").alias("delta_id")).distinct().withColumn("negated", F.lit(True))
    return log.select("delta_id").join(gone, "delta_id", "left").select("delta_id", F.coalesce("negated", F.lit(False)).alias("negated"))


def negation_map(log: DataFrame) -> DataFrame:
    """(delta_id, negation_id, in_force): what each negation names, and whether it is in force."""
    found = edges(log)
    active = active_negations(found).select("negation_id").withColumn("in_force", F.lit(True))
    marked = found.join(active, "negation_id", "left")
    return marked.select(F.col("negated_id").alias("delta_id"), "negation_id", F.coalesce("in_force", F.lit(False)).alias("in_force"))


def negations_for(log: DataFrame, delta_id: str) -> DataFrame:
    return log.join(edges(log).where(F.col("negated_id") == delta_id).select(F.col("negation_id").alias("delta_id")), "delta_id", "left_semi")


def statistics(log: DataFrame) -> DataFrame:
    """One row: total, negations, negated (plain deltas that negations in force take back), effective."""
    found = edges(log)
    gone = active_negations(found).select(F.col("negated_id").alias("delta_id")).distinct().withColumn("gone", F.lit(True))
    marked = log.select("delta_id", F.coalesce(is_negation(F.col("pointers")), F.lit(False)).alias("is_negation")).join(gone, "delta_id", "left")
    lost = F.count_if(F.col("gone") & ~F.col("is_negation"))
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if("is_negation").alias("negations"),
        lost.alias("negated"),
        (F.count_if(~F.col("is_negation")) - lost).alias("effective"),
    )


def property_statistics(log: DataFrame) -> DataFrame:
    """Per property: claims by plain deltas, and of those how many negations in force take back."""
    gone = active_negations(edges(log)).select(F.col("negated_id").alias("delta_id")).distinct().withColumn("gone", F.lit(True))
    plain = log.where(~F.coalesce(is_negation(F.col("pointers")), F.lit(False)))
    each = plain.select("delta_id", F.explode(F.array_distinct(F.transform(F.filter("pointers", is_reference), lambda p: p["target_context"]))).alias("property"))
    return each.join(gone, "delta_id", "left").groupBy("property").agg(F.count("*").alias("total"), F.count_if("gone").alias("negated"))


def entity_statistics(log: DataFrame) -> DataFrame:
    """Per entity and property: claims, and how many a negation names directly; chains don't matter here."""
    named = edges(log).select(F.col("negated_id").alias("delta_id")).distinct().withColumn("named", F.lit(True))
    plain = log.where(~F.coalesce(is_negation(F.col("pointers")), F.lit(False)))
    at = F.array_distinct(F.transform(F.filter("pointers", is_reference), lambda p: F.struct(p["target"]["s"].alias("entity_id"), p["target_context"].alias("property"))))
    each = plain.select("delta_id", F.explode(at).alias("at")).select("delta_id", "at.*")
    return each.join(named, "delta_id", "left").groupBy("entity_id", "property").agg(F.count("*").alias("total"), F.count_if("named").alias("negated"))


def negations_of_entities(log: DataFrame) -> DataFrame:
    """(entity_id, negation_id): negations of an entity's deltas, and negations of those."""
    at = F.array_distinct(F.transform(F.filter("pointers", is_reference), lambda p: p["target"]["s"]))
    plain = log.where(~F.coalesce(is_negation(F.col("pointers")), F.lit(False)))
    reached = plain.select("delta_id", F.explode(at).alias("entity_id"))
    found, out = edges(log).select("negation_id", F.col("negated_id").alias("delta_id")), None
    while True:
        reached = checkpointed(reached.join(found, "delta_id").select("entity_id", F.col("negation_id").alias("delta_id")).distinct())
        if out is not None:
            reached = checkpointed(reached.join(out, ["entity_id", "delta_id"], "left_anti"))
        if reached.isEmpty():
            break
        out = reached if out is None else out.unionByName(reached)
    found_any = out if out is not None else reached
    return found_any.select("entity_id", F.col("delta_id").alias("negation_id"))
