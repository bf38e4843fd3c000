"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a weight; the targets share `share` times all words by weight, stop at `repeat`
times a source's words, and what is cut off is shared again by weight until none is above. That
fix-point has a closed form: target = min(repeat * words, level * weight), where the level follows
from prefix sums over the sources in order of repeat * words / weight.

Within a source, documents follow one another by a hash of their id. A document's demand interval is
its range on the axis of the source's cumulative tokens; the mix takes what of it the target covers,
going around `repeat` times at most. A source's weight over training time is 1 - tilt + 2 * tilt * t,
whose integral (1 - tilt) * t + tilt * t^2 says which part of its target is due by time t; inverting
it at a document's cumulative demand gives the document's training position in [0, 1].

Defined cases: a null text has size 0; null sources form one source, ranked last; documents of size
0 are kept with taken 0; equal ids fall in any order among themselves but take the same total; an
empty table gives an empty result; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights that the sources get in turn, in code point order of their names.
WEIGHTS = (3.0, 1.0, 2.0)
#: How much a source's weight leans to late (positive) or early training, in turn; within -1 to 1.
TILTS = (0.0, 0.6, -0.6)
SHARE = 1.5
REPEAT = 2
#: A source's documents are summed in 2 to this power hash ranges, so that no task sees all of one source.
BUCKET_BITS = 12
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, source, size (words) and the hash bucket that orders documents within a source.

    whole_rows: with the row itself, as the struct `row`."""
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    turn = F.conv(F.substring(F.coalesce(digest, F.lit("0")), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.shiftright(turn, 60 - BUCKET_BITS).cast("int").alias("bucket"),
        turn.alias("turn"),
        *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole_rows else []),
    )


def source_targets(by_source: DataFrame, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, tilt, target).

    The windows without a partition run over one row per source, never over documents."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    everything = W.partitionBy()
    upto = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        by_source.withColumn("rank", rank)
        .withColumn("weight", pick(WEIGHTS))
        .withColumn("tilt", pick(TILTS))
        .withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("weight_left", F.col("weights") - F.sum("weight").over(upto) + F.col("weight"))
        # the level if this source and all with a later full_at stay below their caps
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        # too few caps taken off: the level passes full_at; too many: it falls, so the highest left is right
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "weight", "tilt", "target")
    )


def due_time(share: Column, tilt: Column) -> Column:
    """The time at which (1 - tilt) * t + tilt * t^2 reaches the given share."""
    slope = F.lit(1.0) - tilt
    root = F.sqrt(F.greatest(slope * slope + F.lit(4.0) * tilt * share, F.lit(0.0)))
    # the stable form of the quadratic's root: it also holds for tilt 0
    return F.when(share <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * share / (slope + root)))


def mix(docs: DataFrame, share: float = SHARE, repeat: int = REPEAT, whole_rows: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, position (null if nothing is taken).

    whole_rows: also the row itself (`row`), and `due` and `tilt`, from which later rounds' positions follow."""
    sized = sizes(docs, whole_rows)
    narrow = sizes(docs) if whole_rows else sized
    by_bucket = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = by_bucket.withColumn("bucket_from", F.sum("bucket_size").over(in_source) - F.col("bucket_size"))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, repeat)
    plan = (
        starts.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select(F.col("b.source").alias("p_source"), F.col("b.bucket").alias("p_bucket"), "bucket_from", "source_size", "tilt", "target")
    )
    # one exchange of (id, source, size) by source and bucket serves the running sum and the join
    in_bucket = W.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        sized.withColumn("upto", F.sum("size").over(in_bucket))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
        .withColumn("from", F.col("bucket_from") + F.col("upto") - F.col("size"))
        .withColumn("goal", F.round("target").cast("long"))
    )
    # words of the document in [from, from + size) of each round that lie below the goal
    rounds = [
        F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("goal") - F.col("source_size") * r - F.col("from")))
        for r in range(repeat)
    ]
    taken = rounds[0]
    for more in rounds[1:]:
        taken = taken + more
    share_due = F.when(F.col("goal") > 0, F.col("from") / F.col("goal")).otherwise(F.lit(0.0))
    return placed.withColumn("taken", taken).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "taken",
        F.when(F.col("taken") > 0, due_time(share_due, F.col("tilt"))).alias("position"),
        *(["row", "goal", "tilt", F.col("from")] if whole_rows else []),
    )


def mixed_rows(docs: DataFrame, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """The mix itself: rows of docs, with their columns, each as often as it is taken, in training order.

    A round's partial share of a document (at most one document of each source and round has one) counts as
    the whole document from half of its words on. A document without words is kept once, at the start."""
    placed = mix(docs, share, repeat, whole_rows=True)
    copies = F.when(F.col("size") > 0, F.round(F.try_divide("taken", "size"))).otherwise(F.lit(1)).cast("int")
    each = placed.where(copies > 0).withColumn("round", F.explode(F.sequence(F.lit(0), copies - 1)))
    due = F.when(F.col("goal") > 0, F.try_divide(F.col("from") + F.col("round") * F.col("source_size"), "goal")).otherwise(F.lit(0.0))
    timed = each.withColumn("at", due_time(due, F.col("tilt"))).orderBy("at", "doc_id", "round")
    return timed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix in training order: range-sorted by position, ties by id. Documents not taken go."""
    return mixed.where("taken > 0").orderBy("position", "doc_id")


def op10_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # what is not taken stands last; the sort is a range exchange over narrow rows
    return mix(docs).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _pick(values: tuple[float, ...]) -> str:
    return "CASE rank % {} {} END".format(len(values), " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(coalesce(md5(CAST(doc_id AS VARCHAR)), '0'), 1, 15) AS BIGINT) AS turn
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (
  SELECT source, source_size, CAST({_pick(WEIGHTS)} AS DOUBLE) AS weight, CAST({_pick(TILTS)} AS DOUBLE) AS tilt,
         source_size * CAST({REPEAT} AS DOUBLE) AS cap FROM ranked),
summed AS (
  SELECT *, cap / weight AS full_at, CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} AS total,
         sum(cap) OVER upto - cap AS caps_before, sum(weight) OVER () - sum(weight) OVER upto + weight AS weight_left
  FROM weighed WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
leveled AS (
  SELECT *, max(CASE WHEN (total - caps_before) / weight_left <= full_at THEN (total - caps_before) / weight_left END) OVER () AS level
  FROM summed),
targets AS (SELECT source, source_size, tilt, least(cap, coalesce(level * weight, cap)) AS target FROM leveled),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.tilt, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, {" + ".join(f"least(size, greatest(0, goal - source_size * {r} - before))" for r in range(REPEAT))} AS taken,
         CASE WHEN goal > 0 THEN before / CAST(goal AS DOUBLE) ELSE 0.0 END AS due
  FROM placed)
SELECT doc_id, source, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken <= 0 THEN NULL WHEN due <= 0 THEN 0.0
            ELSE least(CAST(1.0 AS DOUBLE), 2.0 * due / ((1.0 - tilt) + sqrt(greatest((1.0 - tilt) * (1.0 - tilt) + 4.0 * tilt * due, 0.0)))) END AS position
FROM taking
"""
