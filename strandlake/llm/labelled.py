"""Bounded, repeatable samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, fold


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, held_out: int) -> tuple[dict[int, int], float]:
    """Up to `per_class` ids of each class, first by a hash of the id, outside the held-out fold, and the
    share of class 1 among all ids that could have been sampled (0 if there are none).

    Only ids and labels move; an id labelled more than once counts by its largest label; null labels
    and ids that `docs` lacks don't count. The sample's size is bounded by the parameter."""
    known = cut(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)")
        .where(fold(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    )
    turn = F.md5(F.col("doc_id").cast("string").cast("binary"))
    found: dict[int, int] = {}
    for value in (0, 1):
        found |= {r.doc_id: value for r in known.where(F.col("y") == value).orderBy(turn).limit(per_class).collect()}
    return found, known.agg(F.avg("y")).first()[0] or 0.0


def sampled_texts(docs: DataFrame, ids) -> DataFrame:
    """doc_id and text of the sampled documents: a semi join with the ids, which the sample's bound lets be broadcast."""
    wanted = docs.sparkSession.createDataFrame([(int(i),) for i in sorted(ids)], "doc_id long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id", "left_semi")
