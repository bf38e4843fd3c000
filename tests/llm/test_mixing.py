"""Targets, sums and repeats, and positions against the schedule's integral."""

from strandlake.llm import mixing


def test_small_mix(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", 5) for i in range(300)] + [(400, None, "s0", 5), (401, "a\x0bb\tc", None, 5), (401, "a b", None, 5), (None, "x y z", "s1", 5), (402, "  　x", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    for source, found in by.items():
        assert sum(r.size for r in found) == found[0].source_size
        assert sum(r.taken for r in found) == round(found[0].target) or abs(sum(r.taken for r in found) - found[0].target) <= 0.5
    assert abs(sum(f[0].target for f in by.values()) - 1.5 * total) < 1e-6
    assert sorted(r.size for r in out if r.doc_id in (400, 401, 402)) == [0, 2, 2, 3]
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert all(again[r.doc_id, r.size] == r.taken for r in out if r.doc_id not in (401,))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")).first().taken == 0


def test_due_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for tilt in mixing.TILTS + (1.0, -1.0):
        rows = spark.range(0, 21).select((F.col("id") / 20.0).alias("q")).withColumn("t", mixing.due_time(F.col("q"), F.lit(tilt))).collect()
        for r in rows:
            assert abs((1 - tilt) * r.t + tilt * r.t * r.t - r.q) < 1e-9


def test_training_order_and_copies(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "z") for i in range(50)] + [(99, None, "s", "z")], "doc_id long, text string, source string, row string")
    order = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.where("doc_id < 99").count() == 75
