"""Logs for tests, written with the builder."""

from strandlake.functions.builder import DeltaBuilder
from strandlake.types import DELTA


class Log:
    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def add(self, builder: DeltaBuilder, seq=None):
        self.rows.append(builder.build(len(self.rows) if seq is None else seq))
        return self

    def set(self, entity, prop, value, time=1000, delta_id=None, creator="a", host="h", label="entity", tx=None):
        b = DeltaBuilder(creator, host).with_id(delta_id or f"d{len(self.rows):03}").with_timestamp(time).set_property(entity, prop, value, label)
        return self.add(b.in_transaction(tx) if tx else b)

    def negate(self, delta_id, own_id, time=2000):
        return self.add(DeltaBuilder("a", "h").with_id(own_id).with_timestamp(time).negate(delta_id))

    def declare(self, tx, size, time=1):
        return self.add(DeltaBuilder("a", "h").with_id(f"decl{len(self.rows)}").with_timestamp(time).declare_transaction(tx, size))

    def link(self, pointers, delta_id=None, time=1000, creator="a", host="h"):
        b = DeltaBuilder(creator, host).with_id(delta_id or f"d{len(self.rows):03}").with_timestamp(time)
        for p in pointers:
            b.add_pointer(*p)
        return self.add(b)

    def frame(self):
        return self.spark.createDataFrame(self.rows, DELTA)


def values(frame, prop=None):
    """{(entity, property): Python value} of a long frame with target values."""
    from strandlake.functions.builder import untagged

    out = {}
    for r in frame.collect():
        v = r["value"]
        out[r["entity_id"], r["property"] if prop is None else prop] = untagged(v.asDict()) if hasattr(v, "asDict") else v
    return out
