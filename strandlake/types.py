"""Row types of the delta log.

A target is a tagged union, orderable and hashable: `kind` is string, number, boolean or null, and the
field of that kind holds the value. SQL NULL means that there is no target at all.
"""

from pyspark.sql import types as T

TARGET = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
    ]
)

POINTER = T.StructType(
    [
        T.StructField("local_context", T.StringType()),
        T.StructField("target", TARGET),
        T.StructField("target_context", T.StringType()),
    ]
)

DELTA = T.StructType(
    [
        T.StructField("delta_id", T.StringType()),
        T.StructField("time_created", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("pointers", T.ArrayType(POINTER)),
        T.StructField("received_from", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

# Names that the data model reserves.
NEGATES, NEGATED_BY = "_negates", "negated_by"
TRANSACTION, MEMBERS, SIZE = "_transaction", "deltas", "size"
