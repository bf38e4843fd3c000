"""Deltas as JSON lines, the form in which peers exchange them, and unions of peers' logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.targets import js_number_text
from strandlake.types import DELTA

#: Scalars are kept as raw JSON text until their kind is known.
_IMAGE = "id string, timeCreated bigint, host string, creator string, pointers array<struct<localContext: string, target: string, targetContext: string>>"


def _json_scalar(target: Column) -> Column:
    quoted = F.to_json(F.array(target["s"]))
    return (
        F.when(target["kind"] == "string", F.substring(quoted, F.lit(2), F.length(quoted) - 2))
        .when(target["kind"] == "number", js_number_text(target["n"]))
        .when(target["kind"] == "boolean", target["b"].cast("string"))
        .otherwise(F.lit("null"))
    )


def to_lines(log: DataFrame) -> DataFrame:
    """One JSON text per delta, without what is local to this store."""
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    one = lambda p: F.concat(
        F.lit('{"localContext":'), text(p["local_context"]), F.lit(',"target":'), _json_scalar(p["target"]),
        F.coalesce(F.concat(F.lit(',"targetContext":'), text(F.when(p["target_context"] != "", p["target_context"]))), F.lit("")), F.lit("}"),
    )
    pointers = F.array_join(F.transform("pointers", one), ",")
    line = F.concat(
        F.lit('{"id":'), text(F.col("delta_id")), F.lit(',"timeCreated":'), F.col("time_created").cast("string"), F.lit(',"host":'), text(F.col("host")),
        F.lit(',"creator":'), text(F.col("creator")), F.lit(',"pointers":['), pointers, F.lit("]}"),
    )
    return log.select(line.alias("value"))


def from_lines(lines: DataFrame, received_from: str | None = None, first_seq: int = 0) -> DataFrame:
    """Rows of the log from JSON texts (column value); lines that aren't deltas give rows of nulls, which
    validation rejects. Rows are numbered in partition order."""
    image = F.from_json("value", _IMAGE, {"mode": "PERMISSIVE"})
    # the raw text of each target tells texts from numbers: get_json_object keeps no quotes, variant does
    kinds = F.from_json("value", "pointers array<struct<target: variant>>")
    parsed = lines.select(image.alias("d"), kinds.alias("k"))

    def target(p: Column, k: Column) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(k["target"]), "^[A-Z]+", 0)
        name = F.when(k["target"].isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
        s = p["target"]
        return F.struct(
            name.alias("kind"), F.when(name == "string", s).alias("s"),
            F.when(name == "number", s.try_cast("double")).alias("n"), F.when(name == "boolean", s.try_cast("boolean")).alias("b"),
        )

    made = F.zip_with("d.pointers", "k.pointers", lambda p, k: F.struct(p["localContext"].alias("local_context"), target(p, k).alias("target"), p["targetContext"].alias("target_context")))
    rows = parsed.select(
        F.col("d.id").alias("delta_id"), F.col("d.timeCreated").alias("time_created"), "d.host", "d.creator", made.alias("pointers"),
        F.lit(received_from).cast("string").alias("received_from"), (F.monotonically_increasing_id() + first_seq).alias("ingest_seq"),
    )
    return rows.select(*DELTA.names)


def content_hash(log: DataFrame) -> DataFrame:
    """The log with a hash of what its deltas say."""
    return log.withColumn("content_hash", F.sha2(F.to_json(F.struct("delta_id", "time_created", "host", "creator", "pointers")), 256))


def union_logs(*logs: DataFrame) -> DataFrame:
    """Peers' logs as one: of deltas with the same content the first that arrived."""
    every = logs[0]
    for more in logs[1:]:
        every = every.unionByName(more)
    first = content_hash(every).groupBy("content_hash").agg(F.min_by(F.struct(*every.columns), "ingest_seq").alias("row"))
    return first.select("row.*")


def counts_by_peer(log: DataFrame) -> DataFrame:
    return log.groupBy("received_from").agg(F.count("*").alias("n_deltas"))


def publish(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a stream of deltas as JSON lines to a folder that peers read; ends when all that is there is written."""
    to_lines(stream).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def parse_address(address: Column) -> tuple[Column, Column]:
    """Host and port of `host:port`; a port is as many digits as there are, else null."""
    parts = F.split(F.trim(address), ":")
    return F.get(parts, F.lit(0)), F.regexp_extract(F.get(parts, F.lit(1)), r"^\s*([+-]?\d+)", 1).try_cast("int")


def parse_addresses(text: Column) -> Column:
    """Array of (host, port) of a list with commas; empty members are left out."""

    def one(address: Column) -> Column:
        host, port = parse_address(address)
        return F.struct(host.alias("host"), port.alias("port"))

    return F.transform(F.filter(F.split(text, ","), lambda a: a != ""), one)


def address_text(host: Column, port: Column) -> Column:
    return F.concat(host, F.lit(":"), port.cast("string"))
