"""Delta logs made from relational tables: how rows become deltas with entities, slots and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.targets import number, pointer, reference, text
from strandlake.types import MEMBERS, NEGATED_BY, NEGATES, SIZE, TRANSACTION

LOG_COLUMNS = ("delta_id", "time_created", "host", "creator", "pointers", "received_from", "ingest_seq")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


def numbered(prefix: str, column: str | Column) -> Column:
    """Ids of fixed width, whose binary and collated orders agree."""
    return F.concat(F.lit(prefix), F.lpad((F.col(column) if isinstance(column, str) else column).cast("string"), 10, "0"))


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def log(rows: DataFrame, delta_id: Column, time: Column, host: Column, creator: Column, pointers: Column, seq: Column) -> DataFrame:
    return rows.select(
        delta_id.alias("delta_id"),
        time.cast("long").alias("time_created"),
        host.alias("host"),
        creator.alias("creator"),
        pointers.alias("pointers"),
        F.lit(None).cast("string").alias("received_from"),
        seq.cast("long").alias("ingest_seq"),
    )


def event_log(spark: SparkSession, sf_dir: str, time: Column | None = None, extra: Column | None = None) -> DataFrame:
    """One delta per event: a user's property named by the event type has the event's value.

    time replaces the event's own time; extra is an array of further pointers."""
    pointers = F.array(reference("user", key("user-", "user_id"), F.col("event_type")), pointer(F.col("event_type"), number(F.col("value"))))
    return log(
        read(spark, sf_dir, "events"),
        numbered("evt-", "event_id"),
        micros("ts") if time is None else time,
        key("host-", F.col("event_id") % 4),
        key("user-", "user_id"),
        pointers if extra is None else F.concat(pointers, extra),
        F.col("event_id"),
    )


def day_of(column: str) -> Column:
    return F.unix_micros(F.date_trunc("day", F.col(column).cast("timestamp")))


def negation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, negations of every 17th, negations of every third of those, and of every third again."""
    base = event_log(spark, sf_dir)
    events = read(spark, sf_dir, "events")

    def level(prefix: str, target: str, every: int, step: int) -> DataFrame:
        rows = events.where(F.col("event_id") % every == 0)
        point = F.array(reference(NEGATES, numbered(target, "event_id"), NEGATED_BY))
        return log(rows, numbered(prefix, "event_id"), micros("ts") + step, F.lit("host-n"), F.lit("moderator"), point, F.col("event_id") + 1_000_000_000 * step)

    return base.unionByName(level("neg-", "evt-", 17, 1)).unionByName(level("ren-", "neg-", 51, 2)).unionByName(level("rer-", "ren-", 153, 3))


def transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in transactions of five; every seventh is declared one too large, every eleventh not at all."""
    group = F.floor(F.col("event_id") / 5).cast("long")
    members = event_log(spark, sf_dir, extra=F.array(reference(TRANSACTION, key("tx-", group), F.lit(MEMBERS))))
    groups = read(spark, sf_dir, "events").select(group.alias("g")).distinct().where("g % 11 <> 0")
    size = F.when(F.col("g") % 7 == 0, 6).otherwise(5)
    point = F.array(reference(TRANSACTION, key("tx-", "g"), F.lit(SIZE)), pointer(SIZE, number(size)))
    declared = log(groups, numbered("dec-", "g"), F.col("g") + 1, F.lit("host-t"), F.lit("teller"), point, F.col("g") + 2_000_000_000)
    return members.unionByName(declared)


def _property(entity: Column, label: str, name: str, target: Column) -> Column:
    return F.array(reference(label, entity, F.lit(name)), pointer(name, target))


def _deltas_of(rows: DataFrame, prefix: str, id_column: str, time: Column, facts: list[tuple[str, Column]]) -> DataFrame:
    """One delta for each row and fact (property, pointer array); null arrays give none."""
    each = rows.select(
        F.col(id_column).alias("_id"),
        time.alias("_time"),
        F.posexplode(F.array(*(F.struct(F.lit(name).alias("name"), points.alias("points")) for name, points in facts))).alias("_nth", "_fact"),
    ).where("_fact.points IS NOT NULL")
    return log(
        each,
        F.concat(F.lit(prefix), F.col("_fact.name"), F.lit("-"), F.lpad(F.col("_id").cast("string"), 10, "0")),
        F.col("_time"),
        F.lit("host-0"),
        F.lit("loader"),
        F.col("_fact.points"),
        F.col("_id") * 16 + F.col("_nth"),
    )


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities. Every 13th has no segment; every 29th has a text as its balance."""
    entity = key("customer-", "c_custkey")
    balance = F.when(F.col("c_custkey") % 29 == 0, text(F.lit("unknown"))).otherwise(number(F.col("c_acctbal")))
    segment = F.when(F.col("c_custkey") % 13 != 0, _property(entity, "customer", "segment", text(F.col("c_mktsegment"))))
    facts = [
        ("name", _property(entity, "customer", "name", text(F.col("c_name")))),
        ("acctbal", _property(entity, "customer", "acctbal", balance)),
        ("segment", segment),
        ("nation", F.array(reference("customer", entity, "nation"), reference("nation", key("nation-", "c_nationkey"), "customers"))),
    ]
    return _deltas_of(read(spark, sf_dir, "customer"), "cus-", "c_custkey", F.col("c_custkey") + 1, facts)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities with a status, a total, a priority and a customer."""
    entity = key("order-", "o_orderkey")
    facts = [
        ("status", _property(entity, "order", "status", text(F.col("o_orderstatus")))),
        ("total", _property(entity, "order", "total", number(F.col("o_totalprice")))),
        ("priority", _property(entity, "order", "priority", text(F.col("o_orderpriority")))),
        ("customer", F.array(reference("order", entity, "customer"), reference("customer", key("customer-", "o_custkey"), "orders"))),
    ]
    return _deltas_of(read(spark, sf_dir, "orders"), "ord-", "o_orderkey", micros("o_orderdate"), facts)


def place_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as entities; a nation's region is a reference."""
    nation, region = key("nation-", "n_nationkey"), key("region-", "r_regionkey")
    nations = _deltas_of(
        read(spark, sf_dir, "nation"), "nat-", "n_nationkey", F.col("n_nationkey") + 1,
        [
            ("name", _property(nation, "nation", "name", text(F.col("n_name")))),
            ("region", F.array(reference("nation", nation, "region"), reference("region", key("region-", "n_regionkey"), "nations"))),
        ],
    )
    regions = _deltas_of(read(spark, sf_dir, "region"), "reg-", "r_regionkey", F.col("r_regionkey") + 1, [("name", _property(region, "region", "name", text(F.col("r_name"))))])
    return nations.unionByName(regions.withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000))


def line_id() -> Column:
    """Order and line number alone aren't unique, nor with the part and supplier."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hyperedge per line: order, part and supplier take part; quantity, price and discount are said."""
    pointers = F.array(
        reference("order", key("order-", "l_orderkey"), "items"),
        reference("part", key("part-", "l_partkey"), "sold_in"),
        reference("supplier", key("supplier-", "l_suppkey"), "supplied"),
        pointer("quantity", number(F.col("l_quantity"))),
        pointer("price", number(F.col("l_extendedprice"))),
        pointer("discount", number(F.col("l_discount"))),
    )
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return log(read(spark, sf_dir, "lineitem"), key("lin-", line_id()), micros("l_shipdate"), F.lit("host-0"), F.lit("loader"), pointers, line)


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a turn's text and role are claims on the conversation, turn + 1 the time."""
    entity = key("conv-", "conv_id")
    pointers = F.array(reference("conversation", entity, "text"), pointer("text", text(F.col("text"))), reference("speaker", entity, "role"), pointer("role", text(F.col("role"))))
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return log(read(spark, sf_dir, "conversations"), numbered("turn-", seq), F.col("turn") + 1, F.lit("host-0"), F.lit("loader"), pointers, seq)


def language_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents vote for the language of their source."""
    pointers = F.array(reference("source", F.col("source"), "lang"), pointer("lang", text(F.col("lang"))))
    return log(read(spark, sf_dir, "documents"), numbered("doc-", "doc_id"), F.col("doc_id") + 1, F.lit("host-0"), F.lit("loader"), pointers, F.col("doc_id"))


def defect_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as deltas, of which some have faults: a blank creator, time 0, no pointers, a number with a context."""
    rest = F.col("doc_id") % 10
    entity = key("doc-", "doc_id")
    plain = F.array(reference("document", entity, "source"), pointer("source", text(F.col("source"))))
    odd = F.array(pointer("document", number(F.col("doc_id")), F.lit("source")))
    pointers = F.when(rest == 3, F.slice(plain, 1, 0)).when(rest == 4, odd).otherwise(plain)
    creator = F.when(rest == 1, "").otherwise("loader")
    return log(read(spark, sf_dir, "documents"), numbered("doc-", "doc_id"), F.when(rest == 2, 0).otherwise(F.col("doc_id") + 1), F.lit("host-0"), creator, pointers, F.col("doc_id"))
