import pytest
from pyspark.sql import functions as F

from strandlake.functions import json_ast
from strandlake.operators import compose
from strandlake.operators.resolvers import last_write
from strandlake.sources import store as s
from strandlake.sources import wire
from strandlake.streaming import views
from tests.logs import Log, values


def sample(spark):
    log = Log(spark).set("user1", "name", "A", 1000, "delta1", "alice", "host1").set("user1", "age", 25, 2000, "delta2", "bob", "host1").set("user2", "name", "B", 3000, "delta3", "alice", "host2")
    return log.frame()


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_stores(spark, tmp_path, kind):
    store = s.open_store(spark, kind, f"{tmp_path}/log")
    assert store.log().count() == 0 and store.next_seq() == 0
    store.append(sample(spark))
    ids = lambda f: [r.delta_id for r in f.collect()]
    assert ids(store.get("delta2")) == ["delta2"] and store.get("none").count() == 0
    assert store.scan("creator = 'alice'").count() == 2 and store.next_seq() == 3
    assert sorted(ids(store.for_entity("user1"))) == ["delta1", "delta2"] and ids(store.by_context("user1", "age")) == ["delta2"]
    q = s.LogQuery
    assert ids(store.find(q(creator="alice"))) == ["delta1", "delta3"] and store.count(q(host="host1")) == 2
    assert store.count(q(entities=("user1",))) == 2 and store.count(q(contexts=("name",))) == 2 and ids(store.find(q(creator="alice", entities=("user1",)))) == ["delta1"]
    assert ids(store.find(q(limit=2))) == ["delta1", "delta2"] and ids(store.find(q(offset=1))) == ["delta2", "delta3"] and ids(store.find(q(offset=1, limit=1))) == ["delta2"]
    assert store.count(q(created_after=2000)) == 2 and store.count(q(created_before=2000)) == 2 and store.count(q(created_after=0, limit=0)) == 3
    got = store.statistics().first()
    assert (got.total_deltas, got.total_entities, got.oldest, got.newest) == (3, 2, 1000, 3000)
    store.append(sample(spark).withColumn("ingest_seq", F.col("ingest_seq") + 10))
    assert store.log().count() == 3, "ids are stored once"
    target = s.open_store(spark, "parquet", f"{tmp_path}/copy")
    assert s.migrate(store, target) == 3
    assert s.migrate(store, s.open_store(spark, "parquet", f"{tmp_path}/batches"), batches=3) == 3
    class Careless(s.MemoryStore):
        def append(self, deltas):
            super().append(deltas.withColumn("creator", F.lit("mallory")))

    with pytest.raises(RuntimeError, match="3 deltas"):
        s.migrate(store, Careless(spark))  # the ids arrive, their content doesn't
    if kind == "parquet":
        assert store.compact(f"{tmp_path}/compact", 2).log().count() == 3
    store.clear()
    assert store.log().count() == 0
    for bad in ({"kind": "sqlite"}, {"kind": "parquet"}):
        with pytest.raises(ValueError):
            s.open_store(spark, **bad)


def test_unions_and_peers(spark):
    a, b = sample(spark).withColumn("received_from", F.lit("p1")), sample(spark).withColumn("received_from", F.lit("p2")).withColumn("ingest_seq", F.col("ingest_seq") + 5)
    assert wire.union_logs(a, b).count() == 3
    assert {(r.received_from, r.n_deltas) for r in wire.counts_by_peer(a.unionByName(b.limit(1))).collect()} == {("p1", 3), ("p2", 1)}
    host, port = wire.parse_address(F.lit("localhost:4000"))
    assert tuple(spark.range(1).select(host, port).first()) == ("localhost", 4000)
    several = wire.parse_addresses(F.lit("a:1, b:2x,,c"))
    got = [tuple(r) for r in spark.range(1).select(several.alias("a")).first().a]
    assert got == [("a", 1), ("b", 2), ("c", None)]
    assert spark.range(1).select(wire.address_text(F.lit("a"), F.lit(1)).alias("t")).first().t == "a:1"


def test_policies(spark):
    parts = views.split_by_policy(sample(spark), F.when(F.col("creator") == "bob", "defer").otherwise("anything"))
    assert {k: v.count() for k, v in parts.items()} == {"accept": 2, "reject": 0, "defer": 1}


def test_incremental_view_equals_batch(spark, tmp_path):
    """Late deltas, negations of negations, and a transaction that completes, all in batches of their own."""
    log = Log(spark).set("e", "p", "new", 2000, "A").set("f", "p", 1, 1, "F").declare("t", 2).set("g", "p", 1, 5, "G1", tx="t").negate("A", "N").set("e", "p", "old", 1000, "B").negate("N", "NN")
    log.set("g", "q", 2, 6, "G2", tx="t").negate("F", "NF")
    whole = log.frame()
    folder = f"file://{tmp_path}/view"
    view = views.IncrementalView(spark, folder)
    seen = []
    for i in range(len(log.rows)):
        batch = whole.where(F.col("ingest_seq") == i)
        view.ingest(batch, i)
        seen.append(i)
        want = values(last_write(compose.claims(whole.where(F.col("ingest_seq").isin(seen)))))
        assert values(view.current()) == want, i
    view.ingest(whole.where("ingest_seq = 0"), 99)  # a repeated delta changes nothing
    want = values(last_write(compose.claims(whole)))
    assert values(view.current()) == want
    view.compact(99)
    assert values(view.current()) == want


def test_batches_that_are_delivered_again(spark, tmp_path):
    """After they were finished, and after a failure between the log and the view."""
    log = Log(spark).set("e", "p", "new", 2000, "A").declare("t", 2).set("g", "p", 1, 5, "G1", tx="t").negate("A", "N").set("e", "p", "old", 1000, "B").set("g", "q", 2, 6, "G2", tx="t")
    whole = log.frame()
    view = views.IncrementalView(spark, f"file://{tmp_path}/view")
    parts = [whole.where("ingest_seq < 3"), whole.where("ingest_seq = 3 OR ingest_seq = 4"), whole.where("ingest_seq = 5")]
    for i, part in enumerate(parts):
        view.write_log(part, i)  # the attempt that failed
        view.ingest(part, i)
        view.ingest(part, i)
        want = values(last_write(compose.claims(whole.where(F.col("ingest_seq") <= (2, 4, 5)[i]))))
        assert values(view.current()) == want, i
    assert view.related(spark.createDataFrame([("A",)], "key string"), 9).count() == 2


def test_stream_from_files(spark, tmp_path):
    whole = Log(spark).set("e", "p", "new", 2000, "A").set("e", "p", "old", 1000, "B").set("f", "p", 1, 1, "F").frame()
    for i in (2, 0, 1):
        whole.where(F.col("ingest_seq") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = views.received(views.read_log(spark, f"{tmp_path}/in"))
    view = views.IncrementalView(spark, f"file://{tmp_path}/view")
    view.run(stream, f"{tmp_path}/cp")
    assert values(view.current()) == {("e", "p"): "new", ("f", "p"): 1}


def test_notices_and_publishing(spark, tmp_path):
    """Which entities a batch recomputed and which transactions it completed; deltas as lines for peers."""
    log = Log(spark).declare("t", 2).set("g", "p", 1, 5, "G1", tx="t").set("g", "q", 2, 6, "G2", tx="t").set("e", "p", 1, 7, "E")
    whole = log.frame()
    for seqs in ((0, 1), (2,), (3,)):
        whole.where(F.col("ingest_seq").isin(*seqs)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = {}
    view = views.IncrementalView(spark, f"file://{tmp_path}/view")
    view.run(
        views.read_log(spark, f"{tmp_path}/in"), f"{tmp_path}/cp",
        lambda k, entities, done: told.update({k: ({r.entity_id for r in entities.collect()}, {r.transaction_id for r in done.collect()})}),
    )
    assert told == {0: ({"t", "g"}, set()), 1: ({"t", "g"}, {"t"}), 2: ({"e"}, set())}
    wire.publish(views.read_log(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp2")
    back = wire.from_lines(spark.read.text(f"{tmp_path}/out"))
    assert {r.delta_id for r in back.collect()} == {r.delta_id for r in whole.collect()}


def test_deferred(spark, tmp_path):
    whole = Log(spark).set("e", "p", 1, 1, "A").set("f", "p", 2, 1, "B").set("g", "p", 3, 1, "C").frame()
    view = views.IncrementalView(spark, f"file://{tmp_path}/view")
    later = views.Deferred(spark, f"file://{tmp_path}/later")
    parts = views.split_by_policy(whole, F.when(F.col("delta_id") > "A", "defer"))
    view.ingest(parts["accept"], 0)
    later.keep(parts["defer"], 0)
    assert set(values(view.current())) == {("e", "p")} and later.pending().count() == 2
    later.drain(view, 1)
    assert set(values(view.current())) == {("e", "p"), ("f", "p"), ("g", "p")} and later.pending().isEmpty()
    later.keep(whole.where("delta_id = 'C'"), 1)
    later.drain(view, 2)  # had before: changes nothing
    assert set(values(view.current())) == {("e", "p"), ("f", "p"), ("g", "p")}


def test_json_trees(spark):
    data = {"user": {"name": "x", "roles": ["a", "b"], "ok": True}, "n": None}
    t = json_ast.tree(data)
    paths = lambda n: [n.get("path")] + [p for c in n.get("children", ()) for p in paths(c)]
    assert paths(t) == [None, "user", "user.name", "user.roles", "user.roles[0]", "user.roles[1]", "user.ok", "n"]
    assert "path" not in json_ast.tree(data, include_path=False)["children"][0]
    assert json_ast.tree(data, max_depth=1)["children"][0]["children"][0]["value"] == json_ast.TOO_DEEP
    kept = json_ast.tree(data, keep=lambda n: n["type"] != "boolean")
    assert [c["key"] for c in kept["children"][0]["children"]] == ["name", "roles"]
    docs = spark.createDataFrame([(1, '{"a": [1, "x"]}'), (2, "not json"), (3, None)], "id long, j string")
    got = {(r.id, r.path, r.kind, r.value, r.depth) for r in json_ast.explode(docs, "id", "j").collect()}
    assert got == {("1", "", "object", None, 0), ("1", "a", "array", None, 1), ("1", "a[0]", "number", "1", 2), ("1", "a[1]", "string", "x", 2)}
