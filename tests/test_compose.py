from pyspark.sql import functions as F

from strandlake.operators import compose, negation, transactions
from tests.logs import Log

CAST = [("actor", "keanu", "roles"), ("role", "neo", "actor"), ("film", "the_matrix", "cast"), ("base_salary", 1000000), ("salary_currency", "usd")]


def visible(frame):
    return {(r.entity_id, r.property, r.delta_id) for r in frame.collect()}


def test_a_hyperedge_belongs_to_each_entity(spark):
    found = compose.claims(Log(spark).link(CAST, "d").frame())
    assert visible(found) == {("keanu", "roles", "d"), ("neo", "actor", "d"), ("the_matrix", "cast", "d")}
    labels = {r.entity_id: r.referenced_as for r in compose.referenced_as(found).collect()}
    assert labels == {"keanu": ["actor"], "neo": ["role"], "the_matrix": ["film"]}
    back = compose.decompose(compose.views(found)).collect()
    assert len(back) == 1 and len(back[0].pointers) == 5


def test_filter_selection_and_counts(spark):
    log = Log(spark).set("ace", "value", "1", creator="A", host="H", label="ace").set("ace", "value", "14", creator="B", host="H", label="ace").set("king", "value", "13").frame()
    assert compose.claims(log, ["ace"]).count() == 2
    assert [r.value.s for r in compose.claims(log, ["ace"], (F.col("creator") == "A") & (F.col("host") == "H")).collect()] == ["1"]
    assert {(r.entity_id, r.n_deltas) for r in compose.property_counts(compose.claims(log)).collect()} == {("ace", 2), ("king", 1)}
    ids = spark.createDataFrame([("king",)], "entity_id string")
    assert compose.claims(log, ids).count() == 1 and compose.entity_ids(compose.claims(log)).count() == 2


def test_the_last_arrival_of_an_id_counts(spark):
    log = Log(spark).set("e", "p", 1, delta_id="d").set("e", "p", 2, delta_id="d").frame()
    assert [r.pointers[1].target.n for r in compose.deduplicated(log).collect()] == [2.0]


def test_negation_chain(spark):
    log = Log(spark).set("e", "p", "v", delta_id="A").negate("A", "B").negate("B", "C").negate("C", "D")
    assert compose.claims(log.frame()).count() == 0
    active = {r.negation_id for r in negation.active_negations(negation.edges(log.frame())).collect()}
    assert active == {"B", "D"}
    log.rows.pop()
    assert visible(compose.claims(log.frame())) == {("e", "p", "A")}


def test_a_long_negation_chain_is_settled_to_its_head(spark):
    depth = 206  # more than a hundred rounds
    links = [(f"N{i:03}", f"N{i - 1:03}" if i else "A") for i in range(depth)]
    found = spark.createDataFrame(links, "negation_id string, negated_id string").coalesce(1)
    active = {r.negation_id for r in negation.active_negations(found).collect()}
    assert active == {f"N{i:03}" for i in range(depth - 1, -1, -2)}


def test_several_negations_missing_targets_and_cycles(spark):
    log = Log(spark).set("e", "name", "Alice", delta_id="A").set("e", "age", 25, delta_id="G").negate("A", "B").negate("A", "C").negate("nothing", "N").negate("Y", "X").negate("X", "Y").negate("S", "S")
    assert visible(compose.claims(log.frame())) == {("e", "age", "G")}
    got = negation.statistics(log.frame()).first()
    assert (got.total, got.negations, got.negated, got.effective) == (8, 6, 1, 1)
    assert negation.is_negated(log.frame(), "A") and not negation.is_negated(log.frame(), "G")
    assert {r.delta_id for r in negation.negations_for(log.frame(), "A").collect()} == {"B", "C"}
    by = {r.property: (r.total, r.negated) for r in negation.property_statistics(log.frame()).collect()}
    assert by == {"name": (1, 1), "age": (1, 0)}


def test_strict_arrival(spark):
    log = Log(spark).negate("A", "B").set("e", "p", 1, delta_id="A").frame()
    assert compose.claims(log).count() == 0 and compose.claims(log, strict_arrival=True).count() == 1


def test_chronological(spark):
    log = Log(spark).set("post", "text", "a", 1000, "P").negate("P", "N", 2000).set("post", "text", "b", 3000, "E").negate("E", "M", 2500)
    assert {r.delta_id for r in negation.chronological(log.frame()).collect()} == {"E"}
    same = Log(spark).set("e", "p", 1, 5, "A").negate("A", "N", 5).frame()
    assert negation.chronological(same).count() == 0


def test_negation_comes_before_the_filter(spark):
    log = Log(spark).set("e", "p", 1, delta_id="A").negate("A", "B").frame()
    assert compose.claims(log, where="delta_id <> 'B'").count() == 0


def test_transactions_hide_until_complete(spark):
    log = Log(spark).declare("t", 3).set("u", "name", "x", tx="t").set("u", "age", 1, tx="t").set("u", "free", 2)
    props = lambda: {r.property for r in compose.claims(log.frame(), ["u"]).collect()}
    assert props() == {"free"}
    log.set("u", "email", "e", tx="t")
    assert props() == {"free", "name", "age", "email"}
    log.set("u", "extra", "e", tx="t")
    assert props() == {"free"}, "one too many hides them again"
    log.declare("t", 4)
    assert len(props()) == 5
    got = transactions.status(log.frame()).first()
    assert (got.transaction_id, got.size, got.received, got.complete) == ("t", 4.0, 4, True)
    assert {r.entity_id for r in transactions.entities_of(log.frame()).collect()} == {"t", "u"}


def test_undeclared_transactions_stay_hidden_and_members_may_come_first(spark):
    log = Log(spark).set("u", "a", 1, tx="none").set("u", "b", 1, tx="late").declare("late", 1)
    assert {r.property for r in compose.claims(log.frame(), ["u"]).collect()} == {"b"}


def test_a_negation_in_an_incomplete_transaction_negates(spark):
    from strandlake.functions.builder import DeltaBuilder

    log = Log(spark).set("e", "p", 1, delta_id="A").declare("t", 2)
    log.add(DeltaBuilder("a", "h").with_id("B").with_timestamp(9).negate("A").in_transaction("t"))
    assert compose.claims(log.frame(), ["e"]).count() == 0


def test_point_in_time(spark):
    log = Log(spark).set("e", "p", 1, 10).set("e", "p", 2, 20).frame()
    assert compose.claims(compose.at_time(log, 15)).count() == 1


def test_empty_log(spark):
    log = Log(spark).set("e", "p", 1).frame().limit(0)
    assert compose.claims(log).count() == 0 and negation.statistics(log).first().total == 0


def _hyperedges(spark):
    log = Log(spark)
    for i in range(12):
        log.link([("actor", f"a{i % 5}", "roles"), ("film", f"f{i % 3}", "cast"), ("self", f"a{i % 5}", "named"), ("salary", i)], f"d{i}")
    return log.link([("actor", "a1", "roles"), ("film", "f1", "cast"), ("self", "a1", "named"), ("salary", 1)], "d1")  # delivered again


def test_views_take_one_exchange(spark):
    found = compose.claims(_hyperedges(spark).frame(), negations=False, transactions=False)
    views = compose.views(found)
    assert views._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    by = {r.entity_id: r for r in views.collect()}
    assert {e: r.referenced_as for e, r in by.items()} == {r.entity_id: r.referenced_as for r in compose.referenced_as(found).collect()}
    assert [d.delta_id for d in by["a2"].property_deltas["roles"]] == ["d2", "d7"] and set(by["a2"].property_deltas) == {"roles", "named"}


def test_deltas_come_back_from_all_views(spark):
    found = compose.claims(_hyperedges(spark).frame(), negations=False, transactions=False)
    ids = lambda frame: sorted(r.delta_id for r in frame.collect())
    every = sorted(f"d{i}" for i in range(12))
    assert ids(compose.decompose(compose.views(found))) == every == ids(compose.decompose(compose.views(found), whole=True))
    for rounds in (1, 3):
        back = compose.recomposed(found.withColumn("n", F.size("pointers")), ("time_created", "n"), rounds)
        assert ids(back) == every and {r.n for r in back.collect()} == {4}
        assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("strandlake_views")]
    # of some entities' views too, whichever claim of a delta they hold
    assert ids(compose.decompose(compose.views(found.where("entity_id = 'f1'")))) == sorted(f"d{i}" for i in range(12) if i % 3 == 1)
    empty = compose.recomposed(found.where("false"))
    assert empty.count() == 0 and empty.columns == compose.decompose(compose.views(found)).columns
