import pytest

from strandlake.operators import compose, folds, resolvers
from tests.logs import Log, values


def claims(log):
    return compose.claims(log.frame())


def test_last_write(spark):
    assert values(resolvers.last_write(claims(Log(spark).set("e", "score", 10, 1000).set("e", "score", 20, 2000)))) == {("e", "score"): 20}
    assert values(resolvers.last_write(claims(Log(spark).set("e", "v", "newer", 2000).set("e", "v", "older", 1000)))) == {("e", "v"): "newer"}
    # falsy values are values
    assert values(resolvers.last_write(claims(Log(spark).set("e", "v", 1, 1).set("e", "v", None, 2)))) == {("e", "v"): None}


@pytest.mark.parametrize(
    "tie,first,second,winner",
    [
        ("creator", dict(creator="user_z"), dict(creator="user_a"), 10), ("host", dict(host="h_a"), dict(host="h_z"), 20), ("delta-id", dict(delta_id="b"), dict(delta_id="a"), 10),
        ("delta-id", dict(delta_id="B"), dict(delta_id="a"), 10), ("lexicographic", dict(delta_id="a"), dict(delta_id="b"), 20),
    ],
)
def test_ties(spark, tie, first, second, winner):
    log = Log(spark).set("e", "v", 10, **first).set("e", "v", 20, **second)
    assert values(resolvers.last_write(claims(log), tie)) == {("e", "v"): winner}


def test_lexicographic_ties_of_texts(spark):
    log = Log(spark).set("e", "v", "pear", delta_id="z").set("e", "v", "Zebra", delta_id="a").set("e", "v", "apple", delta_id="y")
    assert values(resolvers.last_write(claims(log), "lexicographic")) == {("e", "v"): "Zebra"}
    assert values(resolvers.last_arrival_write(claims(log))) == {("e", "v"): "apple"}


def test_aggregates(spark):
    log = Log(spark).set("a", "score", 10).set("b", "score", -5).set("a", "score", 20).set("a", "name", "x").set("c", "other", 1)
    got = values(resolvers.aggregate(claims(log), {"score": "sum", "name": "count"}))
    assert got == {("a", "score"): 30, ("b", "score"): -5, ("a", "name"): 0}
    for kind, want in (("min", 10), ("max", 20), ("average", 15), ("count", 2)):
        assert values(resolvers.aggregate(claims(log), kind))["a", "score"] == want


def test_plugins(spark):
    log = Log(spark).set("e", "tags", "red", 1000).set("e", "tags", "blue", 3000).set("e", "tags", "green", 2000).set("e", "tags", None, 500).set("e", "tags", "red", 4000)
    assert values(resolvers.concatenation_plugin(claims(log))) == {("e", "tags"): "red green blue"}
    votes = Log(spark).set("e", "v", "no", 2000).set("e", "v", "no", 2500).set("e", "v", "yes", 1000).set("e", "v", "yes", 1500)
    assert values(resolvers.majority_plugin(claims(votes))) == {("e", "v"): "no"}
    kinds = Log(spark).set("e", "v", 1).set("e", "v", "1").set("e", "v", "1")
    assert values(resolvers.majority_plugin(claims(kinds))) == {("e", "v"): "1"}
    mean = Log(spark).set("e", "v", "not a number").set("e", "v", 10)
    assert values(resolvers.running_average_plugin(claims(mean))) == {("e", "v"): 5}
    zero = Log(spark).set("e", "v", 3, 1).set("e", "v", 0, 2)
    assert values(resolvers.last_write_plugin(claims(zero))) == {("e", "v"): ""}
    first = Log(spark).set("e", "v", 3, 5).set("e", "v", None, 2)
    assert values(resolvers.first_write_plugin(claims(first))) == {("e", "v"): None}
    assert values(resolvers.extreme_plugin(claims(Log(spark).set("e", "t", -5).set("e", "t", -10)), True)) == {("e", "t"): -5}


def test_last_write_plugin_keeps_falsy_values_on_demand(spark):
    log = Log(spark).set("e", "v", 3, 1).set("e", "v", 0, 2).set("e", "b", True, 1).set("e", "b", False, 2).set("e", "n", "x", 1).set("e", "n", None, 2)
    assert values(resolvers.last_write_plugin(claims(log), falsy_as_empty=False)) == {("e", "v"): 0, ("e", "b"): False, ("e", "n"): None}
    assert values(resolvers.last_write_plugin(claims(log))) == {("e", "v"): "", ("e", "b"): "", ("e", "n"): ""}


def test_negation_retracts(spark):
    log = Log(spark).set("e", "v", 1, 1, "A").set("e", "v", 9, 2, "B").negate("B", "N")
    assert values(resolvers.last_write(claims(log))) == {("e", "v"): 1}
    assert values(resolvers.aggregate(claims(log), "sum")) == {("e", "v"): 1}


def _last(state, value, claim, resolved):
    return value


def test_plugin_dependencies(spark):
    log = Log(spark)
    for i, t in enumerate((22, 25, 18, 30, 20)):
        log.set("room", "temperature", t, 1000 * (i + 1))
    plugins = {
        "average": folds.Plugin(lambda: None, _last, lambda s, r: (r["low"] + r["high"]) / 2, depends_on=("low", "high")),
        "high": folds.Plugin(lambda: float("-inf"), lambda s, v, c, r: max(s, v), lambda s, r: s, reads="temperature"),
        "low": folds.Plugin(lambda: float("inf"), lambda s, v, c, r: min(s, v), lambda s, r: s, reads="temperature"),
        "temperature": folds.Plugin(lambda: None, _last, lambda s, r: s),
    }
    assert values(folds.fold(claims(log), plugins)) == {("room", "temperature"): 20, ("room", "high"): 30, ("room", "low"): 18, ("room", "average"): 24}
    for largest, want in ((True, 30), (False, 18)):
        assert [r.value for r in resolvers.extreme_of_resolved(claims(log), "temperature", largest).collect()] == [want]


def test_dependency_faults(spark):
    p = lambda *d: folds.Plugin(lambda: 0, _last, lambda s, r: s, depends_on=d)
    with pytest.raises(folds.DependencyError, match="dependency discount not found for plugin price"):
        folds.in_order({"price": p("discount")})
    with pytest.raises(folds.DependencyError, match="circular"):
        folds.in_order({"a": p("b"), "b": p("a")})
    aliased = {"a": p("other"), "b": folds.Plugin(lambda: 0, _last, lambda s, r: s, aliases=("other",))}
    assert folds.in_order(aliased) == ["b", "a"]


def test_reducer(spark):
    log = Log(spark).link([("actor", "keanu", "roles"), ("role", "neo", "actor"), ("film", "the_matrix", "cast")])
    found = folds.reduce_entities(claims(log), list, lambda s, c: [*s, c["property"]], lambda s: {"roles": ",".join(s)}, "entity_id string, roles string")
    assert {(r.entity_id, r.roles) for r in found.collect()} == {("keanu", "roles"), ("neo", "actor"), ("the_matrix", "cast")}
