import pytest
from pyspark.sql import functions as F

from strandlake.functions.builder import tagged
from strandlake.functions.jsonlogic import OperatorError
from strandlake.operators import collections, compose, nested, query, schemas
from tests.logs import Log

USER = schemas.SchemaBuilder("user").name("User").property("name", schemas.string(required=True)).property("age", schemas.number()).property("email", schemas.string()).property("active", schemas.boolean()).build()
SUMMARY = schemas.Schema("user-summary", "Summary", {"name": schemas.string(required=True), "email": schemas.string()})


def users(spark):
    log = Log(spark)
    for i, (name, age, email) in enumerate([("Alice", 25, "a"), ("Bob", 30, "b"), ("Charlie", 35, "c"), ("Diana", 20, None)], 1):
        log.set(f"user{i}", "name", name).set(f"user{i}", "age", age)
        if email:
            log.set(f"user{i}", "email", email)
    return log


@pytest.mark.parametrize(
    "logic,ids",
    [
        (None, "1234"), ({">": [{"var": "age"}, 28]}, "23"), ({"in": ["A", {"var": "name"}]}, "1"), ({"==": [{"var": "email"}, None]}, "4"), ({">": [{"var": "name"}, 25]}, ""),
        ({"or": [{">": [{"var": "age"}, 30]}, {"and": [{"<": [{"var": "age"}, 25]}, {"!=": [{"var": "email"}, None]}]}]}, "3"), ({"<": [{"var": "active"}, 1]}, "1234"),
    ],
)
def test_filters(spark, logic, ids):
    got = query.query(compose.claims(users(spark).frame()), USER, logic)
    assert {r.id for r in got.collect()} == {f"user{i}" for i in ids} and got.columns == ["id", "name", "age", "email", "active"]


def test_limits_errors_and_single_entities(spark):
    found = compose.claims(users(spark).set("nameless", "age", 3).frame())
    rows, total, limited = query.query_with_total(found, USER, max_results=2)
    assert [r.id for r in rows.collect()] == ["user1", "user2"] and total == 4 and limited
    assert query.query(found, USER, max_results=0).count() == 4
    with pytest.raises(OperatorError):
        query.query(found, USER, {"bad": [1]})
    assert query.query_one(found, USER, "user3").first().age == 35 and query.query_one(found, USER, "nameless").count() == 0
    assert {(r.schema_id, r.candidates) for r in query.statistics(found, [USER]).collect()} == {(None, 5), ("user", 4)}


def test_resolution_order(spark):
    log = users(spark).set("user1", "age", 99, 5000).set("user1", "age", 11, 1)
    found = compose.claims(log.frame())
    assert query.query_one(found, USER, "user1").first().age == 99
    assert query.query(found, USER, first_write=True).where("id = 'user1'").first().age == 11
    # a wrong type isn't in the typed column
    assert query.query(compose.claims(log.set("user1", "age", "old", 9000).frame()), USER).where("id = 'user1'").first().age is None


def test_raw_candidates(spark):
    """Required properties may be looked up among all claims, those taken back included."""
    log = Log(spark).set("u", "name", "x", delta_id="A").set("u", "age", 1).negate("A", "N").frame()
    assert query.query(compose.claims(log), USER).count() == 0
    assert query.query(compose.claims(log), USER, raw=compose.claims_of(log)).first().name is None


def test_storage_engine(spark):
    log = users(spark).negate("d000", "N").frame()
    assert query.storage_query(log, USER, use_indexes=False).count() == 4, "negations play no part"
    by_index = {r.id: (r.name, r.age) for r in query.storage_query(log, USER).collect()}
    assert by_index["user2"] == ("Bob", None), "other deltas aren't read"
    assert query.storage_query(log, USER, {"==": [{"substr": [{"var": "name"}, 0, 2]}, "Ch"]}, use_indexes=False).count() == 1
    assert query.storage_query(log, USER, use_indexes=False, where=F.col("delta_id") < "d003").count() == 1


def test_schema_registry_and_validation(spark):
    registry = schemas.Registry(USER, SUMMARY)
    assert registry.get("user") is USER and len(registry.list()) == 2 and not registry.has_cycle()
    with pytest.raises(ValueError):
        registry.register(schemas.Schema("x", "X", {}, required=("y",)))
    with pytest.raises(ValueError):
        registry.register(schemas.Schema("x", "X", {"a": schemas.primitive("date")}))
    with pytest.raises(ValueError):
        registry.register(schemas.Schema("x", "X", {"a": schemas.array_of(schemas.string(), max_items=-1)}))
    with pytest.raises(ValueError):
        schemas.SchemaBuilder("x").build()
    registry.register(schemas.Schema("loop", "Loop", {"self": schemas.reference("loop")}))
    assert registry.has_cycle() and registry.dependencies()["loop"] == {"loop"}
    strict = schemas.Schema("s", "S", {"name": schemas.string(required=True), "age": schemas.number(), "friend": schemas.reference("nobody"), "tags": schemas.array_of(schemas.string())}, additional_properties=False)
    log = Log(spark).set("a", "name", "x").set("a", "age", 5).set("b", "name", 3).set("b", "age", "x").set("c", "age", 1).set("a", "friend", "z").set("a", "extra", 1).set("a", "tags", "t")
    found = compose.claims(log.frame())
    got = {r.entity_id: (r.valid, r.n_errors, r.n_warnings) for r in schemas.validate(found, strict, registry).collect()}
    assert got == {"a": (True, 0, 3), "b": (False, 2, 0), "c": (False, 1, 0)}
    stats = schemas.validation_statistics(found, strict, registry).first()
    assert (stats.entities, stats.valid, stats.invalid, stats.with_warnings) == (3, 1, 2, 1)
    assert {r.property for r in schemas.apply_schema(found, strict).collect()} == {"name", "age", "friend", "tags"}
    whole = schemas.applied(found, strict, registry)
    assert {(r.entity_id, r.valid, r.depth, r.truncated) for r in whole.collect()} == {("a", True, 1, False), ("b", False, 1, False), ("c", False, 1, False)}
    assert "applied_at" not in schemas.applied(found.where("entity_id = 'a'"), strict, registry, strict=True, metadata=False).columns
    with pytest.raises(ValueError, match="entity b, property age"):
        schemas.applied(found, strict, registry, strict=True)


def test_collections(spark):
    log = Log(spark).set("u1", "name", "x", label="users").set("u2", "name", 5, label="users").set("o", "name", "y", label="others")
    c = collections.Collection("users", compose.claims(log.frame()), SUMMARY, schemas.Registry(SUMMARY), strict=True)
    assert {r.entity_id for r in c.ids().collect()} == {"u1", "u2"}
    assert [r.entity_id for r in c.valid().collect()] == ["u1"] and [r.entity_id for r in c.invalid().collect()] == ["u2"]
    assert c.statistics().first().entities == 2 and c.views().count() == 2
    with pytest.raises(ValueError):
        c.put("u1", {"name": 5}, "a", "h", 9, 100)
    assert c.put("u1", {"name": "x", "id": "u1"}, "a", "h", 9, 100) == []
    assert len(c.put("u1", {"name": "new"}, "a", "h", 9, 100)) == 1
    more = c.put("u1", {"name": "new", "email": "e"}, "a", "h", 9, 100)
    assert len(more) == 3, "a declaration and two members"
    log.rows += more
    after = compose.claims(log.frame())
    # the older name has the later time here: new values win only with later times
    assert {(r.property, r.value.s) for r in collections.resolve(after, "u1").collect()} == {("name", "x"), ("email", "e")}


def test_changes_compare_kinds(spark):
    found = compose.claims(Log(spark).set("e", "p", 1).set("e", "q", "1").frame())
    wanted = spark.createDataFrame([("e", "p", tagged(1)), ("e", "q", tagged(1)), ("e", "r", tagged(None))], "entity_id string, property string, value struct<kind:string,s:string,n:double,b:boolean>")
    assert {r.property for r in collections.changes(found, wanted).collect()} == {"q", "r"}


def friends(spark):
    log = Log(spark)
    for name in ("alice", "bob", "charlie"):
        log.set(name, "name", name)
    log.link([("users", "alice", "friends"), ("friend", "bob", "friend_of")], "f1").link([("users", "alice", "friends"), ("friend", "charlie", "friend_of")], "f2")
    log.link([("users", "bob", "mentor"), ("m", "charlie", "mentees")], "m1").link([("users", "alice", "mentor"), ("m", "bob", "mentees")], "m2")
    registry = schemas.Registry(schemas.Schema("person", "Person", {"name": schemas.string(), "friends": schemas.array_of(schemas.reference("person", 2)), "mentor": schemas.reference("person", 3)}))
    return compose.claims(log.frame()), registry


def test_nesting_and_depth(spark):
    found, registry = friends(spark)
    one = nested.objects(found, registry, "person", "alice", 1)
    assert {n["id"] for n in one["nested"]["friends"]} == {"bob", "charlie"} and all(n["truncated"] for n in one["nested"]["friends"])
    two = nested.objects(found, registry, "person", "alice", 3)
    bob = two["nested"]["mentor"][0]
    assert bob["id"] == "bob" and not bob["truncated"] and bob["depth"] == 1 and bob["properties"]["name"] == ["bob"]
    assert bob["nested"]["mentor"][0]["id"] == "charlie" and bob["nested"]["mentor"][0]["nested"]["mentor"] == []
    assert nested.objects(found, registry, "person", "nobody") is None
    shallow = schemas.Registry(schemas.Schema("person", "Person", {"mentor": schemas.reference("person", 1)}))
    assert {r.depth for r in nested.steps(found, shallow, "person", ["alice"], 3).collect()} == {1}


def test_cycles_end_with_the_depth(spark):
    log = Log(spark).set("a", "name", "a").set("b", "name", "b").link([("users", "a", "mentor"), ("m", "b", "x")], "ab").link([("users", "b", "mentor"), ("m", "a", "x")], "ba")
    registry = schemas.Registry(schemas.Schema("person", "Person", {"mentor": schemas.reference("person", 9)}))
    rows = nested.steps(compose.claims(log.frame()), registry, "person", ["a"], 4).collect()
    assert sorted(r.depth for r in rows) == [1, 2, 3, 4] and [r.kind for r in rows if r.depth == 4] == ["truncated"]


def test_composites(spark):
    log = Log(spark).set("alice", "name", "Alice").set("bob", "name", "Bob").set("website", "title", "W")
    log.link([("projects", "website", "collaborations"), ("developer", "alice", "work"), ("designer", "bob", "work"), ("budget", 50000), ("deadline", "2024-06-01")], "c1")
    log.link([("projects", "website", "collaborations"), ("developer", "ghost"), ("budget", 1)], "c2")
    registry = schemas.Registry(SUMMARY, schemas.Schema("project", "Project", {"collaborations": schemas.array_of(schemas.reference("user-summary", 3))}))
    out = nested.objects(compose.claims(log.frame()), registry, "project", "website", 3)["nested"]["collaborations"]
    by = {n["id"]: n for n in out}
    assert by["composite-c1"]["properties"] == {"budget": 50000.0, "deadline": "2024-06-01"}
    assert {k: [n["id"] for n in v] for k, v in by["composite-c1"]["nested"].items()} == {"developer": ["alice"], "designer": ["bob"]}
    assert by["composite-c2"]["properties"] == {"developer": "ghost", "budget": 1.0} and by["composite-c2"]["nested"] == {}


def test_composites_are_judged_in_place(spark, monkeypatch):
    log = Log(spark).set("alice", "name", "Alice").set("bob", "name", "Bob").set("website", "title", "W").set("shop", "title", "S")
    log.link([("projects", "website", "work"), ("developer", "alice", "does"), ("designer", "bob", "does"), ("note", "nobody"), ("budget", 5)], "c1")
    log.link([("projects", "website", "work"), ("developer", "alice", "does")], "c2").link([("projects", "shop", "work"), ("developer", "ghost"), ("budget", 1)], "c3")
    log.link([("projects", "shop", "work")], "c4")
    registry = schemas.Registry(SUMMARY, schemas.Schema("project", "Project", {"work": schemas.array_of(schemas.reference("user-summary", 3))}))
    found = compose.claims(log.frame(), negations=False, transactions=False)

    def steps(names):
        return nested.steps(found, registry, "project", spark.createDataFrame([(n,) for n in names], "entity_id string"), 2)

    def rows(frame):
        return sorted((r.root, r.delta_id, r.kind, r.label or "", r.node_id or "") for r in frame.collect())

    # neither claims nor slots are exchanged, and no level is stored that leads nowhere
    plan = steps(["website", "shop"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "ExistingRDD[root")), plan
    wanted = [("website", "c1", "composite", "", "composite-c1"), ("website", "c1", "entity", "designer", "bob"), ("website", "c1", "entity", "developer", "alice"), ("website", "c1", "scalar", "budget", ""), ("website", "c1", "scalar", "note", ""), ("website", "c2", "entity", "developer", "alice")]
    shop = [("shop", "c3", "composite", "", "composite-c3"), ("shop", "c3", "scalar", "budget", ""), ("shop", "c3", "scalar", "developer", "")]
    # with many texts that name nothing, or many claims of others, they are joined
    for few in (nested.FEW, 1, 0):
        monkeypatch.setattr(nested, "FEW", few)
        assert rows(steps(["website", "shop"])) == sorted(shop + wanted)
        assert rows(steps(["website", "nobody"])) == wanted
