import pytest

from strandlake.functions import builder as b
from strandlake.functions.validation import FormatError, MissingFieldError, PointerError, split_valid, validate_image
from strandlake.sources import wire
from tests.logs import Log

IMAGE = {"id": "1", "timeCreated": 5, "host": "h", "creator": "c", "pointers": [{"localContext": "user", "target": "u1", "targetContext": "name"}, {"localContext": "name", "target": 3.5}]}


def test_builder_pointers_and_wire_forms():
    d = b.DeltaBuilder("c", "h").with_id("1").with_timestamp(5).set_property("u1", "name", 3.5, "user").build(7)
    assert b.to_v1(d) == IMAGE
    assert b.to_v2(d)["pointers"] == {"user": {"u1": "name"}, "name": 3.5}
    assert b.from_image(IMAGE, 7) == d and b.from_image(b.to_v2(d), 7) == d
    with pytest.raises(PointerError):
        b.DeltaBuilder("c", "h").add_pointer("a", 1).add_pointer("a", 2)
    b.DeltaBuilder("c", "h").add_pointer("a", 1).add_pointer("a", 1)
    # a context without a text target makes a scalar
    assert b.DeltaBuilder("c", "h").add_pointer("a", 1, "x").build()["pointers"][0]["target_context"] is None


def test_relations_transactions_and_negations():
    d = b.DeltaBuilder("c", "h").relate("a", "b", "knows", {"since": 2020}, "rel-1").in_transaction("t").negate("x").build()
    labels = [p["local_context"] for p in d["pointers"]]
    assert labels == ["_rel_source", "source", "_rel_target", "target", "_rel_type", "type", "_rel_since", "since", "_transaction", "_negates"]
    d = b.DeltaBuilder("c", "h").declare_transaction("t", 3).build()
    assert [(p["local_context"], p["target"]["s"], p["target"]["n"]) for p in d["pointers"]] == [("_transaction", "t", None), ("size", None, 3.0)]


@pytest.mark.parametrize(
    "change,error",
    [
        ({"id": ""}, FormatError), ({"id": 3}, FormatError), ({"timeCreated": 0}, FormatError), ({"timeCreated": "1"}, FormatError), ({"host": ""}, FormatError),
        ({"creator": None}, FormatError), ({"pointers": []}, FormatError), ({"pointers": "x"}, FormatError), ({"pointers": {}}, FormatError),
        ({"pointers": [{"localContext": "", "target": 1}]}, PointerError), ({"pointers": [{"localContext": "a", "target": [1]}]}, PointerError),
        ({"pointers": [{"localContext": "a", "target": 1, "targetContext": "p"}]}, PointerError), ({"pointers": [{"localContext": "a", "target": "e", "targetContext": ""}]}, PointerError),
        ({"pointers": {"a": {"e": ""}}}, PointerError), ({"pointers": {"a": {"e": "p", "f": "q"}}}, PointerError), ({"pointers": {"": 1}}, PointerError),
    ],
)
def test_faults(change, error):
    with pytest.raises(error):
        validate_image(IMAGE | change)


def test_missing_fields_come_first():
    for field in IMAGE:
        with pytest.raises(MissingFieldError) as e:
            validate_image({k: v for k, v in IMAGE.items() if k != field} | ({"host": 3} if field != "host" else {}))
        assert e.value.field == field
    validate_image(IMAGE | {"pointers": {"a": None, "b": {"e": "p"}, "c": False}})


def test_error_codes_split_a_log(spark):
    log = Log(spark).set("e", "p", 1).set("e", "p", 2)
    log.rows[1]["creator"] = ""
    log.rows.append(log.rows[0] | {"delta_id": "x", "pointers": None})
    good, bad = split_valid(log.frame())
    assert good.count() == 1 and {r.error_code for r in bad.collect()} == {"format:creator", "missing:pointers"}


def test_wire_lines_round_trip(spark):
    log = Log(spark).set("e", "p", 'a "quoted"\n text').set("e", "n", 5).set("e", "f", 1.25).set("e", "b", False).set("e", "z", None).set("e", "s", "12").frame()
    back = wire.from_lines(wire.to_lines(log), "peer")
    assert [r.pointers for r in back.orderBy("delta_id").collect()] == [r.pointers for r in log.orderBy("delta_id").collect()]
    import json

    assert json.loads(wire.to_lines(log).first()[0])["pointers"][1]["target"] == 'a "quoted"\n text'
    broken = spark.createDataFrame([("{",)], "value string")
    good, bad = split_valid(wire.from_lines(broken))
    assert good.count() == 0 and bad.count() == 1
