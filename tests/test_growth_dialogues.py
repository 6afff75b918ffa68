"""dialogue_task_rows: turns are shuffled once, in compact form, and not at all from dialogues to task rows."""

import pytest
from pyspark.sql import functions as F

from turnlens.operators.dialogue_rows import REPRESENTATIONS, task_rows_of_dialogues
from turnlens.sources import files
from turnlens.sources import fixtures as fx

SLOTS = ("service string, service_desc string, slot string, slot_desc string, is_categorical boolean, "
         "possible_values string, slot_pos int")


def shuffles(node) -> list[tuple[int, list[str]]]:
    """``(bytes of its rows, their columns)`` of every shuffle of a plan that has run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffles(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffles(node.plan())
    under = [x for i in range(node.children().size()) for x in shuffles(node.children().apply(i))]
    return under + ([(node.metrics().get("dataSize").get().value(), list(node.schema().fieldNames()))] if name == "Exchange" else [])


def ran(df):
    rows = df.collect()
    return rows, shuffles(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def dialogues(spark):
    act = lambda slot, *values: ("INFORM", slot, list(values), [v.upper() for v in values])
    frame = lambda service, *acts: (service, list(acts), ("Find",))
    user = ("USER", "hi", [])
    rows = [("d1", ["A_1"], [user, ("SYSTEM", "red one", [frame("A_1", act("colour", "red"))]), user,
                             ("SYSTEM", "red and big", [frame("A_1", act("colour", "red")), frame("A_1", act("size", "big"))])]),
            ("d2", ["B_1"], [("SYSTEM", "small", [frame("B_1", act("size", "small"))]), (None, "who", []), ("SYSTEM", "no frames", [])]),
            (None, None, [("SYSTEM", "nobody", [frame(None, act("size", "small"))])]), ("d3", [], None)]
    return spark.createDataFrame(rows, files.SC.RAW_DIALOGUE)


@pytest.fixture(scope="module")
def services(spark):
    slots = [(s, f"{s} service", n, f"the {n}", c, "", 0) for s in ("A_1", "B_1", None) for n, c in (("colour", False), ("size", True))]
    temps = [(s, f"INFORM!!{n}!!@", f"The {n} is @.") for s in ("A_1", "B_1", None) for n in ("colour", "size")]
    return spark.createDataFrame(slots, SLOTS), spark.createDataFrame(temps, "service string, act_key string, template string")


WANT = {
    "naive": ["service_name=A_1 | inform,colour, values = red", "service_name=A_1 | inform,colour, values = red | service_name=A_1 | inform,size, values = big",
              "service_name=B_1 | inform,size, values = small"],
    "schema_guided": [f"service_name={s},description={{schema['description']}} | inform,name={n},description=the {n}, values = {v}" for s, n, v in
                      (("A_1", "colour", "red"), ("A_1", "colour", "red"), ("B_1", "size", "small"))],
    "t2g2": ["The colour is RED.", "The colour is RED. The size is BIG.", "The size is SMALL."],
}
WANT["schema_guided"][1] += " | service_name=A_1,description={schema['description']} | inform,name=size,description=the size, values = big"


@pytest.mark.parametrize("delex", [False, True])
@pytest.mark.parametrize("representation", REPRESENTATIONS)
def test_task_rows_shuffle_no_turn(spark, dialogues, services, representation, delex):
    rows, moved = ran(task_rows_of_dialogues(dialogues, representation, *services, delex=delex, canonical=not delex))
    assert moved == []
    assert len(rows) == 5
    got = {(r["dialog_id"], r["turn_id"]): r for r in rows}
    if not delex:
        inputs = [got[k]["input"] for k in (("d1", 0), ("d1", 1), ("d2", 0))]
        assert inputs == [f"SYSTEM | {x}" for x in WANT[representation]]
    assert got["d2", 1]["input"] == got[None, 0]["input"] == "SYSTEM"
    assert [got[k]["target"] for k in (("d1", 0), ("d1", 1), ("d2", 1), (None, 0))] == \
        (["<colour> one", "<colour> and big", None, "nobody"] if delex else ["red one", "red and big", "no frames", "nobody"])


def test_every_record_numbers_its_own_turns(spark, dialogues, services):
    twice = dialogues.where("dialogue_id = 'd1'").unionByName(dialogues.where("dialogue_id = 'd1'"))
    rows = task_rows_of_dialogues(twice, "naive", *services).collect()
    assert sorted((r["turn_id"], r["input"]) for r in rows) == \
        sorted((i, f"SYSTEM | {x}") for i, x in enumerate(WANT["naive"][:2]) for _ in range(2))


def test_several_services_are_told_even_when_rows_are_only_counted(spark, services):
    turn = ("SYSTEM", "both", [("A_1", [], ("Find",)), ("B_1", [], ("Find",))])
    both = spark.createDataFrame([("d1", [], [turn])], files.SC.RAW_DIALOGUE)
    assert task_rows_of_dialogues(both, "t2g2", *services).count() == 1
    with pytest.raises(Exception, match="several services in a turn of dialogue d1"):
        task_rows_of_dialogues(both, "naive").count()


def test_raw_dialogues_shuffle_less_than_they_hold(spark, sf_dir):
    raw = fx.raw_dialogues(spark, sf_dir)
    rows, moved = ran(raw)
    by_dialogue = [x for x, columns in moved if "dialog_id" in columns and "turn_key" not in columns]
    held = raw.select(F.sum(F.length(F.to_json("turns")))).first()[0]
    assert len(by_dialogue) == 1 and by_dialogue[0] < held
    assert not any("p_type" in columns and "l_orderkey" in columns for _, columns in moved)   # parts go on as one text per line
    assert len(rows) == len({r["dialogue_id"] for r in rows})
