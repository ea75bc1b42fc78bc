"""The algebra of grouping sets, without data."""

import pytest
from pyspark.sql.types import IntegerType, StringType, StructType

from manygrain import MarginError, all_of, cube, grouping_set, grouping_sets, grouping_spec, rollup, starts_with
from manygrain.plans.plan import compile_plan

SCHEMA = StructType()
for name in ("a", "b", "c", "d", "country", "state"):
    SCHEMA = SCHEMA.add(name, StringType())
SCHEMA = SCHEMA.add("year", IntegerType()).add("value", IntegerType())


def sets(spec, **options):
    return ["".join(s) if all(len(x) == 1 for x in s) else s for s in compile_plan(SCHEMA, grouping=spec, **options).sets]


def test_families():
    assert sets(rollup("a", "b", "c")) == ["abc", "ab", "a", ""]
    assert sets(cube(grouping_set("country", "state"), "year")) == [("country", "state", "year"), ("country", "state"), ("year",), ""]
    assert sets(grouping_spec(rollup("a", "b"), cube("c"))) == ["abc", "ab", "ac", "a", "c", ""]
    assert sets(grouping_sets(rollup("a", "b"), cube("c", "d")), duplicates="drop") == ["ab", "a", "", "cd", "c", "d"]
    assert sets(grouping_sets(all_of(["a", "b"]), "c")) == ["ab", "c"]
    assert sets(grouping_spec()) == [""] and sets(None) == [""]
    assert sets(rollup(starts_with("s"), "a")) == [("state", "a"), ("state",), ""]


def test_targets():
    plan = compile_plan(SCHEMA, grouping=rollup("a", "a", "b"), duplicates="keep")
    assert [plan.sets[i - 1] for i in plan.ids] == [("a", "b"), ("a",), ("a",), ()]
    assert plan.parent_targets() == {1: 2, 2: 4, 3: 4, 4: None} and plan.total_targets() == {1: 4, 2: 4, 3: 4, 4: None}


@pytest.mark.parametrize("spec", [rollup(), cube(grouping_set()), grouping_sets(), grouping_set(rollup("a")), rollup(cube("a")), rollup("nope"), grouping_sets("a", "a")])
def test_refusals(spec):
    with pytest.raises(MarginError):
        compile_plan(SCHEMA, grouping=spec)


def test_clashes_and_messages():
    with pytest.raises(MarginError, match="share"):
        compile_plan(SCHEMA, by="a", grouping=rollup("a"))
    with pytest.raises(MarginError, match="1, 2; 3, 4"):
        compile_plan(SCHEMA, grouping=grouping_sets("a", "a", "b", "b"))
    with pytest.raises(MarginError, match="told apart"):
        compile_plan(StructType().add("a", IntegerType()).add("A", IntegerType()), grouping=rollup("a"))
    assert repr(rollup("a")) == "<grouping specification: rollup>"
