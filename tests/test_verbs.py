"""Values on tiny frames."""

import pytest
from pyspark.sql import functions as F

from manygrain import (
    NA, MarginError, across, categorical, cube, everything, expand_with_margins, grouping_bit, grouping_id, grouping_set, grouping_sets, if_all, if_any, inspect_grouping,
    is_na_level, nest_by_with_margins, nest_with_margins, pick, retail_sales, rollup, share_across, share_of_parent, share_of_total, starts_with, summarise_with_margins, summarize_with_margins, where,
)

n_ = lambda: F.count(F.lit(1))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_is_not_total(spark):
    df = spark.createDataFrame([("x", "u", 1.0), (None, "u", 2.0)], "a string, b string, value double")
    out = summarize_with_margins(df, id_=grouping_id("a", "b"), v=F.sum("value"), grouping=rollup("a", "b"))
    assert sorted(rows(out), key=str) == sorted([("x", "u", 0, 1.0), (None, "u", 0, 2.0), ("x", "Total", 1, 1.0), (None, "Total", 1, 2.0), ("Total", "Total", 3, 3.0)], key=str)


@pytest.mark.parametrize("method", ["native", "explode"])
def test_order_and_measure_keys(spark, method):
    df = spark.createDataFrame([("East", "s2", 1), ("East", "s1", 2), ("West", "s4", 4), ("West", "s3", 8)], "region string, store string, units int")
    last = summarize_with_margins(df, u=F.sum("units"), top=F.max("region"), grouping=rollup("region", "store"), sort="last", method=method)
    assert [r[:3] for r in rows(last)] == [("East", "s1", 2), ("East", "s2", 1), ("East", "Total", 3), ("West", "s3", 8), ("West", "s4", 4), ("West", "Total", 12), ("Total", "Total", 15)]
    assert rows(last)[-1][3] == "West"
    first = summarize_with_margins(df, u=F.sum("units"), grouping=rollup("region", "store"), sort="first", method=method)
    assert [r[:2] for r in rows(first)] == [("Total", "Total"), ("East", "Total"), ("East", "s1"), ("East", "s2"), ("West", "Total"), ("West", "s3"), ("West", "s4")]


def test_shares(spark):
    df = spark.createDataFrame([("E", "a", 10.0), ("E", "b", 30.0), ("W", "c", 60.0)], "region string, store string, revenue double")
    out = summarize_with_margins(df, {"r": F.sum("revenue"), "p": share_of_parent("r"), "t": share_of_total("r")}, grouping=rollup("region", "store"), sort="last")
    assert [tuple(round(x, 6) for x in r[3:]) for r in rows(out)] == [(0.25, 0.1), (0.75, 0.3), (0.4, 0.4), (1.0, 0.6), (0.6, 0.6), (1.0, 1.0)]
    zero = summarize_with_margins(spark.createDataFrame([("x", 5), ("y", -5)], "g string, v int"), s=F.sum("v"), t=share_of_total("s"), grouping=rollup("g"), sort="last")
    assert [r[2] for r in rows(zero)] == [None, None, 1.0]
    keyed = spark.createDataFrame([(None, "x", 3), (None, None, 1), ("B", "x", 6), ("B", None, 2)], "p string, g string, v int")
    out = summarize_with_margins(keyed, s=F.sum("v"), t=share_of_total("s"), by="p", grouping=rollup("g"))
    assert sorted(r[3] for r in rows(out)) == [0.25, 0.25, 0.75, 0.75, 1.0, 1.0]
    twice = summarize_with_margins(df, r=F.sum("revenue"), t=share_of_total("r"), grouping=grouping_sets("region", grouping_set(), grouping_set()), duplicates="keep", id="i", sort="last")
    assert [(r[1], r[3]) for r in rows(twice)] == [(1, 0.4), (1, 0.6), (2, 1.0), (3, 1.0)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    for method in ("native", "explode"):
        assert rows(summarize_with_margins(df, n=n_(), s=F.sum("v"), t=share_of_total("n"), grouping=rollup("g"), method=method)) == [("Total", 0, None, 1.0)]
    assert rows(summarize_with_margins(df, n=n_(), by="g", grouping=None)) == []
    assert rows(nest_with_margins(df)) == [] and rows(nest_by_with_margins(df)) == [([],)]
    assert rows(nest_by_with_margins(df, grouping=rollup("g"))) == []


def test_labels(spark):
    df = spark.createDataFrame([("Total", 1), ("x", 2)], "a string, value int")
    out = summarize_with_margins(df, bit=grouping_bit("a"), v=F.sum("value"), grouping=rollup("a"))
    assert sorted(rows(out)) == [("Total", 0, 1), ("Total", 1, 3), ("x", 0, 2)]
    with pytest.raises(MarginError, match="occurs"):
        summarize_with_margins(df, grouping=rollup("a"), check_margin_label=True)
    typed = summarize_with_margins(df.withColumn("k", F.lit(1)), n=n_(), grouping=rollup("k"), margin_label=None)
    assert typed.schema["k"].dataType.simpleString() == "int"
    with pytest.raises(MarginError):
        summarize_with_margins(df, grouping=rollup("a"), margin_label={"value": "All"})
    with pytest.raises(MarginError, match="level"):
        summarize_with_margins(categorical(df, "a", ["x", "Total"]), grouping=rollup("a"))
    sized = categorical(spark.createDataFrame([("small",), ("large",), ("medium",)], "size string"), "size", ["small", "medium", "large"], True)
    assert [r[0] for r in rows(summarize_with_margins(sized, n=n_(), grouping=rollup("size"), sort="last"))] == ["small", "medium", "large", "Total"]
    assert rows(summarize_with_margins(df, n=n_(), grouping=rollup("a"), margin_label=NA, check_margin_label=True))


def test_names_and_refusals(spark):
    df = spark.createDataFrame([("x", 1, 2)], "`a.b` string, mg_set int, mg_key_0 int")
    assert sorted(rows(expand_with_margins(df, grouping=rollup("a.b"), id="i"))) == [("Total", 2, 1, 2), ("x", 1, 1, 2)]
    for bad in ({"a.b": n_()}, {"n": 1}, {"n": share_of_total("m")}, {"n": n_(), "N": n_()}):
        with pytest.raises(MarginError):
            summarize_with_margins(df, bad, grouping=rollup("a.b"))
    with pytest.raises(MarginError):
        summarize_with_margins(df, n=n_(), p=share_of_parent("n"), grouping=cube("mg_set"))
    with pytest.raises(MarginError):
        summarize_with_margins("no table")
    with pytest.raises(MarginError):
        nest_with_margins(df, grouping=rollup("mg_set"), duplicates="keep")


def test_across_nest_inspect(spark):
    df = spark.createDataFrame([(2026, 1.0), (2025, 2.0), (2026, 3.0)], "year int, value double")
    out = summarize_with_margins(df, across(everything(), F.count), grouping=rollup("year"))
    assert out.columns == ["year", "value"] and sorted(r[1] for r in rows(out)) == [1, 2, 3]
    kept = nest_with_margins(df, grouping=rollup("year"), keep=True).collect()
    assert {r["year"]: sorted(x["year"] for x in r["data"]) for r in kept} == {"2026": [2026, 2026], "2025": [2025], "Total": [2025, 2026, 2026]}
    keys = nest_with_margins(df.select("year"), grouping=rollup("year")).collect()
    assert sorted(len(r["data"]) for r in keys) == [1, 2, 3]
    plan = inspect_grouping(df, grouping=rollup("year"), format="list").collect()
    assert [(r["included"], r["grouping_bits"], r["grouping_id"]) for r in plan] == [(["year"], {"year": 0}, 0), ([], {"year": 1}, 1)]
    assert retail_sales(spark).count() == 24 and retail_sales(spark).where("store is null").count() == 4


def test_many_columns(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{k}") for k in range(66)])
    out = summarize_with_margins(wide, n=n_(), grouping=grouping_sets(everything(), grouping_set()))
    assert sorted(r["n"] for r in out.collect()) == [1, 1, 1, 3]


def test_no_job_runs(spark):
    df = spark.createDataFrame([("x", 1)], "a string, v int")
    spark.sparkContext.setJobGroup("quiet", "quiet")
    summarize_with_margins(df, n=n_(), t=share_of_total("n"), grouping=rollup("a"), sort="last", id="i")
    nest_with_margins(df, grouping=rollup("a"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quiet")
    spark.sparkContext.setJobGroup("other", "other")


def test_helpers_inside_expressions(spark):
    df = spark.createDataFrame([("x", "u", 1), ("x", "v", 2), ("y", "u", 4)], "a string, b string, v int")
    out = summarize_with_margins(df, {"kind": F.when(grouping_bit("a") == 1, "all").when(grouping_bit("b") == 1, "sub").otherwise("cell"), "neg": -grouping_bit("b"), "one": F.coalesce(grouping_id("a", "b"), F.lit(9)), "w": F.sum("v") * (1 + grouping_bit("b"))}, grouping=rollup("a", "b"), sort="last")
    assert [r[2:] for r in rows(out)] == [("cell", 0, 0, 1), ("cell", 0, 0, 2), ("sub", -1, 1, 6), ("cell", 0, 0, 4), ("sub", -1, 1, 8), ("all", -1, 3, 14)]
    fixed = summarize_with_margins(df, k=F.when(grouping_bit("a") == 0, F.sum("v")), by="a", grouping=None, sort="last")
    assert rows(fixed) == [("x", 3), ("y", 4)]
    for bad in ({"k": F.when(grouping_bit("v") == 1, 1)}, {"k": F.when(grouping_bit("zz") == 1, 1)}):
        with pytest.raises(MarginError):
            summarize_with_margins(df, bad, grouping=rollup("a"))
    with pytest.raises(MarginError, match="alone"):
        summarize_with_margins(df, k=F.when(grouping_bit("a") == 1, 1), grouping=rollup("a"), method="explode")


def test_selections(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 0, 5), ("y", 3, 4)], "g string, p int, q int")
    out = summarize_with_margins(df, {"any": if_any(everything(), F.isnull).then(F.count_if), "all": if_all(["p", "q"], lambda c: c > 0).then(F.count_if), "packed": across(everything(), F.sum), "seen": pick(everything()).then(F.count)}, grouping=rollup("g"), sort="last")
    assert [(r[1], r[2], tuple(r[3]), r[4]) for r in rows(out)] == [(1, 0, (1, 5), 2), (0, 1, (3, 4), 1), (1, 1, (4, 9), 3)] and out.schema["packed"].dataType.names == ["p", "q"]
    loose = summarize_with_margins(df, {"n": n_()}, F.struct(F.min("p").alias("low"), F.max("p").alias("high")), grouping=rollup("g"), sort="last")
    assert loose.columns == ["g", "n", "low", "high"] and [r[2:] for r in rows(loose)] == [(0, 1), (3, 3), (0, 3)]
    shares = summarize_with_margins(df, {"p": F.sum("p"), "pq": F.sum("q"), "n": n_()}, share_across(starts_with("p"), "total", "{col}_share"), grouping=rollup("g"), sort="last")
    assert shares.columns == ["g", "p", "pq", "n", "p_share", "pq_share"] and [r[4] for r in rows(shares)] == [0.25, 0.75, 1.0]
    for bad in (lambda: summarize_with_margins(df, F.max("p"), grouping=rollup("g")), lambda: summarize_with_margins(df, {"n": n_()}, F.struct(F.min("p").alias("N")), grouping=rollup("g")), lambda: share_across(where(lambda f: True), "total", "{col}_"), lambda: summarize_with_margins(df, {"k": across(["g"], F.max)}, grouping=rollup("g"))):
        with pytest.raises(MarginError):
            bad()


def test_one_error_class(spark):
    df = spark.createDataFrame([("x", 1)], "a string, v int")
    n = {"n": n_()}
    for bad in (
        lambda: inspect_grouping("x"), lambda: summarize_with_margins(df, n, grouping=rollup("a"), method="bogus"), lambda: summarize_with_margins(df, n, grouping=rollup("a"), check_share_source="x"),
        lambda: summarize_with_margins(df, grouping=rollup("a"), margin_labels=n_()), lambda: summarize_with_margins(df, grouping=rollup("a"), metho=n_()), lambda: share_of_total("n") * 2, lambda: -share_of_total("n"),
        lambda: summarize_with_margins(df, {**n, "s": share_of_total("n"), "z": F.col("s") + 1}, grouping=rollup("a")), lambda: summarize_with_margins(df, {**n, "m": F.col("n") * 2, "s": share_of_total("m")}, grouping=rollup("a")),
        lambda: summarize_with_margins(categorical(df, "a", ["x", None]), n, grouping=rollup("a"), margin_label=NA),
    ):
        with pytest.raises(MarginError):
            bad()
    assert is_na_level(categorical(df, "a", ["x", None]).schema, "a") and summarize_with_margins(df, margins=n_(), grouping=rollup("a")).count() == 2


def test_label_position(spark):
    df = categorical(spark.createDataFrame([("b", 1), ("a", 2)], "g string, v int"), "g", ["b", "a"])
    for position, levels in (("first", ["All", "b", "a"]), ("last", ["b", "a", "All"])):
        out = summarize_with_margins(df, n=n_(), grouping=rollup("g"), margin_label="All", margin_label_position=position, sort="last")
        assert out.schema["g"].metadata["levels"] == levels and [r[0] for r in rows(out)] == ["b", "a", "All"]
    assert rows(summarise_with_margins(df, grouping=rollup("g"), sort="last")) == [("b",), ("a",), ("Total",)]


def test_inputs_are_read_once(spark, tmp_path):
    """Shares and the total of data without rows add no pass over the inputs."""
    spark.range(100).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/t")
    spark.range(7).select(F.col("id").alias("b"), F.col("id").cast("string").alias("name")).write.parquet(f"{tmp_path}/u")
    t, u = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/u")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for given, inputs in ((t, 2), (t.join(u, "b"), 2)):  # a bare scan is looked at for one row, a join is not planned again
        out = summarize_with_margins(given, {"s": F.sum("v"), "p": share_of_parent("s"), "t": share_of_total("s")}, grouping=rollup("a", "b"), sort="last")
        assert (plan(out).count("Relation ["), plan(out).count("Expand"), plan(out).count("Join Inner")) == (inputs, 1, int(given is not t))
        assert [r[-2:] for r in rows(out)][-1] == (1.0, 1.0) and rows(out.where("a = '0' and b = 'Total'"))[0][3] == pytest.approx(1683 / 4950)
        none = summarize_with_margins(given.where("v < 0"), {"n": n_(), "t": share_of_total("n")}, grouping=rollup("a"), sort="last")
        assert rows(none) == [("Total", 0, 1.0)]


def test_shares_brute_force(spark):
    """Every share against plain arithmetic: null keys, zero and null values, many groups, fixed keys."""
    import itertools
    import random

    rng = random.Random(3)
    data = [(rng.choice(["p", "q", None]), rng.choice([None, *"abcdef"]), rng.choice([None, *range(40)]), rng.choice([None, -1, 0, 2, 5])) for _ in range(600)]
    df = spark.createDataFrame(data, "k string, a string, b int, v int")

    def summed(keep):
        out: dict = {}
        for r in data:
            key = tuple(r[i] if i in keep else "*" for i in range(3))
            got = out.setdefault(key, [])
            got.append(r[3])
        return {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in out.items()}

    levels = [summed(x) for x in ((0, 1, 2), (0, 1), (0,))]
    share = lambda x, y: None if x is None or not y else x / y
    want = []
    for depth, level in enumerate(levels):
        for key, value in level.items():
            up = lambda d: tuple(k if i < 3 - d else "*" for i, k in enumerate(key))
            want.append((*key, value, 1.0 if depth == 2 else share(value, levels[depth + 1][up(depth + 1)]), 1.0 if depth == 2 else share(value, levels[2][up(2)])))
    got = rows(summarize_with_margins(df, {"s": F.sum("v"), "p": share_of_parent("s"), "t": share_of_total("s")}, by="k", grouping=rollup("a", "b"), margin_label="*"))
    norm = lambda rs: sorted([repr((*[str(x) for x in r[:3]], r[3], *[None if x is None else round(x, 9) for x in r[4:]])) for r in rs])
    assert norm(got) == norm(want) and len(list(itertools.chain(*levels))) == len(got)


def test_many_dimensions_and_awkward_names(spark):
    names = [f"d.{k} `x`" for k in range(12)]
    df = spark.createDataFrame([tuple(f"{(r >> k) & 1}" for k in range(12)) + (r,) for r in range(40)], [*names, "v a.l"])
    spec, what = rollup(*names), {"s u.m": F.sum("`v a.l`"), "to p": share_of_parent("s u.m"), "to t": share_of_total("s u.m")}
    native = summarize_with_margins(df, what, grouping=spec, id="set")
    exploded = summarize_with_margins(df, what, grouping=spec, id="set", method="explode")
    assert native.columns == exploded.columns == [*names, "set", "s u.m", "to p", "to t"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, native.collect()), key=key) == sorted(map(tuple, exploded.collect()), key=key)
    for r in native.where("`set` >= 12").collect():
        assert r["to t"] == r["s u.m"] / 780 and r["to p"] == (1.0 if r["set"] == 13 else r["s u.m"] / 780)
    for method in ("native", "explode"):
        none = summarize_with_margins(df.limit(0), what, grouping=spec, id="set", method=method).collect()
        assert [tuple(r) for r in none] == [("Total",) * 12 + (13, None, 1.0, 1.0)]


def test_widest_native_plan(spark):
    names = [f"c{k}" for k in range(64)]
    df = spark.range(3).select(*[F.col("id").alias(n) for n in names])
    out = summarize_with_margins(df, n=F.count(F.lit(1)), bit=grouping_bit("c0"), last=grouping_bit("c63"), grouping=grouping_sets(grouping_set(*names), grouping_set(*names[1:]), grouping_set("c0"), grouping_set()), id="set", margin_label=None)
    got = [(r["set"], r["n"], r["bit"], r["last"]) for r in out.collect()]
    assert sorted(got) == [(1, 1, 0, 0)] * 3 + [(2, 1, 1, 0)] * 3 + [(3, 1, 0, 1)] * 3 + [(4, 3, 1, 1)]
