"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import (
    across,
    cube,
    everything,
    expand_with_margins,
    grouping_bit,
    grouping_id,
    grouping_set,
    grouping_sets,
    grouping_spec,
    if_all,
    if_any,
    inspect_grouping,
    nest_by_with_margins,
    nest_with_margins,
    pick,
    rollup,
    share_across,
    share_of_parent,
    share_of_total,
    starts_with,
    summarize_with_margins,
)
from .sources import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

count_ = lambda: F.count(F.lit(1))
CENTS = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))  # noqa: E731  whole cents add up alike in any order
SQL_CENTS = lambda c: f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS BIGINT)"


def total(column: str) -> str:
    return f"CASE WHEN GROUPING({column}) = 1 THEN 'Total' ELSE CAST({column} AS VARCHAR) END AS {column}"


def query(table: str, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(read_table(spark, folder, table))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("lineitem", f"SELECT {total('l_returnflag')}, {total('l_linestatus')}, CAST(sum(l_quantity) AS BIGINT) AS qty, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS gid, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_basic(df):
    return summarize_with_margins(df, {"qty": F.sum("l_quantity").cast("long"), "gid": grouping_id("l_returnflag", "l_linestatus").cast("long"), "n": count_()}, grouping=rollup("l_returnflag", "l_linestatus"))


@query("orders", f"SELECT {total('o_orderstatus')}, {total('o_orderpriority')}, count(*) AS n, {SQL_CENTS('o_totalprice')} AS cents FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_basic(df):
    return summarize_with_margins(df, n=count_(), cents=CENTS("o_totalprice"), grouping=cube("o_orderstatus", "o_orderpriority"))


@query("orders", f"SELECT {total('o_orderstatus')}, {total('o_orderpriority')}, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_explicit(df):
    return summarize_with_margins(df, n=count_(), grouping=grouping_sets("o_orderstatus", "o_orderpriority", grouping_set()))


@query("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def single_set(df):
    return summarize_with_margins(df, n=count_(), grouping=grouping_set("o_orderstatus", "o_orderpriority"))


@query("orders", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders")
def absent_grouping(df):
    return summarize_with_margins(df, n=count_(), top=F.max("o_orderkey"))


QUERIES["product_spec"] = lambda spark, d: summarize_with_margins(
    read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), n=count_(), qty=F.sum("l_quantity").cast("long"), grouping=grouping_spec(rollup("l_returnflag", "l_linestatus"), cube("o_orderstatus"))
)
ORACLES["product_spec"] = f"SELECT {total('l_returnflag')}, {total('l_linestatus')}, {total('o_orderstatus')}, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (l_returnflag, l_linestatus), CUBE (o_orderstatus)"


@query("lineitem", f"SELECT {total('l_returnflag')}, {total('l_linestatus')}, {total('l_linenumber')}, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), ())")
def composite_rollup(df):
    return summarize_with_margins(df, n=count_(), grouping=rollup(grouping_set("l_returnflag", "l_linestatus"), "l_linenumber"))


@query("lineitem", f"SELECT {total('l_returnflag')}, {total('l_linestatus')}, {total('l_linenumber')}, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), (l_linenumber), ())")
def composite_cube(df):
    return summarize_with_margins(df, n=count_(), grouping=cube(grouping_set("l_returnflag", "l_linestatus"), "l_linenumber"))


@query("customer", f"SELECT {total('c_nationkey')}, {total('c_mktsegment')}, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
def union_two_rollups_drop(df):
    return summarize_with_margins(df, n=count_(), grouping=grouping_sets(rollup("c_nationkey"), rollup("c_mktsegment")), duplicates="drop")


@query("customer", f"SELECT {total('c_nationkey')}, {total('c_mktsegment')}, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ()) UNION ALL SELECT 'Total', 'Total', count(*) FROM customer")
def union_two_rollups_keep(df):
    return summarize_with_margins(df, n=count_(), grouping=grouping_sets(rollup("c_nationkey"), rollup("c_mktsegment")), duplicates="keep")


@query("orders", f"SELECT o_orderstatus, {total('o_orderpriority')}, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))")
def fixed_by(df):
    return summarize_with_margins(df, n=count_(), by="o_orderstatus", grouping=rollup("o_orderpriority"))


@query("customer", f"SELECT {total('c_mktsegment')}, {total('c_nationkey')}, CAST(GROUPING(c_nationkey) AS INTEGER) AS bit, CAST(GROUPING(c_nationkey) * 2 + GROUPING(c_mktsegment) AS INTEGER) AS swapped, CAST(count(*) * (1 + GROUPING(c_mktsegment)) AS BIGINT) AS weighted FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def bit_and_id(df):
    return summarize_with_margins(df, bit=grouping_bit("c_nationkey"), swapped=grouping_id("c_nationkey", "c_mktsegment"), weighted=(1 + grouping_bit("c_mktsegment")) * count_(), grouping=rollup("c_mktsegment", "c_nationkey"))


_IDS = "CASE WHEN GROUPING(o_orderpriority) = 0 THEN 1 WHEN GROUPING(o_orderstatus) = 0 THEN 2 ELSE 3 END AS set_id"


@query("orders", f"SELECT {total('o_orderstatus')}, {total('o_orderpriority')}, {_IDS}, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def occurrence_id(df):
    return summarize_with_margins(df, n=count_(), grouping=rollup("o_orderstatus", "o_orderpriority"), id="set_id")


@query("orders", "SELECT o_orderstatus, 1 AS set_id, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'Total', 2, count(*) FROM orders UNION ALL SELECT o_orderstatus, 3, count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'Total', 4, count(*) FROM orders")
def occurrence_id_keep(df):
    return summarize_with_margins(df, n=count_(), grouping=grouping_sets(rollup("o_orderstatus"), rollup("o_orderstatus")), id="set_id", duplicates="keep")


@query("customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def null_label(df):
    return summarize_with_margins(df, n=count_(), grouping=rollup("c_nationkey", "c_mktsegment"), margin_label=None)


@query("customer", "SELECT CASE WHEN GROUPING(c_nationkey) = 1 THEN 'All nations' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def named_labels(df):
    return summarize_with_margins(df, n=count_(), grouping=rollup("c_nationkey", "c_mktsegment"), margin_label={"c_nationkey": "All nations", "c_mktsegment": None})


@query("events", "SELECT CASE WHEN GROUPING(kind) = 1 THEN 'Total' ELSE kind END AS kind, CAST(GROUPING(kind) AS INTEGER) AS bit, count(*) AS n FROM (SELECT nullif(event_type, 'click') AS kind FROM events) GROUP BY ROLLUP (kind)")
def null_vs_total(df):
    return summarize_with_margins(df.withColumn("kind", F.nullif("event_type", F.lit("click"))), bit=grouping_bit("kind"), n=count_(), grouping=rollup("kind"))


for _place in ("last", "first"):
    QUERIES[f"sort_{_place}"] = lambda spark, d, place=_place: summarize_with_margins(read_table(spark, d, "orders"), n=count_(), grouping=rollup("o_orderstatus", "o_orderpriority"), sort=place)
    ORACLES[f"sort_{_place}"] = f"SELECT {total('o_orderstatus')}, {total('o_orderpriority')}, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"


@query("orders", "SELECT CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY ROLLUP (o_orderpriority)")
def share_total(df):
    return summarize_with_margins(df, n=count_(), share=share_of_total("n"), grouping=rollup("o_orderpriority")).withColumn("share", F.round("share", 9))


@query("orders", f"WITH g AS (SELECT o_orderstatus, {total('o_orderpriority')}, count(*) AS n, GROUPING(o_orderpriority) AS b FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))) SELECT g.o_orderstatus, g.o_orderpriority, g.n, round(g.n::DOUBLE / t.n, 9) AS share FROM g JOIN g t ON t.b = 1 AND g.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus")
def share_total_by(df):
    return summarize_with_margins(df, n=count_(), share=share_of_total("n"), by="o_orderstatus", grouping=rollup("o_orderpriority")).withColumn("share", F.round("share", 9))


@query("orders", f"SELECT {total('o_orderstatus')}, {total('o_orderpriority')}, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def share_total_cube(df):
    return summarize_with_margins(df, n=count_(), share=share_of_total("n"), grouping=cube("o_orderstatus", "o_orderpriority")).withColumn("share", F.round("share", 9))


@query("customer", f"WITH g AS (SELECT c_nationkey AS a, c_mktsegment AS b, GROUPING(c_nationkey) AS ga, GROUPING(c_mktsegment) AS gb, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)) SELECT CASE WHEN g.ga = 1 THEN 'Total' ELSE CAST(g.a AS VARCHAR) END AS c_nationkey, CASE WHEN g.gb = 1 THEN 'Total' ELSE g.b END AS c_mktsegment, g.n, round(CASE WHEN g.ga = 1 THEN 1 ELSE g.n::DOUBLE / p.n END, 9) AS share FROM g LEFT JOIN g p ON p.gb = 1 AND p.ga = g.gb AND (g.gb = 1 OR p.a IS NOT DISTINCT FROM g.a)")
def share_parent(df):
    return summarize_with_margins(df, n=count_(), share=share_of_parent("n"), grouping=rollup("c_nationkey", "c_mktsegment")).withColumn("share", F.round("share", 9))


QUERIES["share_parent_3level"] = lambda spark, d: summarize_with_margins(
    read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")),
    n=count_(), share=share_of_parent("n"), grouping=rollup("r_name", "n_name", "c_mktsegment"),
).withColumn("share", F.round("share", 9))
ORACLES["share_parent_3level"] = f"""
WITH g AS (SELECT r_name AS a, n_name AS b, c_mktsegment AS c, GROUPING(r_name) + GROUPING(n_name) + GROUPING(c_mktsegment) AS lvl, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
SELECT CASE WHEN g.lvl >= 3 THEN 'Total' ELSE g.a END AS r_name, CASE WHEN g.lvl >= 2 THEN 'Total' ELSE g.b END AS n_name, CASE WHEN g.lvl >= 1 THEN 'Total' ELSE g.c END AS c_mktsegment,
  g.n, round(CASE WHEN g.lvl = 3 THEN 1 ELSE g.n::DOUBLE / p.n END, 9) AS share
FROM g LEFT JOIN g p ON p.lvl = g.lvl + 1 AND (p.lvl >= 3 OR p.a = g.a) AND (p.lvl >= 2 OR p.b = g.b)"""


@query("lineitem", f"""
WITH g AS (SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, GROUPING(l_returnflag) + GROUPING(l_linenumber) AS lvl, count(*) AS n
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), ()))
SELECT CASE WHEN g.lvl = 2 THEN 'Total' ELSE g.a END AS l_returnflag, CASE WHEN g.lvl = 2 THEN 'Total' ELSE g.b END AS l_linestatus, CASE WHEN g.lvl >= 1 THEN 'Total' ELSE CAST(g.c AS VARCHAR) END AS l_linenumber,
  g.n, round(CASE WHEN g.lvl = 2 THEN 1 ELSE g.n::DOUBLE / p.n END, 9) AS share
FROM g LEFT JOIN g p ON p.lvl = g.lvl + 1 AND (p.lvl = 2 OR (p.a = g.a AND p.b = g.b))""")
def share_parent_composite(df):
    return summarize_with_margins(df, n=count_(), share=share_of_parent("n"), grouping=rollup(grouping_set("l_returnflag", "l_linestatus"), "l_linenumber")).withColumn("share", F.round("share", 9))


@query("orders", f"WITH g AS (SELECT o_orderstatus, {total('o_orderpriority')}, count(*) AS n, GROUPING(o_orderpriority) AS b FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))) SELECT g.o_orderstatus, g.o_orderpriority, g.n, round(g.n::DOUBLE / t.n, 9) AS share FROM g JOIN g t ON t.b = 1 AND g.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus")
def share_parent_by(df):
    return summarize_with_margins(df, n=count_(), share=share_of_parent("n"), by="o_orderstatus", grouping=rollup("o_orderpriority")).withColumn("share", F.round("share", 9))


@query("customer", f"WITH c AS (SELECT c_mktsegment, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 1 END AS v FROM customer), g AS (SELECT c_mktsegment AS a, c_nationkey AS b, GROUPING(c_mktsegment) + GROUPING(c_nationkey) AS lvl, CAST(sum(v) AS BIGINT) AS n FROM c GROUP BY ROLLUP (c_mktsegment, c_nationkey)) SELECT CASE WHEN g.lvl = 2 THEN 'Total' ELSE g.a END AS c_mktsegment, CASE WHEN g.lvl >= 1 THEN 'Total' ELSE CAST(g.b AS VARCHAR) END AS c_nationkey, g.n, round(CASE WHEN g.lvl = 2 THEN 1 WHEN p.n = 0 THEN NULL ELSE g.n::DOUBLE / p.n END, 9) AS share FROM g LEFT JOIN g p ON p.lvl = g.lvl + 1 AND (p.lvl = 2 OR p.a = g.a)")
def share_zero_and_null_denominator(df):
    v = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") != "MACHINERY", 1)
    return summarize_with_margins(df.withColumn("v", v), n=F.sum("v"), share=share_of_parent("n"), grouping=rollup("c_mktsegment", "c_nationkey")).withColumn("share", F.round("share", 9))


@query("lineitem", f"SELECT {total('l_returnflag')}, min(l_orderkey) AS l_orderkey_lo, max(l_orderkey) AS l_orderkey_hi, min(l_partkey) AS l_partkey_lo, max(l_partkey) AS l_partkey_hi, min(l_suppkey) AS l_suppkey_lo, max(l_suppkey) AS l_suppkey_hi FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def across_multi(df):
    return summarize_with_margins(df.select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey"), across(starts_with("l_"), {"lo": F.min, "hi": F.max}), grouping=rollup("l_returnflag"))


@query("orders", f"SELECT {total('o_orderstatus')}, {total('o_orderpriority')}, CASE WHEN GROUPING(o_orderstatus) = 1 THEN 'all' WHEN GROUPING(o_orderpriority) = 1 THEN 'status' ELSE 'cell' END AS level, CAST(CASE WHEN GROUPING(o_orderpriority) = 1 THEN count(*) ELSE -count(*) END AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def helper_in_case(df):
    level = F.when(grouping_bit("o_orderstatus") == 1, "all").when(grouping_bit("o_orderpriority") == 1, "status").otherwise("cell")
    return summarize_with_margins(df, {"level": level, "n": F.when(grouping_bit("o_orderpriority") == 1, count_()).otherwise(-count_())}, grouping=rollup("o_orderstatus", "o_orderpriority"))


@query("lineitem", f"SELECT {total('l_returnflag')}, count(*) FILTER (l_linenumber > 5 OR l_suppkey > 5) AS some, count(*) FILTER (l_linenumber > 5 AND l_suppkey > 5) AS every, count(*) AS picked FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def if_any_if_all(df):
    some, big = df.select("l_returnflag", "l_linenumber", "l_suppkey"), lambda c: c > 5
    return summarize_with_margins(some, {"some": if_any(everything(), big).then(F.count_if), "every": if_all(everything(), big).then(F.count_if), "picked": pick(everything()).then(F.count)}, grouping=rollup("l_returnflag"))


@query("orders", f"SELECT {total('o_orderstatus')}, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY ROLLUP (o_orderstatus)")
def struct_unpacked(df):
    return summarize_with_margins(df, {"n": count_()}, F.struct(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")), grouping=rollup("o_orderstatus"))


@query("lineitem", f"SELECT {total('l_returnflag')}, CAST(sum(l_linenumber) AS BIGINT) AS l_lines, count(*) AS n, round(sum(l_linenumber)::DOUBLE / (SELECT sum(l_linenumber) FROM lineitem), 9) AS l_lines_part FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def share_selected(df):
    return summarize_with_margins(df, {"l_lines": F.sum("l_linenumber"), "n": count_()}, share_across(starts_with("l_"), "total", "{col}_part"), grouping=rollup("l_returnflag")).withColumn("l_lines_part", F.round("l_lines_part", 9))


@query("lineitem", f"SELECT {total('l_returnflag')}, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS n_part, round(sum(l_linenumber)::DOUBLE / (SELECT sum(l_linenumber) FROM lineitem), 9) AS lines_part FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def across_share(df):
    out = summarize_with_margins(df, {"n": count_(), "lines": F.sum("l_linenumber")}, share_across(["n", "lines"], "total", "{col}_part"), grouping=rollup("l_returnflag"))
    return out.withColumns({"n_part": F.round("n_part", 9), "lines_part": F.round("lines_part", 9)})


@query("nation", "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, 1 AS set_id, n_nationkey, n_name FROM nation UNION ALL SELECT 'Total', 2, n_nationkey, n_name FROM nation")
def expand_rows(df):
    return expand_with_margins(df, grouping=rollup("n_regionkey"), id="set_id")


@query("customer", "WITH e AS (SELECT c_mktsegment, c_custkey, c_acctbal FROM customer UNION ALL SELECT 'Total', c_custkey, c_acctbal FROM customer), m AS (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS mean FROM e) SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > mean) AS above FROM m GROUP BY 1")
def expand_then_window(df):
    rows = expand_with_margins(df, grouping=rollup("c_mktsegment"))
    rows = rows.withColumn("mean", F.avg("c_acctbal").over(Window.partitionBy("c_mktsegment")))
    return rows.groupBy("c_mktsegment").agg(count_().alias("n"), F.count(F.when(F.col("c_acctbal") > F.col("mean"), 1)).alias("above"))


@query("customer", f"SELECT {total('c_mktsegment')}, {total('c_nationkey')}, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def nest_rows(df):
    out = nest_with_margins(df, grouping=rollup("c_mktsegment", "c_nationkey"))
    return out.select("c_mktsegment", "c_nationkey", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0).cast("long"), lambda a, r: a + r["c_custkey"]).alias("ids"))


@query("nation", f"SELECT {total('n_regionkey')}, count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS regions FROM nation GROUP BY ROLLUP (n_regionkey)")
def nest_keep(df):
    out = nest_with_margins(df, grouping=rollup("n_regionkey"), keep=True)
    return out.select("n_regionkey", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0).cast("long"), lambda a, r: a + r["n_regionkey"]).alias("regions"))


@query("nation", f"SELECT {total('n_regionkey')}, CAST(1 + GROUPING(n_regionkey) AS INTEGER) AS set_id, max(n_name) AS last FROM nation GROUP BY ROLLUP (n_regionkey)")
def nest_by(df):
    out = nest_by_with_margins(df, grouping=rollup("n_regionkey"), id="set_id", key="rows")
    return out.select(*out.margin_keys, F.array_max(F.transform("rows", lambda r: r["n_name"])).alias("last"))


@query("lineitem", "SELECT * FROM (VALUES (1, '', 'l_returnflag, l_linestatus', '', 'l_returnflag=0, l_linestatus=0', 0), (2, '', 'l_returnflag', 'l_linestatus', 'l_returnflag=0, l_linestatus=1', 1), (3, '', '', 'l_returnflag, l_linestatus', 'l_returnflag=1, l_linestatus=1', 3)) t(set_id, fixed, included, omitted, grouping_bits, grouping_id)")
def inspect_rollup(df):
    return inspect_grouping(df, grouping=rollup("l_returnflag", "l_linestatus"))


@query("orders", "SELECT * FROM (VALUES (1, 'o_orderstatus', 'o_orderpriority, o_custkey', '', 'o_orderpriority=0, o_custkey=0', 0), (2, 'o_orderstatus', 'o_orderpriority', 'o_custkey', 'o_orderpriority=0, o_custkey=1', 1), (3, 'o_orderstatus', 'o_custkey', 'o_orderpriority', 'o_orderpriority=1, o_custkey=0', 2), (4, 'o_orderstatus', '', 'o_orderpriority, o_custkey', 'o_orderpriority=1, o_custkey=1', 3)) t(set_id, fixed, included, omitted, grouping_bits, grouping_id)")
def inspect_cube(df):
    return inspect_grouping(df, by="o_orderstatus", grouping=cube("o_orderpriority", "o_custkey"))


@query("orders", f"SELECT {total('o_orderstatus')}, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE false GROUP BY ROLLUP (o_orderstatus)")
def empty_input_total(df):
    return summarize_with_margins(df.where("o_orderkey < 0"), n=count_(), keys=F.sum("o_orderkey"), grouping=rollup("o_orderstatus"))


@query("orders", f"SELECT o_orderstatus, {total('o_orderpriority')}, count(*) AS n FROM orders WHERE false GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))")
def empty_input_by(df):
    return summarize_with_margins(df.where("o_orderkey < 0"), n=count_(), by="o_orderstatus", grouping=rollup("o_orderpriority"))


@query("lineitem", f"SELECT {total('l_returnflag')}, {total('l_linestatus')}, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def count_distinct_margins(df):
    return summarize_with_margins(df, parts=F.countDistinct("l_partkey"), grouping=cube("l_returnflag", "l_linestatus"))


@query("lineitem", f"SELECT {total('l_returnflag')}, round(quantile_cont(l_quantity, 0.5), 6) AS middle FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def percentile_margins(df):
    return summarize_with_margins(df, middle=F.round(F.percentile("l_quantity", 0.5), 6), grouping=rollup("l_returnflag"))


@query("orders", f"SELECT {total('year')}, {total('o_orderstatus')}, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus FROM orders) GROUP BY ROLLUP (year, o_orderstatus)")
def derived_dimension_explode(df):
    return summarize_with_margins(df.withColumn("year", F.year("o_orderdate")), n=count_(), grouping=rollup("year", "o_orderstatus"), method="explode")
