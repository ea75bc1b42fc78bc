"""The source rows behind every group of every set, as an array of structs.

A cell holds all rows of its group, and the grand total's cell the whole table, in one row of one
task: these verbs are for groups that fit a task's memory. Larger ones are for expand_with_margins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MarginError
from ..functions.selections import quoted
from .prepare import Operation, expanded, prepare, set_bits

POLICIES = ("error", "drop")


def _nest(op: Operation, key: str, keep: bool) -> DataFrame:
    plan = op.plan
    op.check_outputs([key])
    op.check_labels()
    rows, keys, set_name = expanded(op)
    kept = [*plan.by, *plan.dims] if keep else []
    rest = [c for c in op.df.columns if c not in plan.by and c not in plan.dims]
    cell = F.collect_list(F.struct(*[F.col(quoted(c)) for c in (*kept, *rest)])).alias(key)
    where = [F.col(quoted(keys[c])) for c in (*plan.by, *plan.dims)]
    nested = rows.groupBy(F.col(set_name), *where).agg(cell)
    return op.finish(nested, keys, set_bits(op, set_name), set_name, [key])


def _key(key) -> str:
    if not isinstance(key, str) or not key:
        raise MarginError("`key` must be a non-empty name.")
    return key


def nest_with_margins(df: DataFrame, *, by=None, grouping=None, margin_label="Total", margin_label_position: str = "last", check_margin_label: bool = False,
                      duplicates: str = "error", id: str | None = None, sort: str = "none", key: str = "data", keep: bool = False) -> DataFrame:
    """One row per group and set with its rows in ``key``; ``keep`` puts the original keys inside, first. No rows: no groups."""
    op = prepare(df, by, grouping, margin_label, margin_label_position, check_margin_label, duplicates, id, sort, POLICIES)
    return _nest(op, _key(key), keep)


def nest_by_with_margins(df: DataFrame, *, by=None, grouping=None, margin_label="Total", margin_label_position: str = "last", check_margin_label: bool = False,
                         duplicates: str = "error", id: str | None = None, sort: str = "none", key: str = "data", keep: bool = False) -> DataFrame:
    """Like ``nest_with_margins``, for work row by row: the visible keys are in ``margin_keys`` of the result.

    Without any key, data without rows give one row with an empty array.
    """
    op = prepare(df, by, grouping, margin_label, margin_label_position, check_margin_label, duplicates, id, sort, POLICIES)
    out = _nest(op, _key(key), keep)
    if not op.plan.by and not op.plan.dims:
        kind = out.schema[key].dataType
        empty = df.where(F.lit(False)).agg(F.count(F.lit(1)).alias("n")).select(*([F.lit(1).alias(id)] if id else []), F.array().cast(kind).alias(key))
        out = out.unionByName(empty.join(df.select(F.lit(1).alias(op.names.new("any"))).limit(1), F.lit(True), "left_anti"))
    out.margin_keys = [*op.plan.by, *op.plan.dims, *([id] if id else [])]
    return out
