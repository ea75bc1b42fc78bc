"""Rows repeated for every grouping set they count in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prepare import expanded, prepare, set_bits


def expand_with_margins(df: DataFrame, *, by=None, grouping=None, margin_label="Total", margin_label_position: str = "last", check_margin_label: bool = False,
                        duplicates: str = "error", id: str | None = None, sort: str = "none") -> DataFrame:
    """Each row once per set, from one scan; left-out dimensions are labelled (or typed nulls)."""
    op = prepare(df, by, grouping, margin_label, margin_label_position, check_margin_label, duplicates, id, sort)
    op.check_labels()
    rows, keys, set_name = expanded(op)
    rest = [c for c in df.columns if c not in op.plan.by and c not in op.plan.dims]
    return op.finish(rows, keys, set_bits(op, set_name), set_name, rest)
