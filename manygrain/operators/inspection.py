"""A grouping plan as an ordinary table; reads no data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import MarginError
from ..plans.plan import compile_plan


def inspect_grouping(df: DataFrame, *, by=None, grouping=None, duplicates: str = "error", format: str = "text") -> DataFrame:
    """set_id, fixed, included, omitted, grouping_bits, grouping_id in plan order; ``format`` is ``text`` or ``list``."""
    if not isinstance(df, DataFrame):
        raise MarginError(f"A DataFrame is needed, not {type(df).__name__}.")
    if format not in ("text", "list"):
        raise MarginError("`format` must be 'text' or 'list'.")
    plan = compile_plan(df.schema, by, grouping, duplicates)
    rows = []
    for i in plan.ids:
        bits = plan.mask(i)
        inside = [d for d in plan.dims if d in plan.sets[i - 1]]
        out = [d for d in plan.dims if d not in inside]
        number = sum(b << k for k, b in enumerate(reversed(bits))) if len(plan.dims) <= 31 else None
        if format == "text":
            rows.append((i, ", ".join(plan.by), ", ".join(inside), ", ".join(out), ", ".join(f"{d}={b}" for d, b in zip(plan.dims, bits)), number))
        else:
            rows.append((i, list(plan.by), inside, out, dict(zip(plan.dims, bits)), number))
    text = format == "text"
    kinds = "string, included string, omitted string, grouping_bits string" if text else "array<string>, included array<string>, omitted array<string>, grouping_bits map<string,int>"
    return df.sparkSession.createDataFrame(rows, f"set_id int, fixed {kinds}, grouping_id int")
