"""Display labels of left-out dimensions, and categorical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import MarginError
from .plan import GroupingPlan


class _Missing:
    def __repr__(self) -> str:
        return "NA"


#: The missing label: shown as null like None, but checked against missing values.
NA = _Missing()


def categorical(df: DataFrame, column: str, levels: list[str], ordered: bool = False) -> DataFrame:
    """Declare the levels of a string column (as column metadata); reports sort by them. None among them declares missing values as a level."""
    return df.withMetadata(column, {"levels": [v for v in levels if v is not None], "ordered": ordered, "na_level": None in levels})


def is_na_level(schema: StructType, column: str) -> bool:
    """Whether missing values are a declared level of a categorical column, not just absent values."""
    return bool((schema[column].metadata or {}).get("na_level"))


def levels_of(schema: StructType, column: str) -> list[str] | None:
    return (schema[column].metadata or {}).get("levels")


def resolve_labels(plan: GroupingPlan, label) -> dict[str, object]:
    """A label for each dimension."""
    if label is None or label is NA or isinstance(label, str):
        if label == "":
            raise MarginError("`margin_label` can't be empty.")
        return dict.fromkeys(plan.dims, label)
    if not isinstance(label, dict):
        raise MarginError("`margin_label` must be a string, None, NA or a dict by dimension.")
    if missing := [d for d in plan.dims if d not in label]:
        raise MarginError(f"`margin_label` names no label for {', '.join(missing)}.")
    if unknown := [k for k in label if k not in plan.dims]:
        raise MarginError(f"`margin_label` names {', '.join(map(str, unknown))}, which are no dimensions.")
    for v in label.values():
        if not (v is None or v is NA or isinstance(v, str) and v):
            raise MarginError("Labels must be non-empty strings, None or NA.")
    return dict(label)


def check_declared(schema: StructType, labels: dict[str, object]) -> None:
    for d, text in labels.items():
        if isinstance(text, str) and text in (levels_of(schema, d) or []):
            raise MarginError(f"Label {text!r} is a level of `{d}`.")
        if text is NA and is_na_level(schema, d):
            raise MarginError(f"The missing value is a level of `{d}`; it can't be its label.")


def check_observed(df: DataFrame, labels: dict[str, object]) -> None:
    """One aggregate job over all labelled columns; categorical ones are known without it."""
    tests = {d: F.col(f"`{d}`").isNull() if text is NA else F.col(f"`{d}`").cast("string") == text for d, text in labels.items() if text is not None and (text is NA or levels_of(df.schema, d) is None)}
    if not tests:
        return
    hit = df.agg(*[F.max(F.when(t, 1)).alias(f"h{k}") for k, t in enumerate(tests.values())]).first()
    if found := [d for k, d in enumerate(tests) if hit[k]]:
        raise MarginError(f"The label of {', '.join(f'`{d}`' for d in found)} occurs in the data.")


def labelled(value: Column, left_out: Column, label) -> Column:
    """The value, or the label where the dimension is left out; with None or NA the type is kept."""
    return value if not isinstance(label, str) else F.when(left_out, F.lit(label)).otherwise(value.cast("string"))


def new_metadata(schema: StructType, column: str, label, position: str) -> dict | None:
    levels = levels_of(schema, column)
    if levels is None:
        return None
    if isinstance(label, str):
        levels = [label, *levels] if position == "first" else [*levels, label]
    return {**schema[column].metadata, "levels": levels}
