"""Specifications compiled to a grouping plan: pure Python over a schema."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql.types import StructType

from ..errors import MarginError
from .spec import NAMES, Selector, Spec

POLICIES = ("error", "drop", "keep")


@dataclass(frozen=True)
class GroupingPlan:
    by: tuple[str, ...]
    dims: tuple[str, ...]
    #: dimensions of each set, in the order of ``dims``
    sets: tuple[tuple[str, ...], ...]
    duplicates: str

    @property
    def ids(self) -> range:
        return range(1, len(self.sets) + 1)

    def mask(self, i: int) -> tuple[int, ...]:
        """1 for each dimension that set ``i`` (from 1) leaves out."""
        return tuple(int(d not in self.sets[i - 1]) for d in self.dims)

    @property
    def distinct(self) -> dict[tuple[int, ...], list[int]]:
        """Masks in order, each with the ids of its occurrences."""
        out: dict[tuple[int, ...], list[int]] = {}
        for i in self.ids:
            out.setdefault(self.mask(i), []).append(i)
        return out

    @property
    def has_total(self) -> bool:
        return () in self.sets

    def total_targets(self) -> dict[int, int | None]:
        """The first grand total for each other set; none for a grand total itself."""
        first = self.sets.index(()) + 1
        return {i: None if self.sets[i - 1] == () else first for i in self.ids}

    def parent_targets(self) -> dict[int, int | None]:
        """The first later set with a strict subset of the columns."""
        return {i: next((j for j in self.ids if j > i and set(self.sets[j - 1]) < set(self.sets[i - 1])), None) for i in self.ids}


def _columns(arg, schema: StructType, hidden=()) -> list[str]:
    if isinstance(arg, Selector):
        return arg.names(schema, hidden)
    for f in schema.fields:
        if f.name.lower() == arg.lower():
            return [f.name]
    raise MarginError(f"Column `{arg}` doesn't exist.")


def _set(spec: Spec, schema: StructType) -> tuple[str, ...]:
    names: list[str] = []
    for a in spec.args:
        if isinstance(a, Spec):
            raise MarginError("`grouping_set()` takes columns only; it can't hold another specification.")
        names += _columns(a, schema)
    return tuple(dict.fromkeys(names))


def _units(spec: Spec, schema: StructType) -> list[tuple[str, ...]]:
    units: list[tuple[str, ...]] = []
    for a in spec.args:
        if not isinstance(a, Spec):
            units += [(n,) for n in _columns(a, schema)]
        elif a.kind != "set":
            raise MarginError(f"`{NAMES[spec.kind]}()` takes columns and `grouping_set()`, not `{NAMES[a.kind]}()`.")
        else:
            unit = _set(a, schema)
            if not unit:
                raise MarginError(f"A composite dimension of `{NAMES[spec.kind]}()` needs a column.")
            units.append(unit)
    return units


def _join(parts) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for p in parts for n in p))


def expand(spec: Spec, schema: StructType) -> list[tuple[str, ...]]:
    """The family of sets of a specification, in order."""
    if spec.kind == "set":
        return [_set(spec, schema)]
    if spec.kind == "sets":
        if not spec.args:
            raise MarginError("`grouping_sets()` needs a member.")
        return [s for a in spec.args for s in (expand(a, schema) if isinstance(a, Spec) else [_join([_columns(a, schema)])])]
    if spec.kind == "product":
        out: list[tuple[str, ...]] = [()]
        for a in spec.args:
            family = expand(a, schema) if isinstance(a, Spec) else [_join([_columns(a, schema)])]
            out = [_join([x, y]) for x in out for y in family]
        return out
    units = _units(spec, schema)
    if not units:
        raise MarginError(f"`{NAMES[spec.kind]}()` needs a column.")
    if spec.kind == "rollup":
        return [_join(units[:n]) for n in range(len(units), -1, -1)]
    return [_join(c) for n in range(len(units), -1, -1) for c in combinations(units, n)]


def compile_plan(schema: StructType, by=None, grouping: Spec | None = None, duplicates: str = "error", policies: tuple[str, ...] = POLICIES) -> GroupingPlan:
    """Errors in options come first, then those of the specification, then clashes."""
    if duplicates not in policies:
        raise MarginError(f"`duplicates` must be one of {', '.join(map(repr, policies))}, not {duplicates!r}.")
    low: dict[str, str] = {}
    for f in schema.fields:
        if low.setdefault(f.name.lower(), f.name) != f.name or sum(g.name == f.name for g in schema.fields) > 1:
            raise MarginError(f"Columns `{low[f.name.lower()]}` and `{f.name}` can't be told apart.")
    if grouping is not None and not isinstance(grouping, Spec):
        raise MarginError("`grouping` must be a grouping specification.")
    family = [()] if grouping is None else expand(grouping, schema)
    parts = [by] if isinstance(by, (str, Selector)) else list(by or [])
    if any(isinstance(p, Spec) for p in parts):
        raise MarginError("`by` takes columns, not a grouping specification.")
    keys = _join([_columns(p, schema) for p in parts])
    dims = _join(family)
    if both := [d for d in dims if d in keys]:
        raise MarginError(f"`by` and `grouping` can't share {', '.join(f'`{b}`' for b in both)}.")
    sets = [tuple(d for d in dims if d in s) for s in family]
    places: dict[tuple[str, ...], list[int]] = {}
    for k, s in enumerate(sets, 1):
        places.setdefault(s, []).append(k)
    twice = [p for p in places.values() if len(p) > 1]
    if twice and duplicates == "error":
        others = " or ".join(f'duplicates="{p}"' for p in policies if p != "error")
        raise MarginError(f"Duplicate grouping sets at positions {'; '.join(', '.join(map(str, p)) for p in twice)}. Use {others}.")
    if duplicates == "drop":
        sets = list(places)
    return GroupingPlan(keys, dims, tuple(sets), duplicates)
