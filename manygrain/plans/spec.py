"""Grouping specifications and column selectors: values only, no Spark session needed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql.types import StructField, StructType

from ..errors import MarginError


class Selector:
    """Chooses columns of a schema; combine with ``|``, ``&``, ``-`` and ``~``."""

    def __init__(self, pick: Callable[[list[StructField]], list[str]], text: str):
        self._pick, self.text = pick, text

    def names(self, schema: StructType, hidden: Iterable[str] = ()) -> list[str]:
        gone = {h.lower() for h in hidden}
        return self._pick([f for f in schema.fields if f.name.lower() not in gone])

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda fs: list(dict.fromkeys(self._pick(fs) + other._pick(fs))), f"{self.text} | {other.text}")

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda fs: [n for n in self._pick(fs) if n in set(other._pick(fs))], f"{self.text} & {other.text}")

    def __sub__(self, other: Selector) -> Selector:
        return Selector(lambda fs: [n for n in self._pick(fs) if n not in set(other._pick(fs))], f"{self.text} - {other.text}")

    def __invert__(self) -> Selector:
        return Selector(lambda fs: [f.name for f in fs if f.name not in set(self._pick(fs))], f"~{self.text}")

    def __repr__(self) -> str:
        return self.text


def _tested(test: Callable[[StructField], bool], text: str) -> Selector:
    return Selector(lambda fs: [f.name for f in fs if test(f)], text)


def _known(fields: list[StructField], names: Iterable[str], strict: bool) -> list[str]:
    at = {f.name.lower(): f.name for f in fields}
    out = []
    for n in names:
        if n.lower() in at:
            out.append(at[n.lower()])
        elif strict:
            raise MarginError(f"Column `{n}` doesn't exist.")
    return out


def all_of(names: Iterable[str]) -> Selector:
    names = list(names)
    return Selector(lambda fs: _known(fs, names, True), f"all_of({names})")


def any_of(names: Iterable[str]) -> Selector:
    names = list(names)
    return Selector(lambda fs: _known(fs, names, False), f"any_of({names})")


def between(first: str, last: str) -> Selector:
    """The range of columns from one to another, in either direction."""

    def pick(fields: list[StructField]) -> list[str]:
        a, b = (_known(fields, [n], True)[0] for n in (first, last))
        names = [f.name for f in fields]
        i, j = names.index(a), names.index(b)
        return names[i : j + 1] if i <= j else names[j : i + 1][::-1]

    return Selector(pick, f"between({first}, {last})")


def starts_with(prefix: str) -> Selector:
    return _tested(lambda f: f.name.lower().startswith(prefix.lower()), f"starts_with({prefix!r})")


def ends_with(suffix: str) -> Selector:
    return _tested(lambda f: f.name.lower().endswith(suffix.lower()), f"ends_with({suffix!r})")


def contains(part: str) -> Selector:
    return _tested(lambda f: part.lower() in f.name.lower(), f"contains({part!r})")


def matches(pattern: str) -> Selector:
    return _tested(lambda f: re.search(pattern, f.name, re.I) is not None, f"matches({pattern!r})")


def everything() -> Selector:
    return _tested(lambda f: True, "everything()")


def where(test: Callable[[StructField], bool]) -> Selector:
    return _tested(test, "where(...)")


@dataclass(frozen=True)
class Spec:
    """A node of a specification: kind is set, sets, rollup, cube or product."""

    kind: str
    args: tuple[Any, ...]

    def __repr__(self) -> str:
        return f"<grouping specification: {NAMES[self.kind]}>"


NAMES = {"set": "grouping_set", "sets": "grouping_sets", "rollup": "rollup", "cube": "cube", "product": "grouping_spec"}


def _made(kind: str, args: tuple) -> Spec:
    for a in args:
        if not isinstance(a, (str, Selector, Spec, list, tuple)):
            raise MarginError(f"`{NAMES[kind]}()` takes column names, selectors and specifications, not {type(a).__name__}.")
    return Spec(kind, tuple(all_of(a) if isinstance(a, (list, tuple)) else a for a in args))


def grouping_set(*columns) -> Spec:
    """One set; without columns the grand total."""
    return _made("set", columns)


def grouping_sets(*members) -> Spec:
    """The members' sets one after another; a selection is one set of all its columns."""
    return _made("sets", members)


def rollup(*units) -> Spec:
    """All prefixes of the units, longest first, down to the grand total."""
    return _made("rollup", units)


def cube(*units) -> Spec:
    """All subsets of the units, largest first."""
    return _made("cube", units)


def grouping_spec(*members) -> Spec:
    """The Cartesian product of the members' families, left-major."""
    return _made("product", members)
