"""Summaries over several columns."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import MarginError
from ..plans.spec import Selector, all_of, everything
from .shares import Share


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Across:
    columns: Selector
    functions: Callable | dict | list
    names: str | None

    def named(self, schema: StructType, hidden: Iterable[str]) -> list[tuple[str, Column]]:
        many = not callable(self.functions)
        if isinstance(self.functions, dict):
            fns = list(self.functions.items())
        elif many:
            fns = [(str(k), f) for k, f in enumerate(self.functions, 1)]
        else:
            fns = [("1", self.functions)]
        template = self.names or ("{col}_{fn}" if many else "{col}")
        out = [(template.replace("{col}", c).replace("{fn}", n), f(F.col(quoted(c)))) for c in self.columns.names(schema, hidden) for n, f in fns]
        if len({n.lower() for n, _ in out}) < len(out):
            raise MarginError("`names` must give each column and function a name of its own.")
        return out


def across(columns=None, functions=None, names: str | None = None) -> Across:
    """Apply one function, or several, to each selected column (all but the plan's where none is named)."""
    if functions is None:
        raise MarginError("`across()` needs a function.")
    chosen = everything() if columns is None else columns if isinstance(columns, Selector) else all_of([columns] if isinstance(columns, str) else columns)
    return Across(chosen, functions, names)


@dataclass(frozen=True)
class ShareAcross:
    sources: tuple[str, ...] | Selector
    kind: str
    names: str

    def named(self, earlier: StructType) -> list[tuple[str, Share]]:
        """earlier: the summaries before it."""
        chosen = self.sources.names(earlier) if isinstance(self.sources, Selector) else self.sources
        return [(self.names.replace("{col}", s), Share(self.kind, s)) for s in chosen]


def share_across(sources: Iterable[str] | Selector, kind: str, names: str) -> ShareAcross:
    """Shares (``parent`` or ``total``) of several earlier summaries, by their names (not types)."""
    if kind not in ("parent", "total") or "{col}" not in (names or ""):
        raise MarginError("`share_across()` needs kind 'parent' or 'total' and `names` with {col}.")
    if isinstance(sources, Selector):
        if "where(" in sources.text:
            raise MarginError("`share_across()` chooses summaries by name; `where()` looks at types.")
        return ShareAcross(sources, kind, names)
    return ShareAcross((sources,) if isinstance(sources, str) else tuple(sources), kind, names)


@dataclass(frozen=True)
class Selected:
    """Columns chosen once the data are known, never those of the plan; ``then`` applies functions to the result."""

    columns: Selector
    build: Callable[[list[Column]], Column]

    def resolve(self, schema: StructType, hidden: Iterable[str]) -> Column:
        return self.build([F.col(quoted(c)).alias(c) for c in self.columns.names(schema, hidden)])

    def then(self, function: Callable[[Column], Column]) -> Selected:
        return Selected(self.columns, lambda cols: function(self.build(cols)))


def _chosen(columns, build: Callable[[list[Column]], Column]) -> Selected:
    chosen = columns if isinstance(columns, Selector) else everything() if columns is None else all_of([columns] if isinstance(columns, str) else columns)
    return Selected(chosen, build)


def pick(*columns):
    """Several columns as one struct. With a selector, for example ``pick(everything()).then(F.first)``, the plan's columns stay out."""
    if len(columns) == 1 and not isinstance(columns[0], str):
        return _chosen(columns[0], lambda cols: F.struct(*cols))
    return F.struct(*[F.col(quoted(c)) for c in columns])


def if_any(columns, test: Callable[[Column], Column]) -> Selected:
    """Whether ``test`` holds for any of the columns; for example ``if_any(["x", "y"], F.isnull).then(F.count_if)``. Of none: false."""
    return _chosen(columns, lambda cols: reduce(operator.or_, [test(c) for c in cols], F.lit(False)))


def if_all(columns, test: Callable[[Column], Column]) -> Selected:
    """Whether ``test`` holds for all of the columns. Of none: true."""
    return _chosen(columns, lambda cols: reduce(operator.and_, [test(c) for c in cols], F.lit(True)))
