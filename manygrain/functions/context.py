"""Grouping bits and identifiers as deferred expressions.

Whether a dimension is left out is only known per lowering (a grouping function, a constant, a
lookup by set), so these helpers are values that the lowering resolves; arithmetic with them
gives deferred values again. Inside any other expression they are Spark's grouping function,
which only an aggregate over grouping sets accepts.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as Classic

from ..errors import MarginError


class Deferred(Classic):
    def __new__(cls, *args) -> Deferred:
        return object.__new__(cls)

    def __init__(self, columns: tuple[str, ...], build: Callable[[Callable[[str], Column]], Column]):
        self.columns, self._build = columns, build

    @property
    def _jc(self):
        return self._build(lambda c: F.grouping(F.col("`" + c.replace("`", "``") + "`")))._jc

    def resolve(self, bit: Callable[[str], Column]) -> Column:
        return self._build(bit)

    def _with(self, other, op, swap: bool = False) -> Deferred:
        more = other.columns if isinstance(other, Deferred) else ()

        def build(bit):
            mine = self._build(bit)
            theirs = other._build(bit) if isinstance(other, Deferred) else other if isinstance(other, Column) else F.lit(other)
            return op(theirs, mine) if swap else op(mine, theirs)

        return Deferred(self.columns + more, build)

    def cast(self, kind) -> Deferred:
        return Deferred(self.columns, lambda bit: self._build(bit).cast(kind))

    __hash__ = None  # type: ignore[assignment]


def _operators() -> None:
    for name in ("add", "sub", "mul", "truediv", "mod"):
        op = getattr(operator, name)
        setattr(Deferred, f"__{name}__", lambda self, other, op=op: self._with(other, op))
        setattr(Deferred, f"__r{name}__", lambda self, other, op=op: self._with(other, op, True))
    for name in ("eq", "ne", "lt", "le", "gt", "ge", "and_", "or_"):
        op = getattr(operator, name)
        setattr(Deferred, f"__{name.rstrip('_')}__", lambda self, other, op=op: self._with(other, op))
    for name in ("and_", "or_"):
        op = getattr(operator, name)
        setattr(Deferred, f"__r{name.rstrip('_')}__", lambda self, other, op=op: self._with(other, op, True))


_operators()


def grouping_bit(column: str) -> Deferred:
    """1 in rows whose set leaves ``column`` out, else 0; always 0 for a fixed key."""
    if not isinstance(column, str):
        raise MarginError("`grouping_bit()` takes one column name.")
    return Deferred((column,), lambda bit: bit(column).cast("int"))


def grouping_id(*columns: str) -> Deferred:
    """The bits of 1 to 31 distinct columns as a number, the last one least significant."""
    if not 1 <= len(columns) <= 31 or any(not isinstance(c, str) for c in columns):
        raise MarginError("`grouping_id()` takes 1 to 31 column names.")
    if len({c.lower() for c in columns}) < len(columns):
        raise MarginError("`grouping_id()` takes distinct columns.")

    def build(bit):
        out = F.lit(0)
        for k, c in enumerate(reversed(columns)):
            out = out + bit(c).cast("int") * F.lit(1 << k)
        return out.cast("int")

    return Deferred(tuple(columns), build)
