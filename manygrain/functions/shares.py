"""Markers for shares; only a whole summary can be one, so their operators refuse."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import MarginError


@dataclass(frozen=True)
class Share:
    kind: str
    source: str


def _alone(self, *_):
    raise MarginError(f"`share_of_{self.kind}()` must be a whole summary; nothing can be computed with it.")


for _name in ("add", "radd", "sub", "rsub", "mul", "rmul", "truediv", "rtruediv", "mod", "rmod", "neg", "lt", "le", "gt", "ge", "and", "or", "invert"):
    setattr(Share, f"__{_name}__", _alone)


def _share(kind: str, source: str) -> Share:
    if not isinstance(source, str) or not source:
        raise MarginError(f"`share_of_{kind}()` takes the name of an earlier summary.")
    return Share(kind, source)


def share_of_parent(source: str) -> Share:
    """An earlier summary over the same one a rollup level up, within ``by``."""
    return _share("parent", source)


def share_of_total(source: str) -> Share:
    """An earlier summary over the same one in the grand total, within ``by``."""
    return _share("total", source)
