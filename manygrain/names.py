"""Internal column names that no caller's column has, whatever the case."""

from __future__ import annotations

from collections.abc import Iterable


class Names:
    def __init__(self, taken: Iterable[str]):
        self.taken = {t.lower() for t in taken}

    def new(self, stem: str) -> str:
        name = f"mg_{stem}"
        while name.lower() in self.taken:
            name += "_"
        self.taken.add(name.lower())
        return name
