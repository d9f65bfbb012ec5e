"""Maps of keyed state that are read and written by entry."""

from __future__ import annotations

from typing import Any


class Entries:
    """Entries of one map of the state: read when first asked for, written back by `flush`.

    state: a MapState, or None to keep all in memory.
    """

    def __init__(self, state: Any = None) -> None:
        self.state = state
        self.known: dict[tuple, tuple | None] = {}
        self.changed: set[tuple] = set()

    def get(self, *key: int) -> tuple | None:
        if key not in self.known:
            self.known[key] = self.state.getValue(key) if self.state is not None else None
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.known[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        if self.state is None:
            return
        for key in self.changed:
            value = self.known[key]
            if value is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.changed.clear()
