"""A table of what was computed lately, of bounded size."""

from __future__ import annotations

from collections.abc import Callable


class Held(dict):
    """Makes a value when it is asked for; a full young half becomes the old half, which the next replaces.

    Values of keys longer than `longest` are made anew each time.
    """

    def __init__(self, make: Callable, size: int, longest: int) -> None:
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
