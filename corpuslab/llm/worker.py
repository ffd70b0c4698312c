"""Things that a Python worker builds once and keeps for its later tasks."""

from __future__ import annotations

import builtins


def kept(key, build):
    """The value of `key`, built at its first use in this process.

    Functions travel to the workers by value, so a module's own globals are new for every
    task. A dictionary beside the built-in names lives as long as the process."""
    store = builtins.__dict__.setdefault("_corpuslab_kept", {})
    if key not in store:
        store[key] = build()
    return store[key]


class Bounded(dict):
    """A memo of one function, of two generations of up to `limit` entries: when the young one
    is full it becomes the old one, from which what is asked for again is taken over. Long
    keys are not kept."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) > 256:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
