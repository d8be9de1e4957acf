"""What a worker remembers of the words it has seen, within a bound."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterable
from typing import ClassVar


class Remembered:
    """Values by key in two generations. When the younger has over most keys it becomes the older,
    and what isn't asked for again until the next change is forgotten."""

    everyone: ClassVar[weakref.WeakSet[Remembered]] = weakref.WeakSet()
    #: What an owner lets go of, besides remembered values, when a worker serves another one.
    releases: ClassVar[dict[str, Callable[[], None]]] = {}
    serves: ClassVar[str | None] = None

    def __init__(self, most: int, owner: str):
        self.most, self.owner, self.young, self.old = most, owner, {}, {}
        self.everyone.add(self)

    @classmethod
    def only(cls, owner: str) -> None:
        """A worker that serves another operator forgets what it knew for the one before, and returns the memory."""
        if cls.serves == owner:
            return
        cls.serves = owner
        for one in list(cls.everyone):
            if one.owner != owner:
                one.young, one.old = {}, {}
        for other, release in cls.releases.items():
            if other != owner:
                release()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def of(self, keys: Iterable, compute: Callable[[list], Iterable]) -> dict:
        """Values of the keys; compute gives those of unknown ones, in their order."""
        young, old, out, new = self.young, self.old, {}, []
        for key in keys:
            value = young.get(key)
            if value is None:
                value = old.get(key)
                if value is None:
                    new.append(key)
                    continue
                young[key] = value
            out[key] = value
        if new:
            fresh = dict(zip(new, compute(new)))
            out.update(fresh)
            young.update(fresh)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out
