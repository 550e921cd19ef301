"""A bounded cache for what is derived from strings that come again."""

from __future__ import annotations

from collections.abc import Callable


class Generations:
    """At most two generations of ``most`` entries; what the younger doesn't have is looked up in the older, whose rest is dropped when the younger is full."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 200_000, longest: int = 256) -> None:
        self.make, self.most, self.longest = make, most, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def get(self, keys: list[str]) -> list:
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        missing = dict.fromkeys(k for k, v in zip(keys, out, strict=True) if v is None)
        found = {k: self.old[k] for k in missing if k in self.old}
        new = [k for k in missing if k not in found]
        found.update(zip(new, self.make(new), strict=True))
        out = [found[k] if v is None else v for k, v in zip(keys, out, strict=True)]
        self.young.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out
