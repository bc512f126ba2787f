"""Options given as `--key value` pairs, typed and recorded."""

from __future__ import annotations

import os
from collections.abc import Sequence


class Options:
    """`--key value` arguments over defaults; typed getters record what was asked and given."""

    def __init__(self, args: Sequence[str] = (), defaults: dict[str, str] | None = None):
        self._given = dict(defaults or {})
        self.asked: dict[str, str] = {}
        rest = list(args)
        while rest:
            key = rest.pop(0)
            if not key.startswith("--"):
                raise ValueError(f"option expected: {key}")
            self._given[key[2:]] = rest.pop(0) if rest and not rest[0].startswith("--") else "true"

    def text(self, key: str, default: str | None = None) -> str:
        value = self._given.get(key, default)
        if value is None:
            raise KeyError(key)
        self.asked[key] = value
        return value

    def whole(self, key: str, default: int | None = None) -> int:
        return int(self.text(key, None if default is None else str(default)))

    def real(self, key: str, default: float | None = None) -> float:
        return float(self.text(key, None if default is None else str(default)))

    def flag(self, key: str, default: bool = False) -> bool:
        return self.text(key, str(default)).lower() in ("true", "1", "yes", "on")

    def mapping(self, key: str, default: str = "") -> dict[str, str]:
        """`k:v,k:v`; a key with two values is an error."""
        out: dict[str, str] = {}
        for part in filter(None, self.text(key, default).split(",")):
            k, _, v = part.partition(":")
            if out.setdefault(k, v) != v:
                raise ValueError(f"{key}: {k} has two values")
        return out

    def existing(self, key: str, default: str | None = None) -> str:
        path = self.text(key, default)
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        return path

    def shard(self, key: str = "shard") -> tuple[int, int]:
        from spanloom.operators.sampling import parse_shard

        return parse_shard(self.text(key, "0/1"))

    def exclusive(self, *keys: str) -> None:
        given = [k for k in keys if k in self._given]
        if len(given) > 1:
            raise ValueError(f"only one of {', '.join(given)}")
