"""Dictionaries in keyed state that cost as much as what a call touches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of a chunk, about; groups of a run whose tokens share their calls and their state.
CHUNK, SHARDS = 128, 16
KEY, VALUE = "scope string, chunk int", "held string"


def shard(*names: str) -> Column:
    """The group of a token in its run. A call takes a group's rows, so a run is ``SHARDS`` tasks and not a call for each token."""
    return F.pmod(F.xxhash64(*names), F.lit(SHARDS)).cast("int")


def named(*parts: str | None) -> str:
    """One text for several, whatever they hold."""
    return json.dumps(parts)


class Chunks:
    """A dictionary by text, as chunks by the hash of the name in one map state (``KEY``, ``VALUE``). A call reads the
    chunks that it asks for and writes those it changed, so neither a call for each entry nor the whole dictionary passes; at
    twice the entries that the chunks should hold there are four times as many. Chunk 0 tells the numbers of chunks and entries."""

    def __init__(self, state, scope: str):
        self.state, self.scope, self.changed = state, scope, set()
        held = state.getValue((scope, 0))
        self.stored, self.n, first = json.loads(held[0]) if held else (0, 0, {})
        self.parts, self.kept = max(self.stored, 1), {0: first}

    def _chunk(self, i: int) -> dict:
        if i not in self.kept:
            held = self.state.getValue((self.scope, i)) if i < self.stored else None
            self.kept[i] = json.loads(held[0]) if held else {}
        return self.kept[i]

    def _at(self, name: str) -> int:
        return crc32(name.encode()) % self.parts

    def __len__(self) -> int:
        return self.n

    def __contains__(self, name: str) -> bool:
        return name in self._chunk(self._at(name))

    def get(self, name: str):
        return self._chunk(self._at(name)).get(name)

    def __setitem__(self, name: str, value) -> None:
        i = self._at(name)
        held = self._chunk(i)
        self.n += name not in held
        held[name] = value
        self.changed.add(i)
        if self.n > 2 * CHUNK * self.parts:
            self._spread(4 * self.parts)

    def __delitem__(self, name: str) -> None:
        i = self._at(name)
        del self._chunk(i)[name]
        self.n -= 1
        self.changed.add(i)

    def __iter__(self) -> Iterator[str]:
        for i in range(self.parts):
            yield from self._chunk(i)

    def _spread(self, parts: int) -> None:
        held = [x for i in range(self.parts) for x in self._chunk(i).items()]
        self.parts, self.kept = parts, {i: {} for i in range(parts)}
        for name, value in held:
            self.kept[self._at(name)][name] = value
        self.changed = set(range(parts))

    def clear(self) -> None:
        for i in range(self.stored):
            self.state.removeKey((self.scope, i))
        self.stored, self.n, self.parts, self.kept, self.changed = 0, 0, 1, {0: {}}, set()

    def flush(self) -> None:
        if not self.n and self.changed:
            self.clear()
        if self.changed:
            for i in self.changed - {0}:
                self.state.updateValue((self.scope, i), (json.dumps(self.kept[i]),))
            self.stored = self.parts
            self.state.updateValue((self.scope, 0), (json.dumps([self.parts, self.n, self.kept[0]]),))
            self.changed = set()
