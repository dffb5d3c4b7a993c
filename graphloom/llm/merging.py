"""External k-way merge of sorted runs by a loser tree."""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

#: Runs that are merged at once; more are merged in passes.
FAN_IN = 64
#: Rows in memory; beyond, the runs gathered so far are merged into one on the executor's own disk.
BUFFER_ROWS = 200_000
_WRITTEN_TOGETHER = 2_000


class LoserTree:
    """Merges sorted iterators of tuples: each inner node keeps the loser of its match, the winner goes up.

    After a row is taken only the matches on its source's way to the top are played again.
    """

    def __init__(self, sources: list[Iterator[tuple]]):
        self._sources = sources
        self._rows = [next(s, None) for s in sources]
        self._losers = [-1] * max(1, len(sources))
        self._winner = self._build(1) if sources else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._rows[a], self._rows[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _build(self, node: int) -> int:
        k = len(self._sources)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self._losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        k = len(self._sources)
        while k and (row := self._rows[self._winner]) is not None:
            yield row
            at = self._winner
            self._rows[at] = next(self._sources[at], None)
            node = (at + k) >> 1
            while node:
                if self._beats(self._losers[node], at):
                    self._losers[node], at = at, self._losers[node]
                node >>= 1
            self._winner = at


def _stored(path: str) -> Iterator[tuple]:
    with open(path, "rb") as file:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                return


def merge_runs(rows: Iterable[tuple], buffer_rows: int = BUFFER_ROWS, fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All ``rows`` in order; a run ends where the next row is smaller. Tuples must be comparable."""
    folder: str | None = None
    runs: list[list[tuple]] = []
    spilled: list[str] = []
    held = 0

    def spill(sources: list[Iterator[tuple]]) -> None:
        nonlocal folder
        folder = folder or tempfile.mkdtemp(prefix="runs-")
        fd, path = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "wb") as file:
            some = []
            for row in LoserTree(sources):
                some.append(row)
                if len(some) == _WRITTEN_TOGETHER:
                    pickle.dump(some, file)
                    some = []
            pickle.dump(some, file)
        spilled.append(path)

    def narrowed() -> list[list[tuple]]:
        """Merge short runs in memory until there are no more than ``fan_in``."""
        out = runs
        while len(out) > fan_in:
            out = [list(LoserTree([iter(r) for r in out[i : i + fan_in]])) for i in range(0, len(out), fan_in)]
        return out

    try:
        last = None
        for row in rows:
            if last is None or row < last:
                runs.append([])
            runs[-1].append(row)
            last, held = row, held + 1
            if held >= buffer_rows:
                spill([iter(r) for r in narrowed()])
                runs, held, last = [], 0, None
        while len(spilled) > fan_in:
            some, spilled[:fan_in] = spilled[:fan_in], []
            spill([_stored(p) for p in some])
            for path in some:
                os.unlink(path)
        yield from LoserTree([*map(_stored, spilled), *(iter(r) for r in narrowed())])
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
