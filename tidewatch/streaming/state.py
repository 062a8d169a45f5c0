"""What stateful processors keep per key: counts per value in map state with running totals, times in list state, scalars in a row.

No value of these grows with the traffic of a key. Only the values met in a micro-batch are read and written.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator
from heapq import merge
import math

import numpy as np
import pandas as pd


class MapStore:
    """The part of a dict that ``Counts`` needs, over a map state. Values met are held until ``flush``, at most ``hold`` of them."""

    def __init__(self, state, known_empty: bool = False, hold: int = 50_000) -> None:
        self.state, self.empty, self.hold, self.met, self.changed = state, known_empty, hold, {}, set()

    def get(self, value, default: int = 0) -> int:
        if value not in self.met:
            row = None if self.empty else self.state.getValue((value,))
            self.met[value] = default if row is None else int(row[0])
        return self.met[value]

    def __setitem__(self, value, n: int) -> None:
        self.met[value] = n
        self.changed.add(value)
        if len(self.met) >= self.hold:
            self.flush()

    def clear(self) -> None:
        if not self.empty:
            self.state.clear()
        self.met, self.changed, self.empty = {}, set(), True

    def flush(self) -> None:
        for v in self.changed:
            self.state.updateValue((v,), (self.met[v],))
        self.empty = self.empty and not self.changed
        self.met, self.changed = {}, set()


class Counts:
    """How often each value was met. Distinct values, their number, the sum of n log2 n and the largest count are kept up to
    date, so entropy and shares need no look at the counts, which lie in ``store``."""

    def __init__(self, store=None) -> None:
        self.store = {} if store is None else store
        self.distinct, self.total, self.nlogn, self.most = 0, 0, 0.0, 0

    def add(self, value) -> None:
        n = self.store.get(value, 0)
        self.store[value] = n + 1
        self.distinct += n == 0
        self.total += 1
        if n:
            self.nlogn += (n + 1) * math.log2(n + 1) - n * math.log2(n)
        self.most = max(self.most, n + 1)

    def entropy(self) -> float:
        return max(0.0, math.log2(self.total) - self.nlogn / self.total) if self.total > 1 else 0.0

    def clear(self) -> None:
        self.store.clear()
        self.distinct, self.total, self.nlogn, self.most = 0, 0, 0.0, 0


class ListStore:
    """Numbers appended to a list state; only the new ones are written, all are read when asked for."""

    def __init__(self, state, known_empty: bool = False) -> None:
        self.state, self.empty, self.new = state, known_empty, []

    def append(self, x: int) -> None:
        self.new.append(x)

    def __iter__(self) -> Iterator[int]:
        if not self.empty:
            yield from (int(r[0]) for r in self.state.get())
        yield from self.new

    def clear(self) -> None:
        if not self.empty:
            self.state.clear()
        self.new, self.empty = [], True

    def flush(self) -> None:
        if self.new:
            self.state.appendList([(x,) for x in self.new])
            self.new, self.empty = [], False


def in_order(frames: Iterable[pd.DataFrame], by: tuple[str, str] = ("ts_us", "event_id")) -> Iterator[tuple]:
    """Rows of all frames in order of ``by``, as named tuples. Each frame is sorted by itself; the runs are merged row by row."""
    runs, event, at = [], None, ()
    for frame in frames:
        if event is None:
            event = namedtuple("Event", list(frame.columns))
            at = tuple(frame.columns.get_loc(c) for c in by)
        order = np.lexsort([frame[c].to_numpy() for c in reversed(by)])
        runs.append(zip(*[frame[c].to_numpy()[order].tolist() for c in frame.columns]))
    rows = runs[0] if len(runs) == 1 else merge(*runs, key=lambda r: (r[at[0]], r[at[1]]))
    yield from map(event._make, rows) if runs else ()
