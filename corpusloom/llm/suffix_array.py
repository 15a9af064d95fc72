"""The sorted suffixes of a collection of strings, column by column: its Burrows-Wheeler transform and common prefixes.

Strings are read from their ends. In each round every string that is long enough inserts the suffix that begins one
symbol further left, all at once: where a suffix goes follows from where the one after it stands and from how often its
first symbol occurs above that in the transform. Transform and common prefixes are columns in files of their own, which
a round reads from start to end and writes anew, so the suffixes themselves are never held or compared.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Stands in the transform where a string begins. No byte of UTF-8 has this value.
BEGIN = 255
#: Rows of a column that are merged at a time.
SLICE = 1 << 20
#: Common prefixes are kept up to this length.
LONGEST = 254


class Column:
    """A byte for each row, in two unlinked files of the running task: the present column and the one of the round before."""

    def __init__(self, size: int) -> None:
        self._files = [tempfile.TemporaryFile() for _ in range(2)]
        self._now, self._next = (np.memmap(f, np.uint8, "w+", shape=(size + 1,)) for f in self._files)
        self.rows = 0

    @property
    def values(self) -> np.ndarray:
        return self._now[: self.rows]

    @property
    def bounded(self) -> np.ndarray:
        """The values and one more row, for ranges that end with the column."""
        return self._now[: self.rows + 1]

    def merge(self, at: np.ndarray, values: np.ndarray) -> None:
        """Write the column anew with ``values`` at the places ``at`` (sorted, in the new column)."""
        total = self.rows + len(at)
        for a in range(0, total, SLICE):
            b = min(a + SLICE, total)
            i, j = np.searchsorted(at, (a, b))
            old = np.ones(b - a, bool)
            old[at[i:j] - a] = False
            part = self._next[a:b]
            part[old] = self._now[a - i : b - j]
            part[at[i:j] - a] = values[i:j]
        self._now, self._next, self.rows = self._next, self._now, total

    def close(self) -> None:
        del self._now, self._next
        for f in self._files:
            f.close()


class Collection:
    """Strings ``data[starts : starts + lengths]``, none of them empty, in a fixed order."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.data, self.ends, self.lengths = data, starts + lengths, lengths
        self.n = len(starts)
        size = self.n + int(lengths.sum())
        self.transform, self.common = Column(size), Column(size)
        self._slot = np.empty(size, np.int32)
        # the empty suffixes come first, by string; before each stands the string's last symbol
        self.rows = self.ids = np.arange(self.n)
        self.transform.merge(self.rows, self._before(self.ids, 0))
        self.common.merge(self.rows, np.zeros(self.n, np.uint8))
        for size in range(1, int(lengths.max(initial=0)) + 1):
            self._insert(size)

    def _before(self, ids: np.ndarray, size: int) -> np.ndarray:
        """The symbol before the suffix of ``size`` symbols of each string."""
        whole = self.lengths[ids] == size
        return np.where(whole, np.uint8(BEGIN), self.data[np.where(whole, 0, self.ends[ids] - size - 1)])

    def _insert(self, size: int) -> None:
        """One round: the suffixes of ``size`` symbols."""
        live = self.lengths[self.ids] >= size
        rows, ids = self.rows[live], self.ids[live]
        symbols = self.transform.values
        order = np.argsort(symbols, kind="stable")  # rows by symbol, then place: where the suffixes they extend to go
        fresh = np.zeros(len(symbols), bool)
        fresh[rows] = True
        at = np.flatnonzero(fresh[order])
        self._slot[rows] = np.arange(len(rows))
        self.ids = ids[self._slot[order[at]]]
        touched, prefixes = self._prefixes(symbols, order, at)
        self.rows = self.n + at
        self.transform.merge(self.rows, self._before(self.ids, size))
        self.common.merge(self.rows, np.zeros(len(at), np.uint8))
        self.common.values[self.n + touched] = prefixes

    def _prefixes(self, symbols: np.ndarray, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose neighbour above is new (the new ones, and those below them), and what they have in common with it:
        one more than what the rows between the two suffixes that they extend have in common, if their symbol is the
        same."""
        touched = np.zeros(len(order) + 1, bool)
        touched[at] = touched[at + 1] = True
        touched[0], touched[-1] = touched[0] and len(at) and at[0] == 0, False
        places = np.flatnonzero(touched)
        below = order[places]
        above = order[np.maximum(places - 1, 0)]
        places, above, below = (x[symbols[below] != BEGIN] for x in (places, above, below))
        out = np.zeros(len(places), np.uint8)
        same = np.flatnonzero((symbols[above] == symbols[below]) & (places > 0))
        if len(same):
            down = same[np.argsort(-above[same], kind="stable")]  # so that no range reaches from one pair to the next
            ranges = np.stack([above[down] + 1, below[down] + 1], 1).ravel()
            least = np.minimum.reduceat(self.common.bounded, ranges)[::2]
            out[down] = np.minimum(least, LONGEST - 1) + 1
        return places, out

    def equal(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, group): for each string's windows of ``window`` symbols, from ``first`` on, by place, a number that is
        the same for the same symbols. A walk from each string's end finds the rows of its suffixes."""
        counts = np.maximum(self.lengths - window + 1, 0)
        first = np.cumsum(counts) - counts
        group = np.empty(int(counts.sum()), np.int64)
        number = np.cumsum(self.common.values < window)
        order = np.argsort(self.transform.values, kind="stable")
        further = np.empty(len(order), np.int32)
        further[order] = np.arange(self.n, self.n + len(order), dtype=np.int32)
        ids = place = np.arange(self.n)
        for size in range(1, int(self.lengths.max(initial=0)) + 1):
            live = self.lengths[ids] >= size
            ids, place = ids[live], further[place[live]]
            if size >= window:
                group[first[ids] + self.lengths[ids] - size] = number[place]
        return first, group

    def close(self) -> None:
        self.transform.close()
        self.common.close()
