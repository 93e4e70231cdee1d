"""Suffix order with common-prefix lengths of many short strings, by induced sorting with disk-backed queues.

The strings are joined with separators (symbol 0, smaller than every byte and
unequal to each other). Leftmost S-type ("star") suffixes are ordered first:
their substrings are named, and names are combined recursively, so every round
doubles the covered length, until ``depth`` symbols decide. Induction then
derives all L-type suffixes from the star suffixes and all S-type suffixes from
the L-type ones: scanning suffixes in order, the suffix one symbol to the left
joins the queue of its first symbol. Each queue entry is a tuple (position,
common prefix with the entry before it); that length is one more than the
smallest length met in the scan since the queue's last entry.

Entries of a symbol enter in order, so a queue per symbol, taken by symbol, is a
monotone priority queue; beyond ``memory`` bytes its parts go to a scratch file
that exists only while the task runs. Scans handle batches with numpy.
"""

from __future__ import annotations

import tempfile

import numpy as np

BATCH = 1 << 16
MEMORY = 64 << 20
FAR = np.uint8(255)


class SuffixQueue:
    """Priority queue of (position, lcp) keyed by first symbol; entries of a symbol keep their order."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            start = self.file.seek(0, 2)
            self.file.write(at.tobytes())
            self.file.write(lcp.tobytes())
            self.held -= at.nbytes + lcp.nbytes
            self.parts[symbol].append((start, len(at)))
        else:
            self.parts[symbol].append((at, lcp))

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        self.file.seek(part[0])
        raw = self.file.read(9 * part[1])
        return np.frombuffer(raw, np.int64, part[1]), np.frombuffer(raw, np.uint8, part[1], 8 * part[1])

    def _drop(self, part) -> None:
        if isinstance(part[0], np.ndarray):
            self.held -= part[0].nbytes + part[1].nbytes

    def pop(self, symbol: int):
        """Entries of a symbol in order, in batches, until none are left; entries pushed meanwhile follow."""
        while self.parts[symbol]:
            ready, self.parts[symbol] = self.parts[symbol], []
            group, size = [], 0
            for part in ready:
                group.append(self._load(part))
                self._drop(part)
                size += len(group[-1][0])
                if size >= BATCH:
                    yield from _batches(group)
                    group, size = [], 0
            yield from _batches(group)

    def pop_reversed(self, symbol: int):
        """Finished entries of a symbol from last to first."""
        while self.parts[symbol]:
            part = self.parts[symbol].pop()
            at, lcp = self._load(part)
            self._drop(part)
            yield at[::-1], lcp[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _batches(group: list):
    if group:
        at = np.concatenate([g[0] for g in group])
        lcp = np.concatenate([g[1] for g in group])
        for k in range(0, len(at), BATCH):
            yield at[k:k + BATCH], lcp[k:k + BATCH]


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high], both ends included, by a doubling table."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
    return out


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than their right neighbour); separators count as S."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.zeros(len(text), bool)
    ups = text[change + 1] > text[change]
    rises[:change[-1] + 1 if len(change) else 0] = np.repeat(ups, np.diff(change, prepend=-1))
    rises[text == 0] = True
    return rises


def refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split tied ranks (whole groups of them) by a further key; returns the members that are still tied.

    A rank is the place of the first member of its group.
    """
    if not len(tied):
        return tied
    order = np.lexsort((key, rank[tied]))
    own, k = tied[order], key[order]
    r = rank[own]
    new_group = np.concatenate([[True], r[1:] != r[:-1]])
    new_value = new_group | np.concatenate([[True], k[1:] != k[:-1]])
    place = np.arange(len(own))
    group_start = np.maximum.accumulate(np.where(new_group, place, 0))
    value_start = np.maximum.accumulate(np.where(new_value, place, 0))
    rank[own] = r + value_start - group_start
    size = np.diff(np.append(np.flatnonzero(new_value), len(own)))
    return own[np.repeat(size > 1, size)]


def order_stars(text: np.ndarray, s_type: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """Star suffixes in the order of their first ``depth`` symbols at least (separators end a comparison)."""
    m = len(star)
    sep = text[star] == 0
    rank = np.zeros(m, np.int64)
    rank[sep] = np.arange(int(sep.sum()))
    rank[~sep] = int(sep.sum())
    end = np.append(star[1:], len(text) - 1)
    coded = text * np.int16(2) + s_type  # at most 513
    tied, offset = np.flatnonzero(~sep), 0
    while len(tied) and offset <= depth:  # name the star substrings, six symbols at a time
        key = np.zeros(len(tied), np.int64)
        for j in range(offset, offset + 6):
            at = star[tied] + j
            key = key * 1024 + np.where(at <= end[tied], coded[np.minimum(at, len(text) - 1)].astype(np.int64) + 1, 0)
        tied = refine(rank, tied, key)
        offset += 6
        tied = tied[star[tied] + offset <= end[tied]]
    tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
    number, step = np.arange(m), 1
    while len(tied) and 2 * step < depth:  # names of pairs of names; a star substring moves on by two symbols or more
        to = number[tied] + step
        tied = refine(rank, tied, np.where(to < m, rank[np.minimum(to, m - 1)], -1))
        step *= 2
    return np.argsort(rank, kind="stable")


def common_prefix(text: np.ndarray, to_sep: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal leading symbols of suffix pairs, at most ``cap``; a separator is equal to nothing."""
    most = np.minimum(np.minimum(to_sep[a], to_sep[b]), cap)
    out = most.copy()
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        differ = text[a[live] + k] != text[b[live] + k]
        out[live[differ]] = k
        k += 1
        live = live[~differ]
        live = live[most[live] > k]
    return out.astype(np.uint8)


class _Scan:
    """One pass of induction: hands every scanned batch to the queues of the symbols to its left."""

    def __init__(self, text, s_type, want_s: bool, queue: SuffixQueue, cap: int, symbols: int):
        self.text, self.s_type, self.want_s, self.queue, self.cap = text, s_type, want_s, queue, cap
        self.since = np.full(symbols, FAR)

    def batch(self, at: np.ndarray, lcp: np.ndarray) -> None:
        left = at - 1
        symbol = self.text[left]  # left of position 0 is the closing separator
        pick = np.flatnonzero((self.s_type[left] == self.want_s) & (symbol > 0))
        least = lcp.min()
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], FAR)
        order = np.argsort(symbol[pick], kind="stable")
        pick = pick[order]
        d = symbol[pick]
        if len(pick):
            first = np.concatenate([[True], d[1:] != d[:-1]])
            low = np.where(first, 0, np.concatenate([[0], pick[:-1] + 1]))
            value = range_minimum(lcp, low, pick)
            value[first] = np.minimum(value[first], self.since[d[first]])
            value = np.minimum(value.astype(np.int64) + 1, self.cap).astype(np.uint8)
            starts = np.flatnonzero(first)
            stops = np.append(starts[1:], len(d))
            self.since = np.minimum(self.since, least)
            self.since[d[starts]] = tail[pick[stops - 1]]
            for i, j in zip(starts.tolist(), stops.tolist()):
                self.queue.push(int(d[i]), left[pick[i:j]], value[i:j])
        else:
            self.since = np.minimum(self.since, least)


def suffixes(text: np.ndarray, depth: int, memory: int = MEMORY):
    """Batches (positions, lcp with the suffix before) of all non-separator suffixes in descending order.

    ``text`` holds symbols 1..256 and 0 after every string (and at its end). Order and lcp are exact up to ``depth``
    symbols; equal prefixes of that length come out next to each other with lcp ``depth``.
    """
    n, symbols = len(text), 257
    if not n:
        return
    s_type = suffix_types(text)
    is_star = text == 0
    seps = np.flatnonzero(is_star)
    is_star[1:] |= s_type[1:] & ~s_type[:-1]
    star = np.flatnonzero(is_star)
    small = np.int32 if n < 1 << 31 else np.int64
    to_sep = np.repeat(seps.astype(small), np.diff(seps, prepend=-1)) - np.arange(n, dtype=small)
    star = star[order_stars(text, s_type, star, depth + 1)]
    star_lcp = np.zeros(len(star), np.uint8)
    star_lcp[1:] = common_prefix(text, to_sep, star[:-1], star[1:], depth)
    bounds = np.searchsorted(text[star], np.arange(symbols + 1))
    queue, done = SuffixQueue(symbols, memory), SuffixQueue(symbols, memory)
    scan = _Scan(text, s_type, False, queue, depth, symbols)
    try:
        for c in range(symbols):
            last, fresh_symbol = None, True
            for at, lcp in queue.pop(c):
                if fresh_symbol:
                    lcp = np.concatenate([[np.uint8(0)], lcp[1:]])
                    fresh_symbol = False
                done.push(c, at, lcp)
                scan.batch(at, lcp)
                last = at[-1:]
            own, own_lcp = star[bounds[c]:bounds[c + 1]], star_lcp[bounds[c]:bounds[c + 1]].copy()
            if len(own):
                own_lcp[0] = 0 if last is None else common_prefix(text, to_sep, last, own[:1], depth)[0]
                for k in range(0, len(own), BATCH):
                    scan.batch(own[k:k + BATCH], own_lcp[k:k + BATCH])
        queue.close()
        queue = SuffixQueue(symbols, memory)
        scan = _Scan(text, s_type, True, queue, depth, symbols)
        for c in range(symbols - 1, 0, -1):
            last = None
            for at, lcp in queue.pop(c):
                if last is None:
                    lcp = np.concatenate([[np.uint8(0)], lcp[1:]])
                scan.batch(at, lcp)
                yield at, lcp
                last = at[-1:]
            carry = None
            for at, to_before in done.pop_reversed(c):
                # lcp with the larger neighbour is the larger neighbour's lcp with its predecessor
                head = (np.uint8(0) if last is None else common_prefix(text, to_sep, at[:1], last, depth)[0]
                        ) if carry is None else carry
                lcp = np.concatenate([[head], to_before[:-1]]).astype(np.uint8)
                carry = to_before[-1]
                for k in range(0, len(at), BATCH):
                    scan.batch(at[k:k + BATCH], lcp[k:k + BATCH])
                    yield at[k:k + BATCH], lcp[k:k + BATCH]
                last = at[-1:]
    finally:
        queue.close()
        done.close()
