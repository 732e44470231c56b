"""Suffix and common-prefix arrays by external induced sorting.

The text is a run of pieces. Suffixes are L if larger than the one that follows them, else S; an S after an L is
LMS. The substrings between LMS places are sorted by one induction and named; the string of names is sorted in its
turn; and a second induction carries the order of the LMS suffixes to all L and then all S suffixes. What is yet to
be visited waits in a queue with the first symbol as priority and arrival as order. A queue entry is a tuple of the
suffix and its common prefix with the entry before it: one more than the least common prefix between the two
suffixes that induced them. Entries are held in memory up to a limit and are on disk beyond it.

Inductions visit a whole generation of a symbol's entries at a time, so they run at the speed of array operations.
The string of names has too many symbols for that and is sorted by doubling, as deep as ``depth`` reaches.
"""

from __future__ import annotations

import tempfile

import numpy as np

END, CUT = 0, 1  # of the text, and of a piece; bytes are two more than they are


class Queue:
    """Entries (place, common prefix) by symbol, in order of arrival; spilled to a file beyond ``most`` entries."""

    def __init__(self, symbols: int, most: int):
        self.waiting: list[list[tuple]] = [[] for _ in range(symbols)]
        self.most, self.held, self.file, self.at = most, 0, None, 0

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        self.waiting[symbol].append((places, common))
        self.held += len(places)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.at)
        for entries in self.waiting:
            for k, x in enumerate(entries):
                if len(x) == 2:
                    self.file.write(x[0].tobytes())
                    self.file.write(x[1].tobytes())
                    entries[k] = (self.at, len(x[0]), None)
                    self.at += 12 * len(x[0])
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries that have arrived for a symbol; None if there are none."""
        entries, self.waiting[symbol] = self.waiting[symbol], []
        if not entries:
            return None
        out = []
        for x in entries:
            if len(x) == 3:
                self.file.seek(x[0])
                out.append((np.frombuffer(self.file.read(8 * x[1]), np.int64), np.frombuffer(self.file.read(4 * x[1]), np.int32)))
            else:
                self.held -= len(x[0])
                out.append(x)
        return out[0] if len(out) == 1 else (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Sorter:
    def __init__(self, text: np.ndarray, depth: int, most: int = 8_000_000):
        """``text``: symbols, ending with the only END. ``depth``: common prefixes count up to it."""
        self.t, self.depth, self.most = text, depth, most
        n = len(text)
        step = np.sign(np.diff(text.astype(np.int16))).astype(np.int8)  # -1: L, 1: S, 0: as the next
        known = np.flatnonzero(step)
        kind = np.ones(n, bool)
        kind[: known[-1] + 1 if len(known) else 0] = np.repeat(step[known] > 0, np.diff(np.concatenate([[-1], known])))
        self.s = kind  # S suffixes; END is one
        self.lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
        self.symbols = np.unique(text).tolist()

    def common(self, a: int, b: int) -> int:
        """Of two suffixes, by looking."""
        d = min(self.depth, len(self.t) - max(a, b))
        differ = np.flatnonzero(self.t[a : a + d] != self.t[b : b + d])
        return int(differ[0]) if len(differ) else d

    def induce(self, source: Queue, falling: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """One pass. Rising, over ``source`` = LMS suffixes by symbol: all L suffixes. Falling, over ``source`` = L
        suffixes: all S suffixes, largest first. Returns (symbol, places, common prefixes) in the order visited."""
        t, want_s, cap = self.t, falling, self.depth
        queue = Queue(max(self.symbols) + 1, self.most)
        last: dict[int, list] = {}  # target -> [source symbol, least common prefix since]
        out = []

        def visit(c: int, places: np.ndarray, common: np.ndarray) -> None:
            """Pushes what precedes these suffixes, which follow each other in the order of the pass."""
            prev = np.where(places > 0, t[places - 1], -1)
            ok = (places > 0) & ((prev <= c) if falling else (prev >= c)) & (self.s[places - 1] == want_s)
            if ok.any():
                d = prev[ok]
                at = np.flatnonzero(ok)
                order = np.argsort(d, kind="stable")
                d, at = d[order], at[order]
                edge = np.flatnonzero(np.diff(d)) + 1
                for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(d)], strict=True):
                    target, i = int(d[lo]), at[lo:hi]
                    since = last.get(target)
                    lead = 0 if since is None else 1 + min(since[1], int(common[: i[0] + 1].min())) if since[0] == c else 1
                    got = np.empty(len(i), np.int32)
                    got[0] = lead
                    if len(i) > 1:
                        got[1:] = 1 + np.minimum.reduceat(common[: i[-1] + 1], i[:-1] + 1)
                    queue.push(target, places[i] - 1, np.minimum(got, cap))
                    after = common[i[-1] + 1 :]
                    last[target] = [c, int(after.min()) if len(after) else cap]
                seen = {int(x) for x in d[np.concatenate([[0], edge])]}
            else:
                seen = set()
            least = int(common.min()) if len(common) else cap
            for target, since in last.items():
                if target not in seen and since[0] == c:
                    since[1] = min(since[1], least)

        for c in reversed(self.symbols) if falling else self.symbols:
            tail = None
            while (got := queue.pop(c)) is not None:
                out.append((c, *got))
                visit(c, *got)
                tail = int(got[0][-1])
            if (got := source.pop(c)) is not None:
                places, common = got
                common = common.copy()
                common[0] = 0 if tail is None else self.common(tail, int(places[0]))
                visit(c, places, common)
        queue.close()
        return out

    def by_symbol(self, places: np.ndarray, common: np.ndarray) -> Queue:
        """Ordered suffixes as a source."""
        q = Queue(max(self.symbols) + 1, self.most)
        c = self.t[places]
        edge = np.flatnonzero(np.diff(c)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(c)], strict=True):
            if hi > lo:
                q.push(int(c[lo]), places[lo:hi], common[lo:hi])
        return q

    def pass_both(self, lms: np.ndarray, common: np.ndarray):
        """L suffixes rising and S suffixes falling, as lists of (symbol, places, common prefixes)."""
        large = self.induce(self.by_symbol(lms, common), False)
        source = Queue(max(self.symbols) + 1, self.most)
        for c in self.symbols:
            mine = [x for x in large if x[0] == c]
            if mine:
                p = np.concatenate([x[1] for x in mine])[::-1]
                k = np.concatenate([x[2] for x in mine])
                # towards the smaller neighbour becomes towards the larger one
                source.push(c, p, np.concatenate([[0], k[1:][::-1]]).astype(np.int32))
        return large, self.induce(source, True)

    def lms_order(self) -> tuple[np.ndarray, np.ndarray]:
        """The LMS suffixes in order, with their common prefixes."""
        lms = self.lms
        if len(lms) < 2:
            return lms, np.zeros(len(lms), np.int32)
        start = lms[np.argsort(self.t[lms], kind="stable")]
        _, small = self.pass_both(start, np.zeros(len(start), np.int32))
        falling = np.concatenate([x[1] for x in small]) if small else np.zeros(0, np.int64)
        is_lms = np.zeros(len(self.t), bool)
        is_lms[lms] = True
        order = falling[::-1]
        order = order[is_lms[order]]
        if len(order) < len(lms):  # END induces nothing before it was placed itself
            order = np.concatenate([np.setdiff1d(lms, order), order])
        # names: equal substrings share one; substrings reach to the next LMS place, itself included
        number = np.empty(len(self.t), np.int64)
        number[lms] = np.arange(len(lms))
        k = number[order]
        size = np.diff(np.append(lms, len(self.t) - 1)) + 1
        h = prefix_hashes(self.t)
        here = lms[k]
        value = span_hash(h, here, np.minimum(here + size[k], len(self.t)))
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (size[k][1:] != size[k][:-1])])
        name = np.empty(len(lms), np.int64)
        name[k] = np.cumsum(new) - 1
        # the string of names, by doubling: deep enough when nothing is equal any more or ``depth`` is covered
        rank, reach = name, 1
        while reach < self.depth and rank.max() < len(rank) - 1:
            nxt = np.full(len(rank), -1, np.int64)
            nxt[: len(rank) - reach] = rank[reach:]
            key = rank * (len(rank) + 1) + nxt + 1
            _, rank = np.unique(key, return_inverse=True)
            reach *= 2
        order = lms[np.argsort(rank, kind="stable")]
        return order, common_prefixes(self.t, h, order, self.depth)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, common prefix of each with the one before it, up to ``depth``)."""
        lms, common = self.lms_order()
        large, small = self.pass_both(lms, common)
        places, prefix = [], []
        for c in self.symbols:
            up = [x for x in large if x[0] == c]
            down = [x for x in small if x[0] == c]
            tail = None
            if up:
                places.append(np.concatenate([x[1] for x in up]))
                k = np.concatenate([x[2] for x in up]).copy()
                k[0] = 0
                prefix.append(k)
                tail = int(places[-1][-1])
            if down:
                p = np.concatenate([x[1] for x in down])[::-1]
                k = np.concatenate([x[2] for x in down])
                k = np.concatenate([[0 if tail is None else self.common(tail, int(p[0]))], k[1:][::-1]]).astype(np.int32)
                places.append(p)
                prefix.append(k)
            if c == END:
                places.append(np.array([len(self.t) - 1]))
                prefix.append(np.zeros(1, np.int32))
        return np.concatenate(places), np.concatenate(prefix)


def prefix_hashes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from gneiss.llm.words import M3, POWERS, mix

    up, down = POWERS(len(t))
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(mix((t.astype(np.uint64) + np.uint64(1)) * M3) * up, out=total[1:])
    return total, down


def span_hash(h: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (h[0][b] - h[0][a]) * h[1][a]


def common_prefixes(t: np.ndarray, h, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix in ``order`` with the one before it, up to ``depth``, by bisection on hashes."""
    out = np.zeros(len(order), np.int32)
    a, b = order[:-1], order[1:]
    most = np.minimum(depth, len(t) - np.maximum(a, b))
    low = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(depth).bit_length() - 1)
    while step:
        to = low + step
        can = to <= most
        same = np.zeros(len(a), bool)
        same[can] = span_hash(h, a[can] + low[can], a[can] + to[can]) == span_hash(h, b[can] + low[can], b[can] + to[can])
        low = np.where(same, to, low)
        step //= 2
    out[1:] = low
    return out


def repeated_starts(pieces: list[bytes], length: int, most: int = 8_000_000) -> list[np.ndarray]:
    """For each piece the places whose next ``length`` bytes also start elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    t = data.astype(np.int16) + 2
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    t[begin + sizes] = CUT
    t = np.append(t, np.int16(END))
    order, prefix = Sorter(t, length, most).sort()
    near = prefix >= length
    hit = np.zeros(len(t), bool)
    hit[order[near]] = True
    hit[order[np.flatnonzero(near) - 1]] = True
    out = []
    for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        out.append(np.flatnonzero(hit[b : b + max(0, n - length + 1)]))
    return out
