"""The longest stretch that a text shares with any of many texts, by a suffix array in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of the texts looked up, and occurrences of blocks, that are held at a time.
_AT_ONCE = 1 << 19
_CODES = 21


def _codes(texts: list[str]) -> np.ndarray:
    """The code points of all texts, a zero after each."""
    return np.frombuffer("".join([f"{t}\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """At each place the codes from there on, as many as 64 bits hold, zeros behind the end."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(min(len(codes), 64 // bits)):
        out[: len(codes) - k] |= codes[k:].astype(np.uint64) << np.uint64(k * bits)
    return out


def _shared(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray, bits: int) -> np.ndarray:
    """How many characters from i in a and from j in b agree, at most `most`; a and b are packed."""
    out = np.zeros(len(i), np.int32)
    at = np.flatnonzero(most > 0)
    masks = [np.uint64((1 << (bits * k)) - 1) for k in range(1, 64 // bits)]
    while len(at):
        differs = a[i[at] + out[at]] ^ b[j[at] + out[at]]
        step = np.where(differs == 0, np.int32(1), np.int32(0))
        for m in masks:
            step += (differs & m) == 0
        out[at] += step
        at = at[(differs == 0) & (out[at] < most[at])]
    return np.minimum(out, most)


class Index:
    """Pieces of text, each of a group and with a start; ids in their order of preference, smaller first."""

    def __init__(self, groups: np.ndarray, texts: list[str], starts: np.ndarray, preference: np.ndarray) -> None:
        codes = _codes(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.groups, self.preference, self.pieces, self.n = groups.astype(np.int64), preference, len(texts), len(codes)
        ends = np.cumsum(lengths + 1) - 1
        self.piece = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)
        self.end = np.repeat(ends.astype(np.int32), lengths + 1)
        known = np.unique(codes)
        self.bits = 16 if len(known) < 1 << 16 else 32
        self.numbers = np.zeros(0x110000, np.uint16 if self.bits == 16 else np.uint32)
        self.numbers[known] = np.arange(1, len(known) + 1)
        self.packed = _packed(self.numbers[codes], self.bits)
        symbols = (self.groups[self.piece] << _CODES) | codes
        symbols[ends] = -1
        self._sort(symbols, int(lengths.max(initial=0)))
        self._tree()
        self.order = np.lexsort((preference, starts))
        self.starts = starts[self.order]
        self.first = np.searchsorted(self.starts, self.starts, "left")
        self.place = np.empty(len(texts), np.int64)
        self.place[self.order] = np.arange(len(texts))

    def _sort(self, symbols: np.ndarray, longest: int) -> None:
        """The places in the order of what follows up to the end of their piece, by doubling; the ends come first.

        A rank is the place of the first of a group of equals in the order; groups of one are done.
        """
        n = self.n
        rank = np.empty(n, np.int32)
        todo = np.argsort(symbols, kind="stable").astype(np.int32)
        keys, old = symbols[todo], None
        width, order = 0, todo.copy()
        while len(todo):
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.arange(len(todo), dtype=np.int32)
            if old is not None:
                heads = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
                at = old + at - heads
            order[at] = todo
            rank[todo] = np.maximum.accumulate(np.where(first, at, 0))
            width = max(1, width * 2)
            if width >= longest:
                break
            todo = todo[~(first & np.concatenate([first[1:], [True]]))]
            todo = todo[self.end[todo] >= todo + width]  # what ended before is equal for good
            behind = rank[np.minimum(todo + width, self.end[todo])]
            keys = rank[todo].astype(np.int64) * (n + 1) + behind
            by = np.argsort(keys, kind="stable")
            todo, keys = todo[by], keys[by]
            old = (keys // (n + 1)).astype(np.int32)
        self.sorted = order
        rank[order] = np.arange(n, dtype=np.int32)
        steps = symbols[:-1] * (n + 1)
        steps += rank[1:]
        steps = steps[symbols[:-1] >= 0]
        steps.sort()
        self.steps = steps

    def _tree(self) -> None:
        """Characters shared by each place and the one before it in the order, and a tree of their minima."""
        a, b = self.sorted[:-1], self.sorted[1:]
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        most[self.groups[self.piece[a]] != self.groups[self.piece[b]]] = 0
        self.leaves = 1 << self.n.bit_length()
        self.least = np.full(2 * self.leaves, -1, np.int32)
        self.least[self.leaves + 1 : self.leaves + self.n] = _shared(self.packed, a, self.packed, b, most, self.bits)
        size = self.leaves
        while size > 1:
            row = self.least[size : 2 * size]
            self.least[size // 2 : size] = np.minimum(row[::2], row[1::2])
            size //= 2

    def _below(self, at: np.ndarray, size: np.ndarray, side: int) -> np.ndarray:
        """The nearest place from `at` on, to the left (-1) or right (1), that shares less than `size` with the one before it."""
        node = at.astype(np.int64) + self.leaves
        on = np.flatnonzero(self.least[node] >= size)
        while len(on):
            node[on] = (node[on] + side) >> 1
            on = on[self.least[node[on]] >= size[on]]
        on = np.flatnonzero(node < self.leaves)
        while len(on):
            down = node[on] * 2 + (side < 0)
            node[on] = down + side * (self.least[down] >= size[on])
            on = on[node[on] < self.leaves]
        return node - self.leaves

    def nearest(self, groups: np.ndarray, texts: list[str], starts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, piece, characters, distance), as arrays: of the pieces of its group that share the longest stretch with a
        text the one that starts nearest, the preferred one of these. Texts that share fewer than `least` are left out."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        some = np.flatnonzero(lengths >= least)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[some]) // _AT_ONCE)) + 1
        for part in np.split(some, cuts):
            if len(part):
                yield from self._of_part(part, groups[part], [texts[k] for k in part.tolist()], lengths[part], starts[part], least)

    def _of_part(self, names: np.ndarray, groups: np.ndarray, texts: list[str], lengths: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
        codes = _codes(texts)
        offsets = np.cumsum(lengths + 1) - lengths - 1
        row = np.repeat(np.arange(len(texts)), lengths + 1)
        end = (offsets + lengths)[row]
        packed = _packed(self.numbers[codes], self.bits)
        symbols = ((groups.astype(np.int64)[row] << _CODES) | codes) * (self.n + 1)
        # From the last character to the first, of all texts at once: how many places come before what follows.
        before = np.zeros(len(codes), np.int64)
        longest_first = np.argsort(-lengths, kind="stable")
        bases, now = offsets[longest_first], np.zeros(len(texts), np.int64)
        counts = np.searchsorted(-lengths[longest_first], -np.arange(lengths.max()), "left")
        for p in range(len(counts) - 1, -1, -1):
            at = bases[: counts[p]] + p
            now[: counts[p]] = before[at] = self.pieces + np.searchsorted(self.steps, symbols[at] + now[: counts[p]], "left")
        at = np.flatnonzero(np.arange(len(codes)) < end)
        before, row, left = before[at], row[at], (end - np.arange(len(codes)))[at]

        def shared(places: np.ndarray) -> np.ndarray:
            g = self.sorted[places]
            most = np.minimum(left, self.end[g] - g)
            most[self.groups[self.piece[g]] != groups[row]] = 0
            return _shared(packed, at, self.packed, g, most.astype(np.int32), self.bits)

        lower, upper = np.maximum(before - 1, 0), np.minimum(before, self.n - 1)
        by_lower = shared(lower)
        both = np.maximum(by_lower, shared(upper))
        most = np.maximum.reduceat(both, np.cumsum(lengths) - lengths)
        hit = np.flatnonzero((both == most[row]) & (both >= least))
        if not len(hit):
            return
        size, row = both[hit], row[hit]
        base = np.where(by_lower[hit] == size, lower[hit], upper[hit])
        lo, hi = self._below(base, size, -1), self._below(base + 1, size, 1)
        blocks, block = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        lo, hi = blocks // (self.n + 1), blocks % (self.n + 1)
        by_block = np.argsort(block, kind="stable")
        sizes = hi - lo
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // _AT_ONCE)) + 1).tolist(), len(blocks)]
        found = []
        for x, y in zip(edges, edges[1:]):
            q = by_block[slice(*np.searchsorted(block[by_block], [x, y]))]
            found.append(self._in_blocks(lo[x:y], sizes[x:y], block[q] - x, row[q], starts[row[q]]))
        row, piece, distance = (np.concatenate(c) for c in zip(*found))
        best = np.lexsort((self.preference[piece], distance, row))
        best = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])]
        yield names[row[best]], piece[best], most[row[best]], distance[best]

    def _in_blocks(self, lo: np.ndarray, sizes: np.ndarray, block: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, piece, distance) of the piece nearest to each start among those of the row's block, which is sizes places from lo on."""
        m = self.pieces
        number = np.repeat(np.arange(len(lo)), sizes)
        places = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes)
        members = np.sort(number * m + self.place[self.piece[self.sorted[places]]])
        low = block * m
        j = np.searchsorted(members, low + np.searchsorted(self.starts, starts, "left"))
        after, ago = np.minimum(j, len(members) - 1), np.maximum(j - 1, 0)
        has_after = (j < len(members)) & (members[after] < low + m)
        has_ago = (j > 0) & (members[ago] >= low)
        after = np.where(has_after, members[after] - low, 0)
        ago = np.where(has_ago, members[ago] - low, 0)
        ago = np.where(has_ago, members[np.minimum(np.searchsorted(members, low + self.first[ago]), len(members) - 1)] - low, 0)
        d_after, d_ago = self.starts[after] - starts, starts - self.starts[ago]
        earlier = has_ago & (~has_after | (d_ago < d_after) | ((d_ago == d_after) & (self.preference[self.order[ago]] < self.preference[self.order[after]])))
        return row, self.order[np.where(earlier, ago, after)], np.where(earlier, d_ago, d_after)
