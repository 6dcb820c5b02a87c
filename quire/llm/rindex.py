"""A run-length index over short byte strings: of their Burrows-Wheeler transform only samples at the heads of its runs are kept."""

from __future__ import annotations

import numpy as np

from quire.llm.bytestools import U64, eights

#: Symbols that an index can hold: two ranks and a place share 64 bits while it is built.
MOST = 1 << 20


class RunIndex:
    """Strings end to end, each closed by an end sign that is less than all bytes (earlier strings' signs are less than later ones').

    The suffixes' order is needed to find the transform's runs, and then let go.
    For each run the index keeps, in the order of the text:

    places   where the suffix at the run's head starts
    above    where the suffix in the row before it starts
    common   how many symbols the two share

    Inside a run, a suffix and the one in the row before it have the same symbol
    before them, so the suffixes that are one symbol longer lie in neighbouring
    rows, too, and share one symbol more.  Read the other way, each place takes
    its neighbour from the last sampled place before it, shifted by the distance,
    and shares as many symbols less.  So a pass over the text streams every
    place's matching statistics from the samples, and a repetitive text has few.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """data: the strings' bytes end to end; starts: where each starts, and the last ends."""
        lengths = np.diff(starts)
        count = len(lengths)
        n = len(data) + count
        if n > MOST:
            raise ValueError(f"{n} symbols are more than {MOST}")
        self.starts = starts[:-1] + np.arange(count)
        ends = self.starts + lengths
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data.astype(np.int64) + 1
        self.n, self.lengths = n, lengths
        left = self.left()
        self._text, self._left = text, left
        order = self._sorted(int(lengths.max(initial=0)) + 1)
        before = np.where(order == 0, 0, text[order - 1])
        # The signs before a string's first symbol differ from one another, so each begins a run.
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        rows = np.flatnonzero(head)
        places, above = order[rows], order[rows - 1]
        common = self._common(above, places)
        if n:
            common[0] = 0
        by_place = np.argsort(places)
        self.places, self.above, self.common = places[by_place], above[by_place], common[by_place]
        del self._text, self._left

    def left(self) -> np.ndarray:
        """Symbols from each place to the end sign, without it."""
        return np.repeat(self.starts + self.lengths, self.lengths + 1) - np.arange(self.n)

    def _sorted(self, longest: int) -> np.ndarray:
        """Places in suffix order, by doubling the length that is sorted; only places that still tie are sorted again."""
        n = self.n
        # Symbols are numbered anew, so that as many as possible share a key with a place.
        used = np.bincount(self._text, minlength=257) > 0
        used[0] = True
        bits = int(used.sum() - 1).bit_length()
        key, depth = (np.cumsum(used) - 1)[self._text].astype(U64), 1
        while bits and depth < min(44 // bits, longest):
            # What follows the first symbols of a key are the first ones of another, or nothing beyond an end.
            more = min(depth, min(44 // bits, longest) - depth)
            then = np.zeros(n, U64)
            then[: n - depth] = key[depth:] >> U64(bits * (depth - more))
            then[self._left < depth] = 0
            key = (key << U64(bits * more)) | then
            depth += more
        packed = np.sort((key << U64(20)) | np.arange(n, dtype=U64))
        order = (packed & U64(MOST - 1)).astype(np.int64)
        high = packed >> U64(20)
        new = np.ones(n, bool)
        new[1:] = high[1:] != high[:-1]
        # A place's rank is the row where those that tie with it begin.
        rank, rows = np.empty(n, np.int64), np.arange(n)
        rank[order] = np.maximum.accumulate(np.where(new, rows, 0))
        while depth < longest:
            # Rows of groups of several; a group stays together in all that follows.
            tied = ~new
            tied[:-1] |= ~new[1:]
            rows, new = rows[tied], new[tied]
            if not len(rows):
                break
            place = order[rows]
            # Ranks and places stay below 2 ** 20 each, with room for 0 as "nothing follows".
            then = np.where(self._left[place] >= depth, rank[np.minimum(place + depth, n - 1)] + 1, 0)
            packed = np.sort((((rank[place] << 21) | then) << 20 | place).view(U64))
            place = (packed & U64(MOST - 1)).astype(np.int64)
            high = packed >> U64(20)
            new[1:] = high[1:] != high[:-1]
            order[rows] = place
            rank[place] = np.maximum.accumulate(np.where(new, rows, 0))
            depth *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at places a and b share, compared eight at a time; end signs differ."""
        most = np.minimum(self._left[a], self._left[b])
        out = np.zeros(len(a), np.int64)
        # An end sign's byte doesn't matter, as no comparison goes beyond most.
        words = eights(np.append(self._text.astype(np.uint8), np.zeros(8, np.uint8)))
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            at = out[open_]
            x = words[a[open_] + at] ^ words[b[open_] + at]
            out[open_] += np.where(x == 0, 8, np.bitwise_count((x & (~x + U64(1))) - U64(1)) >> 3)
            open_ = open_[(x == 0) & (at + 8 < most[open_])]
        return np.minimum(out, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Streamed in text order: the symbols that each place's suffix shares with the one in the row before it, and where that one starts."""
        run = np.repeat(np.arange(len(self.places)), np.diff(np.append(self.places, self.n)))
        ahead = np.arange(self.n) - self.places[run]
        return self.common[run] - ahead, self.above[run] + ahead

    def least_owner(self, owner: np.ndarray, width: int) -> np.ndarray:
        """For each place with width symbols left, the least owner of a string that holds the same symbols; -1 elsewhere.

        Places whose statistics reach width have an equal window in the row before;
        following it, all places of one window come to the first row that has it.
        """
        shared, above = self.statistics()
        long = np.flatnonzero(self.left() >= width)
        own = np.repeat(owner, self.lengths + 1)
        first = np.arange(self.n)
        repeated = np.flatnonzero(shared >= width)
        first[repeated] = above[repeated]
        while len(repeated):
            further = first[first[repeated]]
            moved = further != first[repeated]
            first[repeated] = further
            repeated = repeated[moved]
        least = own.copy()
        again = long[first[long] != long]
        np.minimum.at(least, first[again], own[again])
        out = np.full(self.n, -1, np.int64)
        out[long] = least[first[long]]
        return out
