"""Texts of Arrow batches as one byte buffer, and vectorized hashes over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about limit bytes: the rows, their bytes end to end, and where each row starts (and the last ends)."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
        _, offsets, data = values.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(values) + 1, values.offset * (8 if wide else 4)).astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(values):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    n = len(data) - 7
    out = np.empty(max(n, 0), U64)
    for r in range(min(8, max(n, 0))):
        count = (len(data) - r) // 8
        out[r::8] = np.frombuffer(data[r : r + 8 * count].tobytes(), "<u8")
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 24 bytes from each place."""
    e = eights(data)
    n = len(e) - 16
    if n <= 0:
        return np.empty(0, U64)
    x = e[:n] * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x += e[8 : n + 8]
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x += e[16 : n + 16]
    return mixed(x)


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    step, out = 1, h
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        step *= 2
    rest = width - step
    return (np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte value, and an odd multiplier, for hashes of byte strings.
_OF_BYTE = _RNG.integers(0, 1 << 64, 256, U64)
_BASE = U64(int(_RNG.integers(0, 1 << 64, dtype=U64)) | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", U64(pow(int(_BASE), -1, 1 << 64)))):
            x = np.full(n, base, U64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_OF_LOWER = _OF_BYTE[_LOWER]


def word_hashes(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes that aren't gaps, A-Z lower-cased) of texts end to end, and the text each is in."""
    word = np.empty(len(data) + 1, bool)
    word[:-1] = ~gap[data]
    word[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_OF_LOWER[data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mixed(h), np.searchsorted(at, begin, "right") - 1


def prefix_hashes(data: np.ndarray, at: np.ndarray, gap: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their first bytes, for each length of which a word has more, and where each one's word begins."""
    word = np.append(~gap[data], False)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:]
    end[:-1] &= ~word[1:] | edge[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_OF_LOWER[data] * up[: len(data)], out=sums[1:])
    out, of = [mixed((sums[end] - sums[begin]) * down[begin])], [begin]
    for k in lengths:
        long = begin[end - begin > k]
        # Another constant per length, so a prefix isn't the word of the same letters.
        out.append(mixed((sums[long + k] - sums[long]) * down[long] + U64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
        of.append(long)
    return np.concatenate(out), np.concatenate(of)
