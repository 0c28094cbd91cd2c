"""Words, hashes and byte arrays of Arrow text columns, many texts at a time.

A *word* is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Nothing here looks at one
text alone: the texts of a slice lie end to end in one byte array, and words are
index ranges of it. Slices hold about ``SLICE_BYTES`` of text, so the memory of a
task does not depend on the size of its batch (one longer text is a slice of its own).
"""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000
SMALL_BYTES = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Odd multiplier of the rolling word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Hand memory that is free in this process to the system: Arrow's pool, and the heap where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def trimmed(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; at its end free memory goes back, as the process waits for other tasks beside the JVM."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (every bit depends on every bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end and the offsets of each; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    at, rows = 0, len(column)
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 values)."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = np.flatnonzero(np.diff(offsets))
    at = offsets[filled]
    first[at] = word[at]
    at = offsets[filled + 1] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        # one step up at a time: a process that only sees small slices keeps a small table
        step = np.full(max(n, SMALL_BYTES + 1 if n <= SMALL_BYTES + 1 else SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return _powers[kind][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, the same wherever the word stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the first index of each text's runs.

    A text with fewer words has its whole sequence as one run; one without words none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(made.sum(), np.uint64)
    edges = np.concatenate(([0], np.cumsum(made)))
    full = np.flatnonzero(counts >= width)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_BASE) + hashes[k:k + len(rolled)]
    if len(full):
        inside = np.ones(len(hashes) + 1, np.int8)
        # a run may start at all words of a text but its last width - 1
        take = ranges(bounds[full], made[full])
        out[ranges(edges[full], made[full])] = rolled[take]
        del inside
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for x in hashes[bounds[d]:bounds[d + 1]]:
                h = h * np.uint64(_BASE) + x
        out[edges[d]] = h
    return mix(out), edges


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def distinct_per_text(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and the new edges."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[keep], t[keep]
    return v, np.searchsorted(t, np.arange(len(edges)))


_CHECK = np.random.default_rng(20260102).integers(0, 1 << 63, 256, dtype=np.uint64)


class WordMemo:
    """Ids of words met before in this process, found by hash; emptied when it holds ``most`` words.

    A word is known by its 64-bit hash; a second, independent 64-bit sum of its bytes tells words of
    one hash apart, and a slice that holds two such words is encoded word by word.
    ``encode`` maps a list of words (bytes) to a list of id sequences.
    """

    def __init__(self, encode, most: int = 900_000):
        self.encode, self.most = encode, most
        self.hashes, self.checks, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[starts:ends]`` one after the other, and the number of each."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CHECK[data], out=sums[1:])
        check = sums[ends] - sums[starts]
        codes, unique = pd.factorize(word_hashes(data, starts, ends))
        first = np.empty(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the earliest write comes last
        if (check != check[first][codes]).any():
            return self._plain(data, starts, ends)
        if len(self.hashes) + len(unique) > self.most:
            self.__init__(self.encode, self.most)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        if (self.checks[at[known]] != check[first[known]]).any():
            return self._plain(data, starts, ends)
        place = np.empty(len(unique), np.int64)
        place[known] = self.place[at[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            text = data.tobytes()
            lengths, flat = self._encoded([text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place[new] = len(self.starts) - 1 + np.arange(len(new))
            self.flat = np.concatenate((self.flat, flat))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
            hashes = np.concatenate((self.hashes, unique[new]))
            order = np.argsort(hashes, kind="stable")
            self.hashes = hashes[order]
            self.checks = np.concatenate((self.checks, check[first[new]]))[order]
            self.place = np.concatenate((self.place, place[new]))[order]
        counts = np.diff(self.starts)[place]
        return self.flat[ranges(self.starts[place[codes]], counts[codes])], counts[codes]

    def _encoded(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(spans)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))

    def _plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes()
        lengths, flat = self._encoded([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        return flat, lengths
