"""Word and n-gram hashing of whole Arrow batches with numpy, without a Python loop over words.

Texts are handled as UTF-8 bytes. A separator rule is a table of 256 booleans, so that a word is a
maximal run of bytes that aren't separators; bytes of non-ASCII characters are never separators,
which makes this equal to the same rule over code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes that are hashed at once; only the hashes of a longer text are held whole.
BLOCK = 1 << 18
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1

BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the longest one asked for is kept."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        steps = np.full(max(n, BLOCK) + 1, base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run buf[start:end]; runs are ascending and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        forward, back = _power_table(_P, high - low), _power_table(pow(_P, -1, 1 << 64), high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((buf[low:high].astype(np.uint64) + np.uint64(1)) * forward[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """The words of a batch of texts. Words of text d are those from ptr[d] to ptr[d + 1]."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_runs(self.buf, self.starts, self.ends)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word."""
        return hash_runs(self.buf, self.starts, np.minimum(self.ends, self.starts + n))

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())

    def joined(self, keep: np.ndarray | None = None) -> list[bytes]:
        """The words of each text, or of those the ones to keep, joined by one space.

        A word is followed by a separator wherever another one comes after it; that byte becomes the space.
        """
        at = np.arange(len(self.starts)) if keep is None else np.flatnonzero(keep)
        owner = np.searchsorted(self.ptr, at, "right") - 1
        edges = np.zeros(len(self.buf) + 1, np.int8)
        edges[self.starts[at]] += 1
        edges[self.ends[at]] -= 1
        taken, buf = np.cumsum(edges[:-1], dtype=np.int8) > 0, self.buf.copy()
        spaces = self.ends[at[:-1][owner[1:] == owner[:-1]]] if len(at) else at
        taken[spaces], buf[spaces] = True, 32
        ends = np.concatenate([[0], np.cumsum(taken)])[self.offsets]
        kept = buf[taken].tobytes()
        return [kept[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data = column.buffers()
    offsets = np.frombuffer(data[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data[2], np.uint8)[offsets[0] : offsets[-1]] if data[2] is not None and data[2].size else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


#: Bytes of text that a task works on at once, unless one text is longer.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of the given string column, which bounds memory."""
    for batch in batches:
        _, offsets = bytes_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def words_of(column: pa.Array, separators: np.ndarray = BLANKS, lower: bool = False) -> Words:
    buf, offsets = bytes_of(column)
    return split_words(buf, offsets, separators, lower)


def split_words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, lower: bool = False) -> Words:
    if lower:
        buf = LOWER[buf]
    inside = ~separators[buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Unmixed polynomial hash of the n hashes from each position on, by doubling; 0 where too few follow.

    Positions near the end of a text reach into the next one: see inside().
    """
    length, total, power = 0, np.zeros(len(hashes), np.uint64), hashes.copy()
    span = 1
    while n >> (span.bit_length() - 1):
        if n & span:
            total = _joined(total, length, power)
            length += span
        if n < 2 * span:
            break
        power, span = _joined(power, span, power), 2 * span
    return total


def _joined(left: np.ndarray, length: int, right: np.ndarray) -> np.ndarray:
    """Hash of the window of `length` at left followed by the one at right."""
    if not length:
        return right.copy()
    out = left.copy()
    if length < len(out):
        out[:-length] += right[length:] * np.uint64(pow(_Q, length, 1 << 64))
        out[-length:] = 0
    else:
        out[:] = 0
    return out


def inside(ptr: np.ndarray, n: int) -> np.ndarray:
    """Which positions have n words from there to the end of their own text."""
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(ptr[-1])
    return left >= n


def windows(hashes: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all n-word windows, and which positions have one."""
    return mix(grams(hashes, n)), inside(ptr, n)


def _slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or greatest of the n values from each position on; past the end, what there is."""
    op, fill = (np.minimum, MAX64) if least else (np.maximum, np.uint64(0))
    out, span = x.copy(), 1
    while span < n:
        step = min(span, n - span)
        moved = np.full(len(out), fill, np.uint64)
        moved[: max(0, len(out) - step)] = out[step:]
        out, span = op(out, moved), span + step
    return out


def slide_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each position on."""
    return _slide(x, n, True)


def winnow(fingerprints: np.ndarray, ptr: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of k-grams that are least among some w successive ones of their text.

    Every span of k + w - 1 words holds one at least. Ties are all kept.
    """
    spans = inside(ptr, k + w - 1)
    least = _slide(fingerprints, w, True)
    least[~spans] = 0
    # A position is chosen if one of the w windows that hold it has this value as its least.
    reach = _slide(least[::-1], w, False)[::-1]
    return np.flatnonzero((reach == fingerprints) & inside(ptr, k))


def grams_at(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """grams(hashes, n)[starts], worked out for these positions alone."""
    total = np.zeros(len(starts), np.uint64)
    for j in range(n):
        total += hashes[starts + j] * np.uint64(pow(_Q, j, 1 << 64))
    return total


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column whose rows take `counts` of the values each."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
