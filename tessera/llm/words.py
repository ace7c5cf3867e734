"""Whole texts of an Arrow batch as arrays of 64-bit word hashes.

The n-gram operators work on these arrays: numpy goes over the bytes of many texts
at once and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers; any odd number would do.
STEP, LONG = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)
#: Texts are worked on in runs of about so many bytes, which bounds the arrays.
RUN_BYTES = 1 << 20


def _inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, made as far as they are needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.n = base, 0
        self.up = self.down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = n + (n >> 3) + (1 << 16)
            ones = np.full(self.n, self.base, U64)
            ones[0] = 1
            self.up = np.multiply.accumulate(ones)
            ones[1:] = U64(_inverse(self.base))
            self.down = np.multiply.accumulate(ones)
        return self.up, self.down


_WORDS = _Powers(STEP)
#: What a word's last block of n bytes keeps of eight.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all 64 (the finalizer of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: Words between the ASCII white-space bytes 0x20 and 0x09 to 0x0D.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Runs of ASCII letters and digits and of all bytes of other characters.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class Words:
    """The words of a run of texts.

    first: its first row in the batch; data: bytes of all its texts; hashes: a hash
    of each word; begin, end: its bytes in data; rows and bytes_at: where each text's
    words and bytes begin, with their number at the end.
    """

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool) -> None:
        self.first, self.data, self.bytes_at = first, data, at
        n = len(data)
        if lower:
            data = _LOWER[data]
        inside = np.zeros(n + 1, bool)
        inside[:n] = kind[data] if n else False
        head = np.zeros(n + 1, bool)
        head[at] = True  # a word ends where its text does
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | head[1:]
        ends = inside[:-1] & (~inside[1:] | head[1:])
        self.begin, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.begin, at)
        self.hashes = hashes(data, self.begin, self.end)

    def __len__(self) -> int:
        return len(self.rows) - 1

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on; those of the last n - 1 words are left out, and some cross texts."""
        return grams(self.hashes, n)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text are left, itself included."""
        sizes = np.diff(self.rows)
        return np.repeat(self.rows[1:], sizes) - np.arange(self.rows[-1])


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes: of its blocks of eight bytes, each mixed with its number, and of its length.

    Different words of one length, up to eight bytes, never share a hash.
    """
    size = end - begin
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(eight[begin] & _KEPT[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    if len(more):
        blocks = (size[more] - 1) // 8  # those behind the first
        number = np.arange(1, blocks.sum() + 1) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = np.repeat(begin[more], blocks) + 8 * number
        left = np.repeat(end[more], blocks) - at
        mixed = mix((eight[at] & _KEPT[np.minimum(left, 8)]) + mix(number.astype(U64) * LONG))
        out[more] += np.add.reduceat(mixed, np.cumsum(blocks) - blocks)
    return mix(out + size.astype(U64) * LONG)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n hashes from each on; n is small, as the sum is one of powers modulo 2**64."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.empty(0, U64)
    up, down = _WORDS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:total]) * down[:total] + U64(n))


def spans(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binary values, nulls as empty ones, and where each text begins, with the end of the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column, kind: np.ndarray = NOT_SPACE, lower: bool = False, run_bytes: int = RUN_BYTES) -> Iterator[Words]:
    """Words of all texts of a column, a run of rows at a time; a text is never split."""
    data, at = spans(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + run_bytes, "right")) - 1)
        j = min(j, n)
        yield Words(i, data[at[i] : at[j]], at[i : j + 1] - at[i], kind, lower)
        i = j
