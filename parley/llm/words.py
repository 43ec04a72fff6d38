"""Words of many texts at once, as positions in one byte buffer, and 64-bit hashes of them."""

import numpy as np
import pyarrow as pa

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of ASCII letters in lower case, of digits and of what isn't ASCII as they are, all others as a space.
WORD_BYTES = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)], np.uint8)


class Words:
    """start, end: byte positions of each word; first: the number of the first word of each row, n + 1 of them."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        """table: what each byte stands for, before words are split at white space."""
        self.data, self.offsets = buffer_of(column)
        if table is not None:
            self.data = table[self.data]
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.ones(len(self.data), bool)
        before[1:] = blank[:-1]
        after = np.ones(len(self.data), bool)
        after[:-1] = blank[1:]
        self.start = np.flatnonzero(~blank & (before | edge[:-1]))
        self.end = np.flatnonzero(~blank & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    def _eight(self) -> np.ndarray:
        """The eight bytes from each position on, as an integer."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(self.data) + 1,), (1,))

    def heads(self, size: int) -> np.ndarray:
        """The first size bytes (8 at most) of each word, as an integer."""
        return self._eight()[self.start] & _LOW[np.minimum(self.end - self.start, size)]

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, eight of them at a time."""
        eight, left = self._eight(), self.end - self.start
        out = mix(left.astype(np.uint64) * _A + _B)
        at, which = self.start, None
        while len(at):
            value = eight[at] & _LOW[np.minimum(left, 8)]
            if which is None:
                out = mix((out ^ value) * _A)
                which = np.flatnonzero(left > 8)
            else:
                out[which] = mix((out[which] ^ value) * _A)
                which = which[left > 8]
            more = left > 8
            at, left = at[more] + 8, left[more] - 8
        return out


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(left * _A + right)
