"""Words of many texts at once: arrays over the bytes of a batch, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once (a longer text is worked on alone).
BYTES = 1 << 20
#: An odd multiplier for hashes.
ODD = 0x9E3779B97F4A7C15
#: Eight bytes as a number, cut to the first so many of them.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans of more bytes are hashed and compared one by one.
LONG = 64


def _white() -> np.ndarray:
    """For each byte, whether it is white space: 0x20 and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each number, mixed well."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class TextBlock:
    """Texts side by side: data (their bytes), text_at (bounds), and words with first and last bounds, text and hash.

    A byte of text takes about 20 bytes of arrays, so a text has to fit a task's memory that many times.
    """

    def __init__(self, data: np.ndarray, text_at: np.ndarray):
        self.data, self.text_at, self.n = data, text_at, len(text_at) - 1

    @cached_property
    def white(self) -> np.ndarray:
        return _white()[self.data]

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        white = self.white
        edge = np.zeros(len(white) + 1, bool)
        edge[self.text_at] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= white[:-1]
        after[:-1] |= white[1:]
        return np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1

    @property
    def first(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def last(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def word_at(self) -> np.ndarray:
        """Bounds of each text's words."""
        return np.searchsorted(self.first, self.text_at)

    @cached_property
    def words(self) -> np.ndarray:
        return np.diff(self.word_at)

    @cached_property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.words)

    @cached_property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word; words of up to seven bytes all differ."""
        return mixed(self.keys(self.first, self.last))

    @cached_property
    def word_ids(self) -> np.ndarray:
        """A number for each word; two are equal exactly if the words are."""
        return self.same(self.first, self.last)[1]

    @cached_property
    def _eight(self) -> np.ndarray:
        """For each byte, it and the seven behind it as a number (zeros behind the end)."""
        padded = np.zeros(len(self.data) + 16, np.uint8)
        padded[: len(self.data)] = self.data
        return np.ndarray(len(self.data) + 9, "<u8", padded, strides=(1,)).astype(np.uint64)

    def eight(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The bytes from each place on as a number, n of them (beyond eight: eight; below none: none)."""
        return self._eight[at] & FIRST_BYTES[np.clip(n, 0, 8)]

    def keys(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A number for the bytes from first to last, for each; where it is below 2**63 it says them all, else it is a hash."""
        n = last - first
        out = self.eight(first, n)
        with np.errstate(over="ignore"):
            few = n <= 7
            out[few] |= n[few].astype(np.uint64) << np.uint64(56)
            more = np.flatnonzero(~few)
            h = mixed(out[more] + n[more].astype(np.uint64) * np.uint64(ODD))
            open_, step = np.flatnonzero(n[more] > 8), 8
            while len(open_) and step < LONG:
                at = more[open_]
                h[open_] = mixed(h[open_] * np.uint64(ODD) + self.eight(first[at] + step, n[at] - step))
                step += 8
                open_ = open_[n[at] > step]
            for k in open_.tolist():
                h[k] = xxhash.xxh64_intdigest(self.data[first[more[k]] : last[more[k]]])
        out[more] = h | np.uint64(1 << 63)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a and from b on are equal, for each."""
        out = np.ones(len(a), bool)
        open_, step = np.flatnonzero(n > 0), 0
        while len(open_) and step < LONG:
            same = self.eight(a[open_] + step, n[open_] - step) == self.eight(b[open_] + step, n[open_] - step)
            out[open_[~same]] = False
            step += 8
            open_ = open_[same & (n[open_] > step)]
        for k in open_.tolist():
            out[k] = np.array_equal(self.data[a[k] : a[k] + n[k]], self.data[b[k] : b[k] + n[k]])
        return out

    def same(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(some, which): a span of each kind, and the kind of each span. Spans are of one kind exactly if their bytes are equal."""
        keys = self.keys(first, last)
        _, some, which = np.unique(keys, return_index=True, return_inverse=True)
        check = np.flatnonzero(keys >> np.uint64(63))
        check = check[some[which[check]] != check]
        held = some[which[check]]
        n = last - first
        right = (n[check] == n[held]) & self.equal(first[check], first[held], np.minimum(n[check], n[held]))
        if not right.all():  # different bytes with one hash
            kinds: dict[bytes, int] = {}
            extra = []
            for k in check[~right].tolist():
                kind = kinds.setdefault(self.data[first[k] : last[k]].tobytes(), len(some) + len(kinds))
                if kind == len(some) + len(extra):
                    extra.append(k)
                which[k] = kind
            some = np.concatenate((some, np.array(extra, some.dtype)))
        return some, which

    def count(self, marked: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes are marked."""
        run = np.concatenate(([0], np.cumsum(marked)))
        return run[self.text_at[1:]] - run[self.text_at[:-1]]

    def followed(self, width: int) -> np.ndarray:
        """The words that begin a window of width words within their text."""
        k = np.arange(len(self.first))
        return k[k + width <= self.word_at[1:][self.text]]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that begin windows of width words, and hashes of the windows."""
        at = self.followed(width)
        out = self.hash[at]
        with np.errstate(over="ignore"):
            for k in range(1, width):
                out = mixed(out * np.uint64(ODD) + self.hash[at + k])
        return at, out

    def per_text(self, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(text, weights, self.n)


def blocks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, last bound, block) over a column of strings, size bytes (BYTES) to a block; null counts as empty."""
    size = size or BYTES
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2] if len(column) else None
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, to, TextBlock(data[at[row] : at[to]], at[row : to + 1] - at[row])
        row = to
