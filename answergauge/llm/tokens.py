"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A byte-level BPE cuts a text into words first, and no word goes over some places: from a letter to an ASCII character
that is none, and back; before a space that a visible character follows; around a line end that stands alone. Texts are
cut into pieces at these places (all at once, over the bytes of a block of texts), so the ids of the pieces in a row are the
ids of the text. A worker keeps the ids of the pieces it has seen, by their bytes, and the library encodes the others.
Strings of the tokenizer's own tokens (such as an end of text) in a text get the ids that the library gives them, which by
default are those of the tokens; PieceEncoder(path, plain=True) takes them as ordinary text.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from . import store
from .text_block import ODD, TextBlock, mixed

#: Pieces, and ids of pieces, that a worker keeps; beyond, it forgets those that it has seen least.
KEPT, KEPT_IDS = 1_000_000, 6_000_000
#: Pieces of up to PAIR bytes are kept in a table of numbers, the others in a dict; words that the library gets in one string.
PAIR, JOINED = 15, 4096
#: Bytes of text in a block: more of them have fewer distinct pieces for their size.
BLOCK = 2 << 20
#: The settings of the pre-tokenizer that pieces are right for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Kinds of bytes. A letter of two bytes from U+00C0 to U+00FF counts as letters; other bytes beyond ASCII are unknown.
LETTER, DIGIT, OTHER, QUOTE, SPACE, LINE, UNKNOWN = range(7)


def _kinds() -> np.ndarray:
    """For each byte, its kind."""
    table = np.full(256, OTHER, np.uint8)
    table[0x80:] = UNKNOWN
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    table[0x30:0x3A] = DIGIT
    table[0x27], table[0x20] = QUOTE, SPACE
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = LINE
    return table


def _cut() -> np.ndarray:
    """For a byte's kind and that of the next, whether a word always ends between them, whatever else the text has."""
    table = np.zeros((7, 7), bool)
    table[LETTER, [DIGIT, OTHER, QUOTE, SPACE, LINE]] = True
    table[DIGIT, [LETTER, OTHER, QUOTE, SPACE, LINE]] = True
    table[OTHER, [LETTER, DIGIT, SPACE, LINE]] = True  # not before a quote: both may be of one word
    table[QUOTE, [DIGIT, SPACE, LINE]] = True  # not before a letter: 's is a word
    return table


def kinds(data: np.ndarray) -> np.ndarray:
    kind = _kinds()[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division are no letters
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def cuts(block: TextBlock, whole: list[tuple[int, int]] | None = None, kind: np.ndarray | None = None) -> np.ndarray:
    """Where pieces begin, as places in the block's bytes, ascending; every text that isn't empty begins one.

    whole: bounds of pieces that are known; what is before and behind them is like texts of their own.
    """
    data = block.data
    if not len(data):
        return np.zeros(0, np.int64)
    if kind is None:
        kind = kinds(data)
    begin = np.zeros(len(data) + 1, bool)
    begin[block.text_at] = True
    if whole:
        begin[np.array(whole).ravel()] = True
    before, now = kind[:-1], kind[1:]
    at = _cut()[before, now]
    # A space goes with the character behind it, if that is visible; the bytes left out may begin a white space.
    visible = (kind <= QUOTE) | (kind == UNKNOWN) & (data != 0xC2) & (data != 0xE1) & (data != 0xE2) & (data != 0xE3)
    at[:-1] |= (now[:-1] == SPACE) & visible[2:] & ~begin[2:-1]
    # A line end alone, between characters that are known to be visible, is a word.
    alone = (before[1:] == LINE) & (now[1:] <= QUOTE) & ((before[:-1] <= QUOTE) | begin[1:-2])
    at[1:] |= alone
    begin[1:-1] |= at
    if len(data) > 1:  # a line end that begins a text and the block
        begin[1] |= kind[0] == LINE and kind[1] <= QUOTE
    for a, b in whole or ():
        begin[a + 1 : b] = False
    return np.flatnonzero(begin[:-1])


class PairTable:
    """Places of keys of two numbers (the second is never 0): open addressing, all keys of a call at once."""

    def __init__(self, bits: int = 12):
        self.rows, self.used = np.zeros((1 << bits, 3), np.uint64), 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(low * np.uint64(ODD) + high) & np.uint64(len(self.rows) - 1)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none."""
        out, slot, open_ = np.full(len(low), -1), self._slots(low, high), np.arange(len(low))
        while len(open_):
            row = self.rows[slot[open_]]
            hit = (row[:, 0] == low[open_]) & (row[:, 1] == high[open_])
            out[open_[hit]] = row[hit, 2]
            open_ = open_[~hit & (row[:, 1] != 0)]
            slot[open_] = (slot[open_] + 1) & (len(self.rows) - 1)
        return out

    def put(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Keep the places of keys, which are distinct and new."""
        if 2 * (self.used + len(low)) > len(self.rows):
            old = self.rows[self.rows[:, 1] != 0]
            self.__init__(max(12, (2 * (self.used + len(low))).bit_length()))
            self.put(old[:, 0], old[:, 1], old[:, 2])
        slot, open_ = self._slots(low, high), np.arange(len(low))
        while len(open_):
            free = open_[self.rows[slot[open_], 1] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]  # of those with one slot, one
            self.rows[slot[free]] = np.stack((low[free], high[free], place[free].astype(np.uint64)), axis=1)
            left = np.ones(len(low), bool)
            left[free] = False
            open_ = open_[left[open_]]
            slot[open_] = (slot[open_] + 1) & (len(self.rows) - 1)
        self.used += len(low)


class PieceEncoder:
    """The ids of pieces seen so far, and the tokenizer for others."""

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        kind = json.loads(self.tokenizer.to_str())
        added = [t for t in kind["added_tokens"] if not (plain and t["special"])]
        if kind["normalizer"] or kind["pre_tokenizer"] != BYTE_LEVEL or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        # The library looks for the first of the tokens' strings, and of those at one place for the longest.
        names = sorted((t["content"].encode() for t in added if t["content"]), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, names))) if names else None
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self._begin()

    def _begin(self) -> None:
        self.pairs = PairTable()  # of pieces of up to PAIR bytes: the first eight, the others and the length
        self.long: dict[bytes, int] = {}  # place of a longer piece
        self.places = 0
        self.start = np.zeros(1 << 12, np.int64)  # of the ids of the piece at a place
        self.count = np.zeros(1 << 12, np.int32)
        self.seen = np.zeros(1 << 12, np.int32)  # blocks that had it, halved each time that others are forgotten
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        """Keep the pieces that most blocks had, half of KEPT and KEPT_IDS at most."""
        n = self.places
        order = np.argsort(-self.seen[:n], kind="stable")[: KEPT // 2]
        keep = order[np.cumsum(self.count[order], dtype=np.int64) <= KEPT_IDS // 2]
        count, seen = self.count[keep].astype(np.int64), self.seen[keep] // 2
        ends = np.cumsum(count)
        ids = self.ids[_spans(self.start[keep], count)]
        now = np.full(n, -1)
        now[keep] = np.arange(len(keep))
        pairs = self.pairs.rows[self.pairs.rows[:, 1] != 0]
        pairs = pairs[now[pairs[:, 2].astype(np.int64)] >= 0]
        long = {p: int(now[k]) for p, k in self.long.items() if now[k] >= 0}
        self._begin()
        self._room(len(keep), len(ids))
        self.pairs.put(pairs[:, 0], pairs[:, 1], now[pairs[:, 2].astype(np.int64)])
        self.long, self.places, self.used = long, len(keep), len(ids)
        self.seen[: len(keep)], self.count[: len(keep)], self.start[: len(keep)], self.ids[: len(ids)] = seen, count, ends - count, ids

    def _room(self, pieces: int, ids: int) -> None:
        while pieces > len(self.start):
            for name in ("start", "count", "seen"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate((held, np.zeros_like(held))))
        while ids > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))

    def _learn(self, data: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The places that the pieces from first to last, none of them known, get from now on."""
        n = last - first
        other = np.concatenate(([0], np.cumsum(kind != LETTER)))
        words = (data[first] == 0x20) & (n > 1) & (other[last] == other[np.minimum(first + 1, last)])
        order = np.concatenate((np.flatnonzero(words), np.flatnonzero(~words)))
        many = int(words.sum())
        ids, sizes = [], []
        for at in range(0, many, JOINED):
            some = order[at : min(at + JOINED, many)]
            flat, count = self._of_words(data[_spans(first[some], n[some])].tobytes().decode())
            if len(count) != len(some):
                raise ValueError("the tokenizer doesn't part words at spaces")
            ids.append(flat)
            sizes.append(count)
        text = data.tobytes() if many < len(order) else b""
        for at in range(many, len(order), JOINED):
            some = order[at : at + JOINED]
            found = [x.ids for x in self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        flat, count = np.concatenate(ids), np.concatenate(sizes)
        at, end = self.places, self.used + len(flat)
        self._room(at + len(order), end)
        self.count[at : at + len(order)] = count
        self.start[at : at + len(order)] = self.used + np.cumsum(count) - count
        self.ids[self.used : end] = flat
        self.used, self.places = end, at + len(order)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(at, self.places)
        return place

    def _of_words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words that each are a space and letters: a word begins where a token begins with a space."""
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, np.uint32)
        return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))

    def _own(self, block: TextBlock, data: bytes) -> list[tuple[int, int]]:
        """Bounds of the strings of the tokenizer's own tokens that a text has whole."""
        if self.own is None or self.own.search(data) is None:
            return []
        bounds = block.text_at.tolist()
        return [(a + m.start(), a + m.end()) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self.own.finditer(data[a:b])]

    def _places(self, block: TextBlock, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of each piece, by its bytes; pieces that have none get one."""
        n = last - first
        out = np.full(len(first), -1)
        short = np.flatnonzero(n <= PAIR)
        low = block.eight(first[short], n[short])
        high = block.eight(first[short] + 8, n[short] - 8) | n[short].astype(np.uint64) << np.uint64(56)
        out[short] = self.pairs.get(low, high)
        others = np.flatnonzero(out < 0)
        some, which = block.same(first[others], last[others])
        some = others[some]
        found, long = out[some], np.flatnonzero(n[some] > PAIR)
        names = [block.data[a:b].tobytes() for a, b in zip(first[some[long]].tolist(), last[some[long]].tolist(), strict=True)]
        found[long] = [self.long.get(p, -1) for p in names]
        if len(new := np.flatnonzero(found < 0)):
            found[new] = self._learn(block.data, kind, first[some[new]], last[some[new]])
            self.long.update(zip(names, found[long].tolist(), strict=True))
            new = new[n[some[new]] <= PAIR]
            at = np.searchsorted(short, some[new])
            self.pairs.put(low[at], high[at], found[new])
        out[others] = found[which]
        return out

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's ids)."""
        if self.places > KEPT or self.used > KEPT_IDS:
            self._forget()
        kind = kinds(block.data)
        first = cuts(block, self._own(block, block.data.tobytes()), kind)
        at = self._places(block, kind, first, np.append(first[1:], len(block.data)))
        self.seen[at] += 1
        count = self.count[at].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(count)))
        return self.ids[_spans(self.start[at], count)], ends[np.searchsorted(first, block.text_at)]


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n places from each start on, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    held = store.worker_cache("encoders")
    if (path, plain) not in held:
        held[path, plain] = PieceEncoder(path, plain)
    return held[path, plain]
