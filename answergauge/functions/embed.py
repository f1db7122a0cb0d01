"""Token ids and embeddings of texts: a fixed random projection, or a transformer with weights that the user has."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of special tokens, lengths, and the constants of the two hashes.
CLS, SEP, PAD, UNK, LENGTH, VOCABULARY, WIDTH, COLUMNS = 101, 102, 0, 100, 128, 30522, 384, 512
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
SEED, LCG_MUL, LCG_ADD = 0xDEADBEEFCAFE1337, 6364136223846793005, 1442695040888963407
LONGEST_WORD, LONGEST_PIECE = 200, 48
MASK = (1 << 64) - 1
#: Letters (all alphabetic characters, vowel signs too) and digits, as in the text functions.
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, A-Z lower-cased."""
    fold = {c: c + 32 for c in range(65, 91)}
    return [w.translate(fold) for w in _WORD.findall(text)]


def hashed_id(word: str) -> int:
    """The token id of a word by FNV-1a, above those of special tokens."""
    h = FNV_START
    for b in word.encode():
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h % (VOCABULARY - 103) + 103


def vocabulary(lines: list[str]) -> dict[str, int]:
    """Pieces and their ids, from lines in order of the ids; a piece is cut at LONGEST_PIECE bytes, the first one stays."""
    out: dict[str, int] = {}
    for i, line in enumerate(lines):
        out.setdefault(line.rstrip("\n").encode()[:LONGEST_PIECE].decode("utf-8", "ignore"), i)
    return out


def wordpiece(vocabulary: dict[str, int]) -> Callable[[str], list[int]]:
    """Ids of the longest pieces of a word, from its start; [UNK] for a word with a part that no piece covers."""

    def ids(word: str) -> list[int]:
        if len(word) > LONGEST_WORD:
            return [UNK]
        out, at = [], 0
        while at < len(word):
            for to in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:to]
                if len(piece.encode()) <= LONGEST_PIECE and piece in vocabulary:
                    out.append(vocabulary[piece])
                    at = to
                    break
            else:
                return [UNK]
        return out

    return ids


def token_ids(text: str, word_ids: Callable[[str], list[int]] = lambda w: [hashed_id(w)]) -> list[int]:
    """[CLS], the ids of the words as far as they fit, [SEP]; LENGTH at most, without padding."""
    out = [CLS]
    for w in words(text):
        for i in word_ids(w):
            if len(out) >= LENGTH - 1:
                return [*out, SEP]
            out.append(i)
    return [*out, SEP]


@lru_cache(1)
def _projection() -> np.ndarray:
    """A row for each id modulo COLUMNS, of WIDTH numbers in [-1, 1)."""
    d = np.arange(WIDTH, dtype=np.uint64)[None, :] << np.uint64(32)
    c = np.arange(COLUMNS, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        x = (np.uint64(SEED) ^ d ^ c) * np.uint64(LCG_MUL) + np.uint64(LCG_ADD)
    bits = (x >> np.uint64(40)).astype(np.uint32) | np.uint32(0x3F800000)
    return (bits.view(np.float32) - np.float32(1.5)) * np.float32(2.0)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.float32(np.sqrt(np.add.accumulate(v * v, dtype=np.float32)[-1]))
    return v / n if n > 0 else v


def project(text: str) -> np.ndarray:
    """The embedding of a text by the fixed projection, each token weighing less than the one before."""
    total = np.zeros(WIDTH, np.float32)
    for i, t in enumerate(token_ids(text)):
        total = total + _projection()[t % COLUMNS] / np.float32(i + 1)
    return unit(total)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def projection_embedding(texts: pd.Series) -> pd.Series:
    """The projection of each text; equal texts of a batch are projected once."""
    return texts.fillna("").map({t: project(t) for t in set(texts.fillna(""))})


class Transformer:
    """A six-layer encoder over weights in the user's hands, mean-pooled to a unit vector.

    weights: a mapping of arrays: word, position, type (embeddings), norm_g, norm_b, and for layer k: q, k, v, o, up, down
    (inputs by outputs) with their biases (qb, ...), n1g, n1b, n2g, n2b; names are prefixed "k.". Nothing is bundled.
    """

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: dict[str, int], layers: int = 6, heads: int = 12):
        self.w, self.layers, self.heads = weights, layers, heads
        self.word_ids = wordpiece(vocabulary)

    def _norm(self, x: np.ndarray, g: str, b: str) -> np.ndarray:
        x = x - x.mean(axis=1, keepdims=True)
        return x / np.sqrt((x * x).mean(axis=1, keepdims=True) + np.float32(1e-12)) * self.w[g] + self.w[b]

    def embed(self, text: str) -> np.ndarray:
        ids, w = token_ids(text, self.word_ids), self.w
        x = self._norm(w["word"][ids] + w["position"][: len(ids)] + w["type"][0], "norm_g", "norm_b")
        n, width = x.shape
        for k in map(str, range(self.layers)):
            q, key, v = (((x @ w[f"{k}.{m}"]) + w[f"{k}.{m}b"]).reshape(n, self.heads, -1).transpose(1, 0, 2) for m in "qkv")
            a = q @ key.transpose(0, 2, 1) / np.float32(np.sqrt(width // self.heads))
            a = np.exp(a - a.max(axis=2, keepdims=True))
            mixed = ((a / a.sum(axis=2, keepdims=True)) @ v).transpose(1, 0, 2).reshape(n, width)
            x = self._norm(x + mixed @ w[f"{k}.o"] + w[f"{k}.ob"], f"{k}.n1g", f"{k}.n1b")
            h = x @ w[f"{k}.up"] + w[f"{k}.upb"]
            h = 0.5 * h * (1 + np.tanh(np.float32(0.7978845608) * (h + np.float32(0.044715) * h**3)))
            x = self._norm(x + h @ w[f"{k}.down"] + w[f"{k}.downb"], f"{k}.n2g", f"{k}.n2b")
        return unit(x.mean(axis=0).astype(np.float32))


def read_weights(blob: bytes) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Weights and sizes from a blob: "MLM2", six sizes, INT8 tables each behind a scale, biases and norms in float32.

    Tables of a layer are stored outputs by inputs.
    """
    if blob[:4] != b"MLM2":
        raise ValueError("the weights don't begin with MLM2")
    sizes = dict(zip(("layers", "width", "heads", "inner", "vocabulary", "positions"), np.frombuffer(blob, "<u4", 6, 4).tolist(), strict=True))
    at, width, inner = 28, sizes["width"], sizes["inner"]

    def floats(n: int) -> np.ndarray:
        nonlocal at
        at += 4 * n
        return np.frombuffer(blob, "<f4", n, at - 4 * n)

    def table(rows: int, columns: int) -> np.ndarray:
        nonlocal at
        scale = floats(1)[0]
        at += rows * columns
        return np.frombuffer(blob, np.int8, rows * columns, at - rows * columns).reshape(rows, columns).astype(np.float32) * scale

    out = {"word": table(sizes["vocabulary"], width), "position": table(sizes["positions"], width), "type": table(1, width), "norm_g": floats(width), "norm_b": floats(width)}
    for k in range(sizes["layers"]):
        for name, to, of in (("q", width, width), ("k", width, width), ("v", width, width), ("o", width, width), ("n1", 0, 0), ("up", inner, width), ("down", width, inner), ("n2", 0, 0)):
            if to:
                out[f"{k}.{name}"], out[f"{k}.{name}b"] = table(to, of).T, floats(to)
            else:
                out[f"{k}.{name}g"], out[f"{k}.{name}b"] = floats(width), floats(width)
    return out, sizes
