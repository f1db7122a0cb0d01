"""Quality rules: word and line counts, and a likelihood ratio between a trusted corpus and the raw one.

Words and pairs of words of each document are hashed to 2**BITS buckets. The raw corpus is all documents; the trusted one
is all documents with a good label, whose texts are joined by shuffle. Each corpus is a multinomial over the buckets; counts of the trusted one are scaled to the size of the raw one before
SMOOTH is added to both, so the ratio doesn't lean to either at any size. A document's score is
the mean over its words and pairs of the log ratio of the two; it is kept if the score is at least THRESHOLD, a fixed
number, so each document's verdict follows from the counts alone.

Counts of all documents come to the driver as one row per bucket, 2**BITS at most. Texts of trusted documents are found by
a join on the id; before it, a bitmap of 2**MAP_BITS bits over hashes of the trusted ids (8 MB, whatever their number) leaves out
most others without moving them. Beyond some 10**8 trusted ids the bitmap fills up, and all texts move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .text_block import TextBlock, blocks

BITS, SMOOTH, THRESHOLD, MAP_BITS = 18, 1.0, -0.2, 26
#: Fixed values of the base rules: symbols, fewest words, most percent of words in repeated windows, their width.
SYMBOLS, LEAST_WORDS, MOST_REPEATED, WIDTH = "[#*$%&|<>]", 50, 50, 3


def _grams(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each word and each pair of words."""
    found = [block.windows(w) for w in (1, 2)]
    text = np.concatenate([block.text[at] for at, _ in found])
    return text, (np.concatenate([h for _, h in found]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, block in blocks(batch.column(0)):
            total += np.bincount(_grams(block)[1], minlength=1 << BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def _counts(rows: DataFrame) -> np.ndarray:
    """Words and pairs of the texts of rows in each bucket."""
    found = rows.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    out[found["bucket"]] = found["n"]
    return out


def _maybe(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id's hash has its bit in the bitmap of the ids: all whose id is there, and some others."""
    bit = lambda: F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS))
    maps = ids.groupBy(F.bitmap_bucket_number(bit()).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit())).alias("bits"))
    at = F.bitmap_bit_position(bit())
    here = rows.withColumns({"part": F.bitmap_bucket_number(bit()), "at": at}).join(F.broadcast(maps), "part")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return here.where(F.floor(byte / F.pow(F.lit(2), F.pmod("at", F.lit(8)))) % 2 == 1).select(*rows.columns)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """For each bucket, log of its share in the trusted documents over its share in all. trusted: ids, a column."""
    rows = docs.select(store.col(id_col).alias("id"), store.col(text_col).alias("text"))
    ids = store.cut(trusted.select(store.col(trusted.columns[0]).cast(rows.schema["id"].dataType).alias("id")).where("id is not null").distinct())
    named = _maybe(rows.where("id is not null"), ids)
    times = store.cut(named.groupBy("id").agg(F.count("*").alias("n")).join(ids.hint("merge"), "id"))
    raw, good = _counts(rows), _counts(store.lookup(named, times, "id", "n", rows.count()))
    if not good.sum():  # nothing is trusted: the two are one corpus
        good = raw
    scale = raw.sum() / good.sum() if good.sum() else 1.0
    return (np.log(good * scale + SMOOTH) - np.log(raw + SMOOTH)).astype(np.float32)


def _lines(block: TextBlock) -> np.ndarray:
    """For each text, lines with a word that equal an earlier line."""
    ends = np.flatnonzero(block.data == 0x0A)
    first = np.concatenate((block.text_at[:-1], ends + 1))
    last = np.concatenate((block.text_at[1:], ends))
    text = np.concatenate((np.arange(block.n), np.searchsorted(block.text_at, ends, "right") - 1))
    order = np.lexsort((first, text))
    first, text = first[order], text[order]
    # A line ends where the next line of its text begins, less the line feed, or with the text.
    last = np.where(np.concatenate((text[1:] == text[:-1], [False])), np.concatenate((first[1:], [0])) - 1, block.text_at[1:][text])
    inner = np.concatenate(([0], np.cumsum(~block.white)))
    real = inner[last] > inner[first]
    first, last, text = first[real], last[real], text[real]
    _, line = block.same(first, last)
    _, at = np.unique(line * block.n + text, return_index=True)
    return block.per_text(text) - block.per_text(text[at])


def _repeated(block: TextBlock) -> np.ndarray:
    """For each text, words in windows that it has twice or more."""
    at = block.followed(WIDTH)
    kind, times = block.text[at], np.zeros(0, np.int64)
    for k in range(WIDTH):  # numbers for a text and the words of a window, one word after the other
        _, kind, times = np.unique(kind * len(block.first) + block.word_ids[at + k], return_inverse=True, return_counts=True)
    at = at[times[kind] > 1]
    step = np.zeros(len(block.first) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WIDTH, -1)
    return block.per_text(block.text[np.cumsum(step[:-1]) > 0])


def _scored(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = np.zeros(256, bool)
        symbols[[ord(c) for c in SYMBOLS[1:-1]]] = True
        for batch in batches:
            parts = []
            for _, _, block in blocks(batch.column(1)):
                text, bucket = _grams(block)
                n = np.maximum(block.per_text(text), 1)
                parts.append(
                    (
                        block.words,
                        block.count(~block.white & (block.data & 0xC0 != 0x80)),
                        block.count(symbols[block.data]),
                        _lines(block),
                        _repeated(block),
                        block.per_text(text, ratios[bucket].astype(np.float64)) / n,
                    )
                )
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                arrays = [pa.array(c.astype(np.int64)) for c in columns[:5]] + [pa.array(columns[5])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return run


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept for each row.

    Null text counts as empty. A text without words has score 0 and fails the base rules (fewer than LEAST_WORDS
    words, or more than MOST_REPEATED percent of them in windows that come twice). If no document is trusted, all
    scores are 0 and the base rules decide. Repeated rows each get a row and count each. An empty table gives an empty
    result.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col)
    rows = docs.select(store.col(id_col).alias("doc_id"), store.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_scored(ratios), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return found.withColumnRenamed("doc_id", id_col)
