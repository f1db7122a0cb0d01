"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - weights . features): one vector of weights for all grades, and ordered
thresholds. The features are hashed: words, the last three bytes of words, words that repeat the one before, each as
the root of its share of the words, and the length in powers of two.

The model is fitted on the driver, on a sample by hash of the rated documents of at most PER_GRADE for each grade,
weighted to the grades' shares among all rated ones. Scoring reads all documents, whole, where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .text_block import TextBlock, blocks, mixed

BITS, TAIL, LENGTH = 18, 3, 0.3
#: Rated documents of each grade that the model is fitted on at most, and the steps and rate of the fit.
PER_GRADE, STEPS, RATE, RIDGE = 2000, 300, 1.0, 1e-6
#: The least distance between thresholds.
GAP = 0.1


def features(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each feature that isn't 0, by text."""
    size = np.uint64((1 << BITS) - 1)
    tails = mixed(mixed(block.keys(np.maximum(block.first, block.last - TAIL), block.last)) + np.uint64(TAIL))
    again = np.flatnonzero((block.hash[1:] == block.hash[:-1]) & (block.text[1:] == block.text[:-1])) + 1
    size_of = block.last - block.first
    again = again[(size_of[again] == size_of[again - 1]) & block.equal(block.first[again], block.first[again - 1], size_of[again])]
    text = np.concatenate((block.text, block.text, block.text[again]))
    bucket = np.concatenate((block.hash & size, tails & size, np.zeros(len(again), np.uint64))).astype(np.int64)
    key, count = np.unique((text << BITS) | bucket, return_counts=True)
    at = key >> BITS
    value = np.sqrt(count / np.maximum(block.words, 1)[at])
    long = np.minimum(np.log2(1 + block.words).astype(np.int64), 20) + 1
    every = np.arange(block.n)
    text = np.concatenate((at, every))
    order = np.argsort(text, kind="stable")
    bucket = np.concatenate((key & ((1 << BITS) - 1), mixed(long.astype(np.uint64)).astype(np.int64) & ((1 << BITS) - 1)))
    return text[order], bucket[order], np.concatenate((value, np.full(block.n, LENGTH)))[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than there are grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each score."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int) -> Model:
    """The model that the steps lead to; the same for the same input."""
    n, many = len(grade), 1 << BITS
    w, cuts = np.zeros(many), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    seen_w, seen_c = np.full(many, 1e-8), np.full(grades - 1, 1e-8)
    here = np.arange(n)
    for _ in range(STEPS):
        score = np.bincount(row, value * w[bucket], n)
        below = np.vstack([np.zeros(n), sigmoid(cuts[:, None] - score), np.ones(n)])  # P(grade < k) at row k
        slope = below * (1 - below)
        p = np.maximum(below[grade + 1, here] - below[grade, here], 1e-9)
        by_score = (slope[grade + 1, here] - slope[grade, here]) / p * weight
        step = np.bincount(bucket, value * by_score[row], many) + RIDGE * w
        by_cut = np.array([-(weight * ((grade == k).astype(float) - (grade == k + 1)) * slope[k + 1] / p).sum() for k in range(grades - 1)])
        seen_w += step * step
        seen_c += by_cut * by_cut
        w -= RATE * step / np.sqrt(seen_w)
        cuts = np.maximum.accumulate(cuts - RATE * by_cut / np.sqrt(seen_c) - GAP * np.arange(grades - 1)) + GAP * np.arange(grades - 1)
    return Model(w.astype(np.float32), cuts)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, values = [], []
        for _, _, block in blocks(batch.column(1)):
            text, bucket, value = features(block)
            at = np.searchsorted(text, np.arange(block.n + 1))
            for a, b in zip(at[:-1], at[1:], strict=True):
                buckets.append(bucket[a:b].astype(np.int32).tobytes())
                values.append(value[a:b].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.binary()), pa.array(values, pa.binary()), batch.column(2)], names=["doc_id", "buckets", "values", "grade"])


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model | None:
    """The model for ratings (id_col, grade_col: 0 to grades - 1); None if fewer than two grades are rated.

    Ratings with a null, or of documents that aren't there, are left out.
    """
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null").where(F.col("grade").between(0, grades - 1))
    share = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    # The smallest hashes of a grade: a sample of bounded size, the same in each run.
    some = None
    for g in sorted(share):
        # Few more than that many by the count of the grade, so no task sorts more; if these are too few (an id that repeats), all are sorted.
        of_grade = rated.where(F.col("grade") == g).select("id", "grade", F.xxhash64("id").alias("h"))
        few = of_grade.where(F.col("h") <= F.lit(min(2**63 - 1, int(min(1.0, (2 * PER_GRADE + 1000) / share[g]) * 2**64) - 2**63)))
        part = (few if share[g] <= PER_GRADE or few.count() >= PER_GRADE else of_grade).orderBy("h", "id").limit(PER_GRADE).drop("h")
        some = part if some is None else some.unionByName(part)
    rows = docs.select(store.col(id_col).alias("id"), store.col(text_col).alias("text"))
    chosen = rows.join(F.broadcast(some.dropDuplicates(["id"])), "id").select("id", "text", "grade")
    kind = chosen.schema["id"].dataType.simpleString()
    found = chosen.mapInArrow(_featured, f"doc_id {kind}, buckets binary, values binary, grade int").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.buckets)))
    grade = np.array([r.grade for r in found], np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    buckets = [np.frombuffer(r.buckets, np.int32) for r in found]
    row = np.repeat(np.arange(len(found)), [len(b) for b in buckets])
    value = np.concatenate([np.frombuffer(r["values"], np.float32) for r in found]).astype(np.float64)
    count = np.bincount(grade, minlength=grades)
    total = sum(share.get(g, 0) for g in range(grades) if count[g])
    weight = np.array([share.get(g, 0) / total / max(1, count[g]) for g in range(grades)])[grade]
    return fit(row, np.concatenate(buckets).astype(np.int64), value, grade, weight, grades)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, block in blocks(batch.column(1)):
                text, bucket, value = features(block)
                found.append(block.per_text(text, value * model.weights[bucket]))
            if found:
                tails = model.tails(np.concatenate(found))
                columns = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "expected_grade", "tail_prob"])

    return run


def score_documents(docs: DataFrame, model: Model | None, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, expected_grade, tail_prob (of the highest grade), kept (tail_prob is at least cut) for each row of docs.

    Null text counts as empty; it is scored by its length. Without a model the two numbers are null and all rows are
    kept. Repeated rows get the same numbers. An empty table gives an empty result.
    """
    rows = docs.select(store.col(id_col).alias("doc_id"), store.col(text_col).alias("text"))
    if model is None:
        nothing = F.lit(None).cast("double")
        return rows.select(F.col("doc_id").alias(id_col), nothing.alias("expected_grade"), nothing.alias("tail_prob"), F.lit(True).alias("kept"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_scored(model), f"doc_id {kind}, expected_grade double, tail_prob double")
    return found.select(F.col("doc_id").alias(id_col), "expected_grade", "tail_prob", (F.col("tail_prob") >= cut).alias("kept"))


def select_documents(docs: DataFrame, model: Model | None, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns as they were; nothing is shuffled."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, block in blocks(batch.column(at)):
                text, bucket, value = features(block)
                found.append(block.per_text(text, value * model.weights[bucket]))
            if found:
                kept = model.tails(np.concatenate(found))[:, -1] >= cut
                yield batch.filter(pa.array(kept))

    at, plain = docs.columns.index(text_col), store.numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels of quality and toxicity: 0 poor, 1 good but toxic, 2 good. A null label gives a null."""
    good = F.when(F.col("toxic") == 0, 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, good).alias("grade"))
