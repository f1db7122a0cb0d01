"""Scores of answers from question, truth and answer: embeddings, lexical match, length, and the correction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions import embed, vectors

from . import correct, score
from .correct import DetectorConfig

TEXTS = ["question", "ground_truth", "miner_answer"]


def rank_answers(rows: DataFrame, embedding: Callable[[str], Column] = embed.projection_embedding, cfg: DetectorConfig | None = DetectorConfig()) -> DataFrame:
    """rows with signals: relevance, correctness, lexical, length and the corrected composite, float32 each.

    Vectors that rows have already (question_vec, ground_truth_vec, miner_answer_vec) are taken as they are; other texts
    are embedded, each distinct one once. Without cfg nothing is corrected.
    """
    rows = score.with_embeddings(rows, [c for c in TEXTS if f"{c}_vec" not in rows.columns], embedding)
    fixed = correct.analyse(F.col("ground_truth"), F.col("miner_answer"), cfg)["total"].cast("double") if cfg else F.lit(0.0)
    relevance = vectors.cosine(F.col("question_vec"), F.col("miner_answer_vec"))
    correctness = vectors.cosine(F.col("ground_truth_vec"), F.col("miner_answer_vec"))
    signals = score.breakdown(relevance, correctness, F.col("ground_truth"), F.col("miner_answer"), fixed)
    return rows.withColumn("signals", signals).drop(*[f"{c}_vec" for c in TEXTS])


def score_rounds(rows: DataFrame, embedding: Callable[[str], Column] = embed.projection_embedding, cfg: DetectorConfig | None = DetectorConfig()) -> DataFrame:
    """id, score, error of each round."""
    found = rank_answers(rows.select("id", *[c for c in ("pos",) if c in rows.columns], *TEXTS), embedding, cfg)
    value = F.col("signals.composite").cast("double")
    bad = value.isNull() | F.isnan(value)
    return found.select("id", *[c for c in ("pos",) if c in rows.columns], F.when(~bad, value).alias("score"), F.when(bad, F.lit("the score isn't a number")).alias("error"))


def score_missing(rows: DataFrame, table, scorer: Callable[[DataFrame], DataFrame], model_hash: str) -> DataFrame:
    """The scores of a scorer for rows: those in the table, and for rows that it lacks new ones, which are added to it."""
    table.append(scorer(table.missing(rows, model_hash)), model_hash)
    return table.read(model_hash).join(rows.select("id").distinct(), "id", "left_semi")
