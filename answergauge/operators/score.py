"""Scores of answers: lexical match, length, the weighted composite, and the protocol of a scorer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.functions import text, vectors

#: Saturation and length weight of the lexical match, weights of the composite.
K1, LENGTH_WEIGHT = 1.5, 0.75
RELEVANCE, CORRECTNESS, LEXICAL, LENGTH = 0.25, 0.50, 0.15, 0.10


def bm25(query: Column, doc: Column) -> Column:
    """Lexical match of two texts in [0, 1]: a term of the query counts as often as it stands there; 0 for an empty side.

    The tokens of both are made once: within a lambda an expression is evaluated anew for each element.
    """
    both = F.struct(text.tokens(query).alias("q"), text.tokens(doc).alias("d"))
    return F.get(F.transform(F.array(both), lambda s: bm25_of_tokens(s["q"], s["d"])), F.lit(0))


def bm25_of_tokens(q: Column, d: Column) -> Column:
    nq, nd = F.size(q).cast("double"), F.size(d).cast("double")
    base = K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * nd / ((nq + nd) / 2))
    asked = F.array_distinct(q)

    # For each distinct term of the query: how often there, and in the document.
    def part(t: Column) -> Column:
        tf = F.size(F.filter(d, lambda x: x == t)).cast("double")
        return F.size(F.filter(q, lambda x: x == t)) * tf * (K1 + 1) / (tf + base)

    raw = F.aggregate(asked, F.lit(0.0), lambda s, t: s + part(t))
    return F.when((nq > 0) & (nd > 0), vectors.clamp01(raw / ((K1 + 1) * nq))).otherwise(F.lit(0.0))


def length_quality(answer: Column) -> Column:
    return vectors.sigmoid((text.byte_length(answer).cast("double") - 50) / 20)


def composite(relevance: Column, correctness: Column, lexical: Column, length: Column) -> Column:
    return vectors.clamp01(RELEVANCE * relevance + CORRECTNESS * correctness + LEXICAL * lexical + LENGTH * length)


def breakdown(relevance: Column, correctness: Column, truth: Column, answer: Column, correction: Column) -> Column:
    """The five signals of an answer; composite is the corrected score. A blank answer has 0 throughout."""
    lexical, length = bm25(truth, answer), length_quality(answer)
    whole = vectors.clamp01(composite(relevance, correctness, lexical, length) + correction)
    blank = text.is_blank_unicode(answer)
    signals = {"relevance": relevance, "correctness": correctness, "lexical": lexical, "length": length, "composite": whole}
    return F.struct(*[F.when(blank, F.lit(0.0)).otherwise(v).cast("float").alias(k) for k, v in signals.items()])


@dataclass(frozen=True)
class Scorer:
    """A scorer: its name, a hash of what it does, and a function from (question, truth, answer) columns to a score.

    The function's column is the score, or a struct of score and error (as by_row() makes). A row whose score fails, or
    isn't a number, has an error and no score; other rows aren't touched. An expression that raises in the JVM ends the job; what
    may raise goes through by_row().
    """

    name: str
    model_hash: str
    score: Callable[[Column, Column, Column], Column]

    def apply(self, rows: DataFrame) -> DataFrame:
        given = rows.withColumn("given__", self.score(F.col("question"), F.col("ground_truth"), F.col("miner_answer")))
        parted = given.schema["given__"].dataType.typeName() == "struct"
        s, error = (F.col("given__.score"), F.col("given__.error")) if parted else (F.col("given__"), F.lit(None))
        scored = given.withColumn("score__", F.when(text.is_blank_unicode(F.col("miner_answer")), F.lit(0.0)).otherwise(s.cast("double")))
        bad = F.col("score__").isNull() | F.isnan("score__")
        return scored.select("id", F.when(~bad, F.col("score__")).alias("score"), F.when(bad, F.coalesce(error.cast("string"), F.lit("the score isn't a number"))).alias("error"))


def by_row(score: Callable[[str, str, str], float]) -> Callable[[Column, Column, Column], Column]:
    """For Scorer: a Python function of (question, truth, answer) texts; what it raises is that row's error."""

    @F.pandas_udf("score double, error string")
    def run(questions: pd.Series, truths: pd.Series, answers: pd.Series) -> pd.DataFrame:
        out = []
        for texts in zip(questions, truths, answers, strict=True):
            try:
                out.append((float(score(*(t or "" for t in texts))), None))
            except Exception as e:  # whatever the scorer raises, the other rows go on
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["score", "error"])

    return run


#: Lexical match with the truth, and length: needs no weights.
LEXICAL_SCORER = Scorer("lexical", "lexical-1", lambda q, t, a: composite(bm25(q, a), bm25(t, a), bm25(t, a), length_quality(a)))


def with_embeddings(rows: DataFrame, columns: list[str], embed) -> DataFrame:
    """rows with a vector for each text column (name_vec); each distinct text is embedded once.

    Empty texts, which can be a large part of the answers, don't go through the join: their vector is one row.
    """
    if not columns:
        return rows
    texts = None
    for c in columns:
        part = rows.select(F.coalesce(F.col(c), F.lit("")).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    known = texts.where("text <> ''").distinct().withColumn("vec", embed("text"))
    empty = rows.sparkSession.createDataFrame([("",)], "text string").withColumn("vec", embed("text"))
    for c in columns:
        is_empty = F.coalesce(F.col(c), F.lit("")) == ""
        full = rows.where(~is_empty).join(known.select(F.col("text").alias(f"{c}__"), F.col("vec").alias(f"{c}_vec")), F.col(c) == F.col(f"{c}__")).drop(f"{c}__")
        rows = full.unionByName(rows.where(is_empty).join(F.broadcast(empty.select(F.col("vec").alias(f"{c}_vec")))))  # one row
    return rows
