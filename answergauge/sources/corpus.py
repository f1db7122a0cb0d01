"""Reading and writing corpora of scored rounds, registries, and tables of scores."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergauge import schema

_ZERO = {T.StringType(): "", T.LongType(): 0, T.DoubleType(): 0.0}


def _whole(rows: DataFrame) -> DataFrame:
    """Absent fields of a round as zero values."""
    return rows.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(_ZERO[f.dataType])) for f in schema.ROUND})


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Rounds of one JSON document {"scores": [...]}, with pos, their order. A corpus without rounds is an error."""
    pages = spark.read.schema(schema.ENVELOPE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = _whole(pages.select(F.posexplode("scores").alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), "r.*"))
    if rows.isEmpty():
        raise ValueError(f"{path} has no rounds")
    return rows


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rounds of page documents (a file each, or a line each), in order of their offsets, each id that isn't empty once."""
    pages = spark.read.schema(schema.ENVELOPE).option("multiLine", not lines).json(path)
    rows = pages.select("offset", F.posexplode("scores").alias("at", "r"))
    return dedup_first(_whole(rows.select((F.coalesce("offset", F.lit(0)) + F.col("at")).alias("pos"), "r.*")))


def write_corpus(rows: DataFrame, path: str, order: str = "pos") -> None:
    """Rounds as one JSON document of the form that read_corpus reads: for corpora that one task can hold."""
    _documents(rows.withColumn("page__", F.lit(0)), order).coalesce(1).write.mode("overwrite").json(path)


def write_pages(rows: DataFrame, path: str, page: int = 500) -> None:
    """Rounds as page documents, a line for each page of pos: any size; read_pages(lines=True) reads them."""
    _documents(rows.withColumn("page__", F.floor(F.col("pos") / page)), "pos").write.mode("overwrite").json(path)


def _documents(rows: DataFrame, order: str) -> DataFrame:
    fields = F.struct(*[F.col(f.name) for f in schema.ROUND])
    one = rows.groupBy("page__").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), fields.alias("r")))).alias("all"), F.count("*").alias("total"), F.min(order).alias("offset"))
    return one.select(F.transform("all", lambda x: x["r"]).alias("scores"), "total", F.col("total").alias("limit"), F.col("offset").cast("long").alias("offset"))


def dedup_first(rows: DataFrame, id_col: str = "id", order: str = "pos") -> DataFrame:
    """The first row of each id in the given order, and all rows whose id is empty.

    Rows without an id need no window: they don't gather in a task.
    """
    named = rows.where(F.col(id_col) != "")
    first = named.withColumn("nth__", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).where("nth__ = 1").drop("nth__")
    return first.unionByName(rows.where((F.col(id_col) == "") | F.col(id_col).isNull()))


def last_by_id(rows: DataFrame, id_col: str = "id", order: str = "pos") -> DataFrame:
    """One row per id, the last in order: what a lookup by id finds when ids repeat."""
    fields = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*fields), order).alias("r")).select(id_col, "r.*")


def latest(scores: DataFrame) -> DataFrame:
    """id, score: the last score of each id, by seq or pos where there is such a column, else as the rows come. Rows without a score don't count."""
    order = next((c for c in ("seq", "pos") if c in scores.columns), None)
    rows = scores.where("score is not null").select("id", "score", (F.col(order) if order else F.monotonically_increasing_id()).alias("seq"))
    return rows.groupBy("id").agg(F.max_by("score", "seq").alias("score"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All registrations of a registry document (a list, or an object with the list under registrations)."""
    rows = spark.read.schema(schema.REGISTRY).option("multiLine", True).json(path)
    return rows.where("RegistrationID is not null")


class ScoreTable:
    """Scores by scorer, in Parquet partitioned by model_hash; what is scored, or failed, isn't scored again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, model_hash: str) -> DataFrame:
        """id, score, error of one scorer; one row per id: the last score, else the last error."""
        try:
            rows = self.spark.read.schema(schema.SCORES).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], schema.SCORES)
        mine = rows.where(F.col("model_hash") == model_hash)
        order = F.struct(F.coalesce("batch", F.lit(0)).alias("batch"), F.coalesce("seq", F.lit(0)).alias("seq"))
        last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("score", "error")}
        return mine.groupBy("id").agg(*last.values()).withColumn("error", F.when(F.col("score").isNull(), F.col("error")))

    def missing(self, rows: DataFrame, model_hash: str) -> DataFrame:
        """Rows that the scorer hasn't seen."""
        return rows.join(self.read(model_hash).select("id"), "id", "left_anti")

    def append(self, scored: DataFrame, model_hash: str) -> None:
        """Add id, score, error; of an id that is there the new score counts. Of an id that repeats in scored, the last row by seq or pos, if it has one."""
        order = next((c for c in ("seq", "pos") if c in scored.columns), None)
        seq = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        rows = scored.select(F.lit(model_hash).alias("model_hash"), "id", F.col("score").cast("double"), F.col("error").cast("string"), F.lit(time.time_ns()).alias("batch"), seq.alias("seq"))
        rows.write.mode("append").partitionBy("model_hash").parquet(self.path)
