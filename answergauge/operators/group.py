"""Groups of competing rounds: by intent and epoch, or pooled by intent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answergauge.functions import text

#: The epoch of a pooled group.
POOLED = -1


def with_group(rows: DataFrame, pooled: bool) -> DataFrame:
    """rows with the key that they are grouped by: intent_id and epoch (POOLED: one group for each intent)."""
    return rows.withColumn("epoch", F.lit(POOLED).cast("long") if pooled else F.col("epoch_id").cast("long"))


def group_sizes(rows: DataFrame, pooled: bool, least: int = 1) -> DataFrame:
    """intent_id, epoch, n of the groups with that many rows."""
    return with_group(rows, pooled).groupBy("intent_id", "epoch").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def both_grains(rows: DataFrame, least: int = 1) -> DataFrame:
    """The groups of both grains in one pass."""
    keyed = rows.select("intent_id", F.col("epoch_id").cast("long").alias("epoch"))
    sets = keyed.groupingSets([("intent_id", "epoch"), ("intent_id",)], "intent_id", "epoch").agg(F.count("*").alias("n"), F.grouping("epoch").alias("all_epochs"))
    return sets.select("intent_id", F.when(F.col("all_epochs") == 1, POOLED).otherwise(F.col("epoch")).alias("epoch"), "n").where(F.col("n") >= least)


def intents(rows: DataFrame) -> DataFrame:
    return rows.select("intent_id").distinct().orderBy("intent_id")


def summarise(rows: DataFrame) -> DataFrame:
    """One row: rows, intents, epochs (sorted), blank answers, scores of 0."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.countDistinct("intent_id").alias("intents"),
        F.sort_array(F.collect_set("epoch_id")).alias("epochs"),
        F.count_if(text.is_blank(F.col("miner_answer"))).alias("blank_answers"),
        F.count_if(F.col("score") == 0).alias("zero_scores"),
    )


def by_intent(rows: DataFrame, least: int = 4) -> DataFrame:
    """rows, epochs and scores above 0 of each intent with that many rows."""
    found = rows.groupBy("intent_id").agg(F.count("*").alias("rows"), F.countDistinct("epoch_id").alias("epochs"), F.count_if(F.col("score") > 0).alias("nonzero"))
    return found.where(F.col("rows") >= least)


def rankable(rows: DataFrame, pooled: bool = False, least: int = 4) -> DataFrame:
    """intent_id, epoch, n of the groups that a ranking can be told from: not all scores are equal."""
    found = with_group(rows, pooled).groupBy("intent_id", "epoch").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    return found.where((F.col("n") >= max(2, least)) & (F.col("low") != F.col("high"))).select("intent_id", "epoch", "n")


def subset(rows: DataFrame, least: int = 4, per_intent: int = 12, rankable_only: bool = True, since: int = 0) -> DataFrame:
    """Whole groups of rows: the newest so many epochs of each intent (0: all), from the epoch since on."""
    from_since = rows.where(F.col("epoch_id") >= since) if since > 0 else rows
    groups = rankable(from_since, False, least) if rankable_only else group_sizes(from_since, False, least)
    if per_intent > 0:
        newest = Window.partitionBy("intent_id").orderBy(F.desc("epoch"))
        groups = groups.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= per_intent)
    groups = groups.select("intent_id", F.col("epoch").alias("epoch_id"))
    return from_since.join(groups, ["intent_id", "epoch_id"], "left_semi").orderBy("intent_id", "epoch_id", "miner_slug", "id")
