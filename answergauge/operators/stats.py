"""Rank statistics over groups, in windows and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that the values of a group are counted by; a value's cell is by its arc tangent, so any range of values has some.
CELLS = 4096


def average_rank(value: str, keys: list[str]) -> Column:
    """The rank of each row in its group from 1; rows that tie share the mean of their ranks."""
    within = Window.partitionBy(*keys)
    return F.rank().over(within.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def _ranks(counts: DataFrame, keys: list[str], v: str) -> DataFrame:
    """keys, v, v_rank from keys, v, n__ (a row for each distinct value).

    Values are counted by CELLS cells first, so no task sorts all values of a group: the windows are over the cells of a
    group, and over the values of a cell.
    """
    cell = F.floor(F.lit(CELLS) * (F.atan(F.col(v).cast("double")) / math.pi + 0.5)).alias("cell__")
    celled = counts.withColumn("cell__", cell)
    within = Window.partitionBy(*keys, "cell__").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*keys).orderBy("cell__").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*keys, "cell__").agg(F.sum("n__").alias("size__")).withColumn("before__", F.coalesce(F.sum("size__").over(order), F.lit(0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "cell__"]]
    ranked = celled.withColumn("inside__", F.coalesce(F.sum("n__").over(within), F.lit(0))).alias("a").join(cells.alias("b"), same)
    return ranked.select(*[f"a.{k}" for k in keys], f"a.{v}", (F.col("before__") + F.col("inside__") + (F.col("n__") + 1) / 2.0).alias(f"{v}_rank"))


def _with_ranks(rows: DataFrame, counts: DataFrame, keys: list[str], v: str) -> DataFrame:
    ranks = _ranks(counts, keys, v)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, v]]
    return rows.alias("a").join(ranks.alias("b"), same).select("a.*", f"b.{v}_rank")


def fractional_ranks(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with value_rank for each value.

    Equal values are counted first, so a sort sees each distinct value of a group once, however many rows tie.
    """
    for v in values:
        rows = _with_ranks(rows, rows.groupBy(*keys, v).agg(F.count("*").alias("n__")), keys, v)
    return rows


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho, and whether x and y are constant, for each group; rho is null if undefined (n < 2, or a constant).

    All is done on the counts of pairs of values, so rows that tie in both (a score of 0, say) are one row from the start.
    """
    pairs = rows.groupBy(*keys, x, y).agg(F.count("*").alias("n__"))
    # Both values go through the ranks together, a row each.
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side__"), F.col(v).cast("double").alias("value__")) for k, v in enumerate((x, y))])).alias("s__")
    both = pairs.select(*keys, x, y, "n__", sides).select(*keys, x, y, "n__", "s__.*")
    counts = both.groupBy(*keys, "side__", "value__").agg(F.sum("n__").alias("n__"))
    long = _with_ranks(both, counts, [*keys, "side__"], "value__")
    ranked = long.groupBy(*keys, x, y, "n__").agg(*[F.max(F.when(F.col("side__") == k, F.col("value___rank"))).alias(f"{v}_rank") for k, v in enumerate((x, y))])
    # Ranks of a group have the mean (n + 1) / 2, ties or not.
    n, a, b = F.col("n__"), F.col(f"{x}_rank"), F.col(f"{y}_rank")
    sums = ranked.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(n * a * b).alias("ab__"), F.sum(n * a * a).alias("aa__"), F.sum(n * b * b).alias("bb__"), (F.min(x) == F.max(x)).alias(f"{x}_constant"), (F.min(y) == F.max(y)).alias(f"{y}_constant")
    )
    m = F.col("n").cast("double")  # as longs this product overflows from 2,097,152 rows of a group on
    off = m * (m + 1) * (m + 1) / 4
    rho = F.try_divide(F.col("ab__") - off, F.sqrt((F.col("aa__") - off) * (F.col("bb__") - off)))
    defined = (F.col("n") >= 2) & ~F.col(f"{x}_constant") & ~F.col(f"{y}_constant")
    return sums.withColumn("rho", F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)))).select(*keys, "n", "rho", f"{x}_constant", f"{y}_constant")


def mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def spread(value: Column) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    return F.when(F.count(value) < 2, F.lit(0.0)).otherwise(F.stddev_pop(value))
