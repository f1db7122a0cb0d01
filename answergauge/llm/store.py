"""The shared folder, cut lineage, and joins that a hot key doesn't upset."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1 / HEAVY_SHARE of all rows is heavy; so there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own, if all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/answergauge-shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/answergauge/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: lost executors lose none of it, and it is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with the one row of table for their key; no task gets all rows of a hot key.

    table has a row for each key of rows, with the number of rows that have the key in the column count; total is
    the number of rows. Heavy keys (more than 1 / HEAVY_SHARE of the rows) number fewer than HEAVY_SHARE by that
    definition, so their part of the table is broadcast; all other keys are joined by shuffle. Keys are not null.
    """
    heavy = table.where(F.col(count) > F.lit(total / HEAVY_SHARE))
    light = table.where(F.col(count) <= F.lit(total / HEAVY_SHARE))
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.hint("merge"), key)
    return hot.unionByName(cold)


def col(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ...: functions over batches take no names with a dot, and these clash with none."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def marked(docs: DataFrame, key: Column, **others: Column) -> DataFrame:
    """key, row (all columns of docs as one, so that no name clashes with others), and others."""
    return docs.select(key.alias("key"), F.struct(*map(col, docs.columns)).alias("row"), *[c.alias(k) for k, c in others.items()])


def name_of(*values: Column) -> Column:
    """One string for some values, other for other values, nulls apart: each begins with "=", and has its colons twice."""
    return F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), F.replace(v.cast("string"), F.lit(":"), F.lit("::"))), F.lit("")) for v in values])


def pick(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Of rows (key, row) one for each key that keys (distinct) has, as the columns of row.

    Rows of one key become one in the tasks that read them, so a key may have any share of all rows; they move once,
    for the join finds them dealt out and sorted by key. Of different rows with one key any stays.
    """
    one = rows.groupBy("key").agg(F.first("row").alias("row"))
    return one.join(keys.hint("merge"), "key", "left_semi").select("row.*")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker (functions come by value, so module globals don't)."""
    held = sys.modules.setdefault("_answergauge_worker", types.ModuleType("_answergauge_worker"))
    return held.__dict__.setdefault(name, {})
