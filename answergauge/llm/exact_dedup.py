"""Exact dedup against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest, in a folder of the caller's choice; it outlives the
session (DigestIndex opens the folder again). New rows are reduced to one per digest, compared with the index by a
sort-merge anti-join on the bucketing, so the index is neither shuffled nor broadcast, and appended.

Each append adds a file to a bucket. While a bucket has one file, the join reads it in its order; beyond, it is sorted
in the task that reads it, and after FILES appends the index is written anew with one sorted file for each bucket, in as
many buckets as its size asks for. A rewrite goes to a new folder, which counts once it is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: Runs of these count as one space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Digests in a bucket (about 100 bytes each), buckets at least, and appends after which buckets are written anew.
PER_BUCKET, LEAST_BUCKETS, FILES = 2_000_000, 64, 8


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with every run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ").cast("binary"), 256)


def buckets_for(rows: int) -> int:
    """A power of two of buckets for so many digests."""
    return max(LEAST_BUCKETS, 1 << (-(-rows // PER_BUCKET) - 1).bit_length() if rows > PER_BUCKET else 1)


class DigestIndex:
    """Digests seen so far, with the id of the row that stays.

    In the folder there is a folder for each time that the index was written as a whole, named by its number, its buckets and
    the appends since; the one with the highest number that is complete counts. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType | None = None, buckets: int | None = None):
        """Open the index in the folder path, or begin one. buckets: of a new one; by default, those for its first batch."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.kind = (id_type or T.LongType()).simpleString()
        self.name: str | None = None
        self.number = 0
        hadoop = spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        self.files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in self.files.listStatus(folder) if self.files.exists(folder) else []:
            number, _, of = status.getPath().getName().partition("-")
            if number.isdigit() and int(number) > self.number and self.files.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                self.number, self.buckets = int(number), int(of)
        if self.number:
            self._open(self.number, self.buckets)

    def _open(self, number: int, buckets: int) -> None:
        self.close()
        self.name, self.number, self.buckets = f"digest_index_{uuid.uuid4().hex}", number, buckets
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {self.kind}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{number:08d}-{buckets}'"
        )

    def close(self) -> None:
        """Take the index's table out of the catalog; the folder stays."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.name = None

    def table(self) -> DataFrame:
        """digest, keep_id."""
        if not self.name:
            return self.spark.createDataFrame([], f"digest string, keep_id {self.kind}")
        return self.spark.table(self.name)

    @contextmanager
    def ordered(self) -> Iterator[DataFrame]:
        """The table; within this, a plan knows that it is sorted by digest in each bucket that is one file."""
        conf = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, "true")
        try:
            yield self.table()
        finally:
            self.spark.conf.set(conf, before)

    def _seat(self) -> Column:
        """A string for each bucket of a digest, other ones for other buckets, that deals it to the task of its number where tasks are as many as buckets."""
        draws = self.spark.range(32 * self.buckets).select(F.pmod(F.hash(F.col("id").cast("string")), F.lit(self.buckets)).alias("bucket"), "id")
        seats = {r.bucket: str(r.id) for r in draws.groupBy("bucket").agg(F.min("id").alias("id")).collect()}
        every = ",".join(seats.get(b, f"b{b}") for b in range(self.buckets))  # one that no draw hits goes to any task
        return F.element_at(F.split(F.lit(every), ","), F.pmod(F.hash("digest"), F.lit(self.buckets)) + 1)

    def _write(self, rows: DataFrame) -> None:
        # By the bucket, not the digest: a bucket is whole in one task, and so one file, whatever number of tasks it is dealt to.
        dealt = rows.select("digest", F.col("keep_id").cast(self.kind).alias("keep_id")).repartition(self.buckets, self._seat())
        dealt.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _appends(self) -> int:
        """The most files that a bucket has."""
        of_bucket: dict[str, int] = {}
        for file in self.table().inputFiles():
            bucket = file.rpartition("_")[2].partition(".")[0]
            of_bucket[bucket] = of_bucket.get(bucket, 0) + 1
        return max(of_bucket.values(), default=0)

    def append(self, fresh: DataFrame) -> None:
        """Add rows (digest, keep_id) whose digests are new."""
        if not self.name:
            self._open(1, self.buckets or LEAST_BUCKETS)
        self._write(fresh)
        if self._appends() > FILES:
            self.compact()

    def compact(self) -> None:
        """Write the index anew: a sorted file for each bucket, in as many buckets as its size asks for, or more."""
        if not self.name:
            return
        old, old_name, number = self.table(), self.name, self.number + 1
        folder = f"{self.path}/{self.number:08d}-{self.buckets}"
        wanted = max(self.buckets, buckets_for(old.count()) if self.buckets >= LEAST_BUCKETS else self.buckets)
        self.name = None
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:08d}-{wanted}"), True)  # of a rewrite that was cut off
        self._open(number, wanted)
        self._write(old)
        self.spark.sql(f"DROP TABLE {old_name}")
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Dedup docs against the index and among themselves, and append what is new.

        Returns (rows, groups). rows: doc_id, digest, and no more, a row for each of docs. groups: digest,
        keep_id (the smallest id of the batch, or the one that the index had), group_size (rows of this batch).
        Adding the same batch again changes nothing: its rows find their own digests.
        """
        rows = store.cut(docs.select(store.col(id_col).alias("doc_id"), digest_of(store.col(text_col)).alias("digest")))
        batch = store.cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")))
        if not self.name:
            self._open(1, self.buckets or buckets_for(batch.count()))
        with self.ordered() as known:
            found = batch.join(known.withColumn("known", F.lit(True)).hint("merge"), "digest", "left")
            groups = store.cut(found.select("digest", F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id"), "group_size", "known"))
            fresh = batch.join(known.hint("merge"), "digest", "left_anti")
            self.append(fresh.select("digest", F.col("first_id").alias("keep_id")))
        return rows, groups.drop("known")


def label_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 for each row of docs, dropped ones too.

    Null text counts as empty. Of rows that repeat both the id and the text, one is kept. A row with a null
    id stays only where its group has no other id. An empty table gives an empty result.
    """
    rows, groups = index.add(docs, id_col, text_col)
    # A row of the batch for each (digest, id), with the number of its repeats: a hot text is many ids.
    each = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("repeats"))
    total = rows.count()
    found = store.lookup(each, groups, "digest", "group_size", total)
    return found.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("nth"), "digest"
    ).select(
        id_col, "keep_id", "group_size", (F.col("keep_id").eqNullSafe(F.col(id_col)) & (F.col("nth") == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns as they were, whatever their names; each row moves once.

    Rows stay as label_duplicates says: of each text that the index doesn't have, the smallest id; a null id where there is
    no other. Of rows that repeat both the id and the text one stays, any of them.
    """
    _, groups = index.add(docs, id_col, text_col)
    rows = store.marked(docs, store.name_of(digest_of(store.col(text_col)), store.col(id_col)))
    return store.pick(rows, groups.select(store.name_of(F.col("digest"), F.col("keep_id")).alias("key")))
