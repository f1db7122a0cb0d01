"""Token ids in Parquet: a list column with dictionary encoding, ids of documents with delta encoding.

Documents are dealt out by ranges of their id, sorted, encoded, and written by Spark's own writer, so the files can
be in any store. Pages are small and have an index, and row groups are bounded, so a reader that asks for some
documents reads their pages, and one that asks for lengths reads no token. Files are numbered in order of the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, tokens
from .text_block import blocks

#: How files are laid out: bytes of a row group and a page, rows of a page, and the encodings.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",  # then integers are packed as deltas
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def _encoder(path: str, end_id: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, plain).encode
        for batch in batches:
            for row, to, block in blocks(batch.column(1)):
                flat, bounds = encode(block)
                ids = np.insert(flat, bounds[1:], end_id).view(np.int32)
                ends = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(np.diff(ends)), lists], names=["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> None:
    """Write doc_id, n_tokens and ids (those of the text, and end_id) of each row of docs, ascending by id.

    Null text counts as empty: one id. Null ids come first. Repeated ids stand side by side. plain: strings of the
    tokenizer's own tokens in a text are ordinary text.
    """
    rows = docs.select(store.col(id_col).alias("doc_id"), store.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(_encoder(tokenizer_path, end_id, plain), f"doc_id {kind}, n_tokens long, ids array<int>")
    coded.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids; filters on doc_id reach the page index, columns that aren't asked for aren't read."""
    return spark.read.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, file, row and start (ids of all documents before it); no token is read."""
    place = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", place.alias("file"), F.col("_metadata.row_index").alias("row"))
    return _with_starts(rows)


def _with_starts(rows: DataFrame) -> DataFrame:
    """rows with start: sums within files, and of the files before (a table with a row per file)."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("before_file"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return run.join(files, "file").withColumn("start", F.col("before_file") + F.col("in_file")).drop("before_file", "in_file")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        offsets = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "file", "row", "ids_crc32"])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """What read_metadata gives, and ids_crc32 of the ids in the files (as little-endian unsigned 32-bit integers)."""
    place = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", place.alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _with_starts(store.cut(rows.mapInArrow(_checksums, f"doc_id {kind}, n_tokens long, file long, row long, ids_crc32 long")))
