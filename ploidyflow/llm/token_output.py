"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes.

One row is one document: doc_id, part, row (its place in the part), n_tokens and
ids. Parts are ranges of doc_id in ascending order, rows of a part are in
ascending order, so the files read in the order of (part, row) are one stream
of ids. Small pages and the page index that Parquet writes for every column let
a reader take some documents' ids, or the metadata alone, without the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_of, list_array, session_setup, shared_path, text_slices
from .piece_table import table

#: ids below 2**17 fit a dictionary page of this size.
DICTIONARY_BYTES = 1 << 20


def parquet_options(encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000) -> dict[str, str]:
    """Writer options. encoding: "dictionary", or "delta" (DELTA_BINARY_PACKED)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    return {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(DICTIONARY_BYTES),
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
    }


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """doc_id, part, row, n_tokens, ids of every document, in order of doc_id. Rows without doc_id are left out.

    Rows with the same doc_id follow each other in order of their texts.
    """

    def encode(batches):
        part, row, enc = TaskContext.get().partitionId(), 0, table(tokenizer)
        for rows, data, bounds in text_slices(batches):
            ids, counts = enc.encode(data, bounds)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(counts), list_array(ids.view("<i4"), counts, pa.int32())],
                ["doc_id", "part", "row", "n_tokens", "ids"],
            )
            row += n

    ordered = documents_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, "doc_id bigint, part int, row bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, encoding: str = "dictionary", **layout) -> None:
    """Encodes every whole text (null: empty) and writes the files to path.

    An empty table gives files without rows; an empty text is the end id alone.
    """
    session_setup(docs.sparkSession)
    encoded(docs, tokenizer, end_id).write.options(**parquet_options(encoding, **layout)).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All documents without their ids: the column of ids isn't read."""
    return spark.read.parquet(path).select("doc_id", "part", "row", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """ids of the documents first to last; row groups and pages of others are skipped."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def with_starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds start: the number of ids of all rows before, in order of (part, row).

    Running sums are made in each part; only one total a part, of counts, is summed in one task.
    """
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "part").withColumn("start", F.col("inside") + F.col("before")).drop("inside", "before")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy().tolist()
            sums = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            counts = np.diff(np.array(at, np.int64)) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("row"), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    read = spark.read.parquet(path).select("doc_id", "part", "row", "ids")
    sums = read.mapInArrow(digest, "doc_id bigint, part int, row bigint, n_tokens bigint, ids_crc32 bigint")
    return with_starts(sums, read_metadata(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, encoding: str = "dictionary") -> DataFrame:
    """Writes the token files into the shared folder and returns their digest."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, encoding)
    return token_digest(docs.sparkSession, path)
