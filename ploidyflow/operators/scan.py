"""Running values over sorted rows of which no key is one task: each part by itself, then what goes from part to part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

#: Rows up to which a table of parts' values (some 40 bytes each) is broadcast; beyond, it is shuffled.
BROADCAST_PARTS = 1 << 20


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_PARTS else df


def before_in_parts(parts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, before (sum of value in the key's rows before) and total: carries of a table with a row a key and part."""
    each = Window.partitionBy(key).orderBy(order)
    out = parts.select(key, order, F.coalesce(F.sum(value).over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum(value).over(Window.partitionBy(key)).alias("total"))
    return _small(out)


def merged_in_parts(intervals: DataFrame) -> DataFrame:
    """part, chrom, start1, end1: intervals dealt by range and merged within each part, as a written table.

    A part's rows are sorted and streamed; touching intervals are one. Parts follow the order of contig and start.
    """

    def merge(batches):
        part, open_chrom, open_start, open_end = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("chrom").dictionary_encode()
            key, start, end = names.indices.to_numpy().astype(np.int64), b.column("start1").to_numpy(), b.column("end1").to_numpy().copy()
            if open_chrom is not None:  # what the batch before left open leads this one
                first = names.dictionary.index(open_chrom).as_py()
                names_of = [*names.dictionary.to_pylist(), open_chrom]
                key = np.concatenate([[first if first >= 0 else len(names.dictionary)], key])
                start, end = np.concatenate([[open_start], start]), np.concatenate([[open_end], end])
            else:
                names_of = names.dictionary.to_pylist()
            run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            # running maximum within each contig: ranks of ends, lifted by the contig's run
            ends, rank = np.unique(end, return_inverse=True)
            reach = ends[np.maximum.accumulate(run * len(ends) + rank) - run * len(ends)]
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (start[1:] > reach[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(key)) - 1
            out = [names_of[k] for k in key[first[:-1]].tolist()]
            open_chrom, open_start, open_end = names_of[key[first[-1]]], int(start[first[-1]]), int(reach[last[-1]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), pa.array(out), pa.array(start[first[:-1]]), pa.array(reach[last[:-1]])], ["part", "chrom", "start1", "end1"])
        if open_chrom is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([open_chrom]), pa.array([open_start], pa.int64()), pa.array([open_end], pa.int64())], ["part", "chrom", "start1", "end1"])

    rows = intervals.select("chrom", F.col("start1").cast("bigint").alias("start1"), F.col("end1").cast("bigint").alias("end1"))
    dealt = rows.repartitionByRange("chrom", "start1", "end1").sortWithinPartitions("chrom", "start1")
    return written(dealt.mapInArrow(merge, "part int, chrom string, start1 bigint, end1 bigint"), "islands")


def joined_parts(islands: DataFrame) -> DataFrame:
    """chrom, start1, end1 of what merged_in_parts() returned, merged across parts.

    Each part needs to know how far those before it reach (a running maximum), and which
    interval is open there (a running last value); both are carried over a row a part and contig. Starts ascend in a part, so
    its last interval is new, and is the one left open, unless all of the part is reached from before.
    """
    earlier = Window.partitionBy("chrom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = islands.groupBy("chrom", "part").agg(F.max("end1").alias("end"), F.max("start1").alias("start")).withColumn("reach", F.max("end").over(earlier))
    own = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))
    carried = edges.withColumn("own", own).select("chrom", "part", "reach", F.last("own", ignorenulls=True).over(earlier).alias("open"))
    seen = islands.join(_small(carried), ["chrom", "part"])
    new = F.col("reach").isNull() | (F.col("start1") > F.col("reach"))
    return seen.groupBy("chrom", F.when(new, F.col("start1")).otherwise(F.col("open")).alias("start1")).agg(F.max("end1").alias("end1"))
