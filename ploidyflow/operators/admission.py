"""A cap on depth by whole reads, in order of arrival.

The first read to begin at a position is admitted; a later one only while fewer reads than the cap are open there, of those that were
admitted. A read is open from its begin up to the position after its last one, as readers drop it only when they have gone past.
Whether a read is admitted hangs on those before it, but only where more reads than the cap are open at all. Such places are found by counting
events in bins with carries; the reads that begin there form islands, between which nothing hangs together.

As many reads of a position are admitted as there is room for, the first ones, so no more of them than the cap are looked at, and a number
a position is all that is decided. An island is decided bin by bin, side by side: first as if nothing were open where a bin begins, then
again with the reads that the bins before leave open, until no bin gets others than those it was decided with. That is the answer of the whole
sequence, as the first bin gets none, and what it leaves open is right, and so on. Mostly few places have gone by when it no longer matters what was open
at the begin, so the second round is the last; where it goes on to matter, the bins that still change are streamed as one sequence after some rounds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigars import ref_span
from ..store import written
from .scan import BROADCAST_PARTS, before_in_parts, joined_parts, merged_in_parts

#: Positions of a bin in which events are summed on their own, by which reads and islands meet, and which is decided by itself.
BIN = 1 << 14
#: Rounds over bins side by side before those that still change are decided as one sequence.
ROUNDS = 4
#: Reads to a task, about, where they are dealt by position or bin.
TASK_READS = 1 << 21

_PIECE = ["chrom", "start1", "bin"]
_DECIDED = "chrom string, start1 bigint, bin bigint, pos bigint, n int, last bigint"


def _pressed(reads: DataFrame, most: int) -> tuple[DataFrame, int]:
    """chrom, pos, last (the farthest) of begins of reads at which more reads than the cap would be open, and how many reads begin anywhere."""
    begins = F.struct(F.col("pos").alias("at"), F.lit(1).alias("by"), F.lit(1).alias("new"), F.col("last").alias("last"))
    ends = F.struct((F.col("last") + 2).alias("at"), F.lit(-1).alias("by"), F.lit(0).alias("new"), F.lit(None).cast("bigint").alias("last"))
    events = reads.select("chrom", F.explode(F.array(begins, ends)).alias("e"))
    sums = events.groupBy("chrom", F.floor(F.col("e.at") / BIN).alias("bin"), F.col("e.at").alias("at")).agg(F.sum("e.by").alias("by"), F.sum("e.new").alias("new"), F.max("e.last").alias("last"))
    sums = written(sums, "events")
    before = before_in_parts(sums.groupBy("chrom", "bin").agg(F.sum("by").alias("by")), "chrom", "bin", "by")
    along = Window.partitionBy("chrom", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opened = sums.withColumn("own", F.sum("by").over(along)).join(before, ["chrom", "bin"])
    found = opened.where((F.col("new") > 0) & (F.col("before") + F.col("own") > most)).select("chrom", F.col("at").alias("pos"), "last")
    return written(found, "pressed"), sums.agg(F.sum("new")).first()[0] or 0


def _decider(most: int, size: int, whole: bool):
    """Of rows of reads, sorted by island, bin, position and rank: rows of how many are admitted (n) at each position that is in question, and rows of the admitted reads' last positions that lie in later bins.

    Rows of rank 0 are reads that bins before left open. whole: an island is one sequence; else each of its bins is.
    """

    def decide(batches):
        key, at, room, ends = None, None, 0, []
        held = None  # the last position's answer, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("chrom").dictionary_encode()
            labels, chrom = names.dictionary.to_pylist(), names.indices.to_numpy()
            start1, number, pos, rank, last, asked = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start1", "bin", "pos", "rank", "last", "open"))
            new = np.ones(len(pos), bool)
            new[1:] = (chrom[1:] != chrom[:-1]) | (start1[1:] != start1[:-1]) | (number[1:] != number[:-1]) | (pos[1:] != pos[:-1])
            lead = np.flatnonzero(new)
            n = np.diff(np.append(lead, len(pos)))
            lasts, taken, answers = last.tolist(), [], []
            for i, many, c, s, k, p, q in zip(*(x.tolist() for x in (lead, n, chrom[lead], start1[lead], number[lead], pos[lead], asked[lead])), strict=True):
                own = (labels[c], s) if whole else (labels[c], s, k)
                if own != key:
                    key, at, ends = own, None, []
                if p != at:
                    at = p
                    while ends and ends[0] < at - 1:
                        heapq.heappop(ends)
                    room = max(1, most - len(ends)) if q else 1 << 62
                    if held:
                        answers.append(held)
                    held = [labels[c], s, k, p, 0] if q else None
                few = min(many, room)
                room -= few
                for x in lasts[i : i + few]:
                    heapq.heappush(ends, x)
                if held:
                    held[4] += few
                taken.append(few)
            inside = np.arange(len(pos)) - np.repeat(lead, n)
            on = np.flatnonzero((inside < np.repeat(taken, n)) & (rank > 0) & (last + 1 >= (number + 1) * size))
            yield rows(answers)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(names.indices.take(pa.array(on))), pa.array(start1[on]), pa.array(number[on]), pa.nulls(len(on), pa.int64()), pa.nulls(len(on), pa.int32()), pa.array(last[on])], ["chrom", "start1", "bin", "pos", "n", "last"])
        if held:
            yield rows([held])

    def rows(answers):
        columns = list(zip(*answers, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.nulls(len(answers), pa.int64())], ["chrom", "start1", "bin", "pos", "n", "last"])

    return decide


def _decided(near: DataFrame, most: int, parts: int) -> DataFrame:
    """chrom, pos, n: how many of the first reads of each position in question are admitted."""
    columns = [*_PIECE, "pos", "rank", "last", "open"]

    def run(rows: DataFrame, sent: DataFrame | None, whole: bool = False) -> DataFrame:
        if sent is not None:
            rows = rows.unionByName(sent.select(*_PIECE, (F.col("bin") * BIN - 1).alias("pos"), F.lit(0).alias("rank"), "last", F.lit(False).alias("open")))
        dealt = rows.select(columns).repartition(parts, *(_PIECE[:2] if whole else _PIECE))
        return written(dealt.sortWithinPartitions(*_PIECE, "pos", "rank").mapInArrow(_decider(most, BIN, whole), _DECIDED), "decided")

    def left_open(out: DataFrame) -> DataFrame:
        """Reads that are open where later bins begin, a row a read and bin."""
        return out.where("last is not null").select("chrom", "start1", F.explode(F.sequence(F.col("bin") + 1, F.floor((F.col("last") + 1) / BIN))).alias("bin"), "last")

    out = run(near, None)
    sent, before = left_open(out), None
    for k in range(1, ROUNDS + 1):
        differing = sent.withColumn("by", F.lit(1))
        if before is not None:
            differing = differing.unionByName(before.withColumn("by", F.lit(-1)))
        changed = written(differing.groupBy(*_PIECE, "last").agg(F.sum("by").alias("by")).where("by <> 0").select(_PIECE).distinct(), "changed")
        if not changed.count():
            break
        if k < ROUNDS:
            again = run(near.join(changed, _PIECE, "left_semi"), sent.join(changed, _PIECE, "left_semi"))
            kept = out.join(changed, _PIECE, "left_anti")
        else:  # all bins before an island's first that changes are right
            first = changed.groupBy("chrom", "start1").agg(F.min("bin").alias("first"))
            on = lambda df, which: df.join(first, ["chrom", "start1"]).where(which).drop("first")
            again = run(on(near, "bin >= first"), on(sent, "bin = first"), True)
            kept = out.join(first, ["chrom", "start1"], "left").where("first is null or bin < first").drop("first")
        out, before = again.unionByName(kept), sent
        sent = left_open(out)
    return out.where("n is not null").select("chrom", "pos", "n")


def admitted(reads: DataFrame, most: int | None) -> DataFrame:
    """The reads (with chrom, pos, qname, flag, cigar) that a cap admits; all if most is None.

    Reads arrive by position, those of one position by name, flag and CIGAR text. Reads without operations cover a position.
    """
    if most is None:
        return reads
    last = F.col("pos") + F.greatest(F.coalesce(ref_span(F.col("cigar")), F.lit(1)), F.lit(1)) - 1
    placed = reads.where("chrom is not null and pos is not null").select("chrom", "pos", "qname", "flag", "cigar", last.alias("last"))
    pressed, total = _pressed(placed, most)
    n = pressed.count()
    if not n:
        return reads
    parts = max(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_READS))
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_PARTS else (lambda df: df)
    dealt = (lambda df: df) if n <= BROADCAST_PARTS else (lambda df: df.repartition(parts, "chrom", "pos"))
    places = pressed.select("chrom", "pos")
    islands = written(joined_parts(merged_in_parts(pressed.select("chrom", F.col("pos").alias("start1"), (F.col("last") + 2).alias("end1")))), "pressed-islands")
    spread = lambda a, z: F.explode(F.sequence(F.floor(a / BIN), F.floor(z / BIN))).alias("bin")
    where = islands.select(F.col("chrom"), F.col("start1"), F.col("end1"), spread(F.col("start1"), F.col("end1") - 1))
    marked = dealt(placed).join(small(places.withColumn("open", F.lit(True))), ["chrom", "pos"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    reached = marked.select("*", spread(F.col("pos"), F.col("last") + 1))
    # a read meets an island in each bin that both reach; it is taken in the first of those
    meets = (F.col("pos") < F.col("end1")) & (F.col("last") + 1 >= F.col("start1")) & (F.col("bin") == F.floor(F.greatest("pos", "start1") / BIN))
    near = reached.join(F.broadcast(where) if where.count() <= BROADCAST_PARTS else where, ["chrom", "bin"]).where(meets)
    arrival = ["qname", "flag", "cigar"]
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("chrom", "start1", "pos").orderBy(*arrival))).where(F.col("rank") <= most)
    near = written(near.select(*_PIECE, "pos", "rank", "last", "open"), "near")
    decided = _decided(near, most, parts)
    own = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(*arrival))
    chosen = dealt(reads).join(small(decided), ["chrom", "pos"]).withColumn("rank", own).where((F.col("rank") <= most) & (F.col("rank") <= F.col("n")))
    free = dealt(reads).join(small(places), ["chrom", "pos"], "left_anti").select(*reads.columns)
    return free.unionByName(chosen.select(*reads.columns))
