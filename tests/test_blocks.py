"""Block-compressed parts, files joined of them, and their indexes."""

import gzip
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ploidyflow.operators import vcf
from ploidyflow.sources import blocks


def records(seed, contigs, n, longest):
    """(chrom, begin, end, line) in file order, after header lines; some reach over bins, some begin alike."""
    draw = random.Random(seed)
    out = [(None, None, None, f"##head {k}") for k in range(3)]
    for c in contigs:
        for a in sorted(draw.choice((draw.randrange(longest), draw.randrange(min(longest, 40_000)))) for _ in range(n)):
            ref = "ACGT"[a % 4] * draw.choice((1, 1, 1, 5, 60))
            out.append((c, a, a + len(ref), f"{c}\t{a + 1}\t.\t{ref}\tG\t{draw.random()}"))
    return out


def ordered(spark, rows, parts):
    """The rows in order over some partitions."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k bigint, chrom string, begin bigint, end bigint, line string")
    return df.repartitionByRange(parts, "k").sortWithinPartitions("k")


def overlapping(rows, chrom, first, last):
    return sorted(line for c, a, _, line in rows if c == chrom and first <= a + 1 <= last)


@pytest.mark.parametrize(("parts", "longest"), [(1, 60_000), (5, 400_000), (3, 800_000_000)])
def test_parts_and_joined_file(spark, tmp_path, parts, longest):
    """Whatever the parts, text is the same, and regions are found by the parts' indexes and by the merged one."""
    rows = records(parts, ("chr1", "chr2", "x"), 4000, longest)
    depth = blocks.depth_for(longest)
    folder, path = str(tmp_path / "parts"), str(tmp_path / "all.gz")
    blocks.write_parts(ordered(spark, rows, parts), folder, depth)
    blocks.joined(spark, folder, path, depth)
    text = "".join(f"{r[3]}\n" for r in rows)
    assert gzip.open(path, "rt").read() == text and os.listdir(tmp_path).count("all.gz") == 1
    names = sorted(x for x in os.listdir(folder) if x.endswith(".gz"))
    assert "".join(gzip.open(f"{folder}/{x}", "rt").read() for x in names) == text
    assert {x for x in os.listdir(folder) if not x.endswith(".gz")} <= {"_parts.json", *(f"{x}{e}" for x in names for e in (".tbi", ".csi"))}
    ending = ".csi" if longest > 1 << 29 else ".tbi"
    assert os.path.exists(path + ending)
    draw = random.Random(7)
    for chrom in ("chr1", "x", "none"):
        for _ in range(4):
            first = draw.choice((1, draw.randrange(1, longest), draw.randrange(1, 40_000)))
            last = first + draw.choice((0, 300, 70_000, longest))
            want = overlapping(rows, chrom, first, last)
            assert sorted(r.line for r in vcf.region_lines(spark, path, chrom, first, last).collect()) == want
            assert sorted(r.line for r in vcf.region_lines(spark, folder, chrom, first, last).collect()) == want
    # an index made of the finished file names the same bins
    merged = blocks.read_index(path)
    os.remove(path + ending)
    assert blocks.index_of(spark, path) == path + ending
    again = blocks.read_index(path)
    assert again.depth == merged.depth and {n: set(b) for n, b in again.bins.items()} == {n: set(b) for n, b in merged.bins.items()}
    assert overlapping(rows, "chr2", 1, longest) == sorted(r.line for r in vcf.region_lines(spark, path, "chr2", 1, longest).collect())


@pytest.mark.parametrize("range_bytes", [blocks.RANGE_BYTES, 30_000, 500])
def test_reading_in_parts(spark, tmp_path, range_bytes):
    """Each line is read once, with its place, wherever a task's bytes begin; lines may be longer than a block, and the last may lack its end."""
    draw = random.Random(2)
    lines = ["".join(draw.choices("abcdef", k=draw.choice((0, 5, 90, 1500)))) for _ in range(3000)] + ["long " * 40_000, "", "end"]
    blob = b"".join(blocks.packed(["\n".join(lines).encode()])) + blocks.END_OF_FILE
    (tmp_path / "x.gz").write_bytes(blob)
    reader = blocks.BlockReader(str(tmp_path / "x.gz"), range_bytes, None)
    spans = reader.partitions()
    got = sorted((x["offset"], x["end"], x["line"]) for s in spans for b in reader.read(s) for x in b.to_pylist())
    assert [x[2] for x in got] == lines and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert len(spans) == -(-len(blob) // range_bytes)
    blocks.register(spark)
    assert spark.read.format("bgzf").option("range_bytes", range_bytes).load(str(tmp_path)).select("line").distinct().count() == len(set(lines))


def test_index_bytes_and_bins():
    """Bins of all levels differ, also beyond 2**29, and an index survives its bytes."""
    depth = blocks.depth_for(800_000_000)
    assert (blocks.depth_for(1 << 29), depth) == (5, 6)
    begin = np.array([0, 0, 16_383, 540_000_000, 799_999_000, (1 << 29) - 1])
    end = np.array([1, 20_000, 16_385, 540_000_001, 799_999_001, (1 << 29) + 1])
    first = [((1 << 3 * level) - 1) // 7 for level in range(7)]
    assert blocks.bin_numbers(begin, end, depth).tolist() == [first[6], first[5], first[5], first[6] + (540_000_000 >> 14), first[6] + (799_999_000 >> 14), 0]
    assert blocks.bin_numbers(np.array([540_000_000 % (1 << 29)]), np.array([540_000_000 % (1 << 29) + 1]), 5).tolist() == [4681 + (540_000_000 - (1 << 29) >> 14)]
    for levels in (5, 6):
        index = blocks.Index(levels)
        for k in range(50):
            index.add("a" if k < 30 else "b", first[levels] + k // 3, k << 16, (k << 16) + 100)
            index.window("a" if k < 30 else "b", k // 3, k << 16)
        again = blocks.Index.from_bytes(index.to_bytes())
        assert (again.depth, again.names, again.bins) == (index.depth, index.names, index.bins)
        assert again.chunks("a", 0, 1) == index.chunks("a", 0, 1) != [] and again.chunks("zz", 0, 9) == []
    with pytest.raises(ValueError, match="beyond"):
        blocks.Runs(5).add(pa.array(["a"]), np.array([1 << 29]), np.array([(1 << 29) + 1]), np.array([0]), np.array([9]))


def test_what_is_lost_leaves_nothing(spark, tmp_path):
    """Attempts that weren't committed aren't parts; a job that fails leaves the folder without any."""
    folder = str(tmp_path / "out")
    writer = blocks.BlockWriter(folder, 5, True)
    batch = pa.RecordBatch.from_pydict({"line": ["a", "b"], "chrom": pa.array([None, "c"]), "begin": pa.array([None, 4], pa.int64()), "end": pa.array([None, 5], pa.int64())})

    class Context:
        def __init__(self, part, attempt):
            self.partitionId, self.taskAttemptId = (lambda: part), (lambda: attempt)

    def attempt(part, number):
        blocks.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: Context(part, number))}), blocks.TaskContext
        try:
            return writer.write(iter([batch]))
        finally:
            blocks.TaskContext = kept

    attempt(0, 0)  # its executor was lost
    messages = [attempt(1, 2), attempt(0, 1), None]
    writer.commit(messages)
    assert sorted(os.listdir(folder)) == ["_parts.json", "part-00000.gz", "part-00000.gz.tbi", "part-00001.gz", "part-00001.gz.tbi"]
    blocks.register(spark)
    assert sorted(r.line for r in spark.read.format("bgzf").load(folder).collect()) == ["a", "a", "b", "b"]
    again = blocks.BlockWriter(folder, 5, True)
    writer = again
    again.commit([attempt(0, 9)])
    assert sorted(x for x in os.listdir(folder) if x.endswith(".gz")) == ["part-00000.gz"]
    failing = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("line"), F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("bigint").alias("begin"), F.lit(None).cast("bigint").alias("end"))
    broken = str(tmp_path / "broken")
    with pytest.raises(Exception, match="lost"):
        blocks.write_parts(failing, broken)
    assert os.listdir(broken) == [] and spark.read.format("bgzf").load(broken).count() == 0


def test_nothing_written(spark, tmp_path):
    none = ordered(spark, [], 2)
    blocks.write_parts(none, str(tmp_path / "p"))
    blocks.joined(spark, str(tmp_path / "p"), str(tmp_path / "x.gz"))
    assert gzip.open(tmp_path / "x.gz").read() == b"" and vcf.region_lines(spark, str(tmp_path / "x.gz"), "a", 1, 9).count() == 0
