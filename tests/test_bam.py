"""BAM files: records decoded as arrays, indexes that the sink leaves, and reading of regions."""

import json
import random
import re
import struct

import numpy as np
import pytest

from ploidyflow import schema
from ploidyflow.sources import bam, blocks

from .test_sweep import random_reads


def plain_read(data, names):
    """A row of READS, field by field."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    packed = data[at + 4 * n_ops : at + 4 * n_ops + (l_seq + 1) // 2]
    seq = "".join(bam.PACKED_BASES[b >> 4] + bam.PACKED_BASES[b & 15] for b in packed)[:l_seq]
    return data[32 : at - l_name + l_name - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, "".join(f"{x >> 4}{bam.OPERATIONS[x & 15]}" for x in ops) or "*", seq or "*"


def placed(seed, n, contigs):
    """Reads (schema.READS) of some contigs; some reach far, some have no place."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        chrom, size = draw.choice(contigs)
        cigar = draw.choice(("30M", "10M5D20M", "5S25M", "10M20000N20M", "12M3I15M"))
        seq = "".join(draw.choices("ACGTN", k=draw.choice((30, 30, 29)))) if draw.random() < 0.9 else "*"
        rows.append((f"read{k}", draw.choice((0, 16, 99)), chrom, draw.randrange(1, size - 30_000), draw.randrange(61), cigar, seq))
    return rows


def span(cigar):
    return {"30M": 30, "10M5D20M": 35, "5S25M": 25, "10M20000N20M": 20_030, "12M3I15M": 27, "*": 1}[cigar]


def test_decoded_records():
    rows = [r for r in random_reads(3, 400) if r[5] not in (None, "*") and r[6]]
    rows += [("", 4, "*", 0, 0, "*", "*"), ("long" * 50, 0, "c", 1 << 28, 255, "1M" * 300 + "123456789N", "ACGTN" * 101)]
    names = ["c", "d"]
    records = [bam.packed_read(q, flag, names.index(c) if c in names else -1, p, m, cigar, seq) for q, flag, c, p, m, cigar, seq in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in records])])[:-1].astype(np.int64)
    text = np.frombuffer(b"".join(records), np.uint8)
    got = [tuple(x.values()) for x in bam.decoded(text, at, names).to_pylist()]
    assert got == [plain_read(x[4:], names) for x in records]
    assert bam.decoded(text, at[:0], names).num_rows == 0
    few = bam.decoded(text, at, names, lambda ref, begin, end: (ref == 1) & (end - begin > 20)).to_pylist()
    assert [tuple(x.values()) for x in few] == [g for g, r in zip(got, rows, strict=True) if r[2] == "d" and sum(int(n) for n, o in re.findall(r"(\d+)(.)", r[5]) if o in "MDN=X") > 20] and few


@pytest.mark.parametrize(("long", "ending"), [(900_000, ".bai"), (800_000_000, ".csi")])
def test_regions_by_the_index(spark, tmp_path, long, ending):
    contigs = [("c1", long), ("c2", 400_000), ("none", 100)]
    rows = placed(1, 3000, contigs[:2]) + [(f"lost{k}", 4, "*", 0, 0, "*", "ACGT") for k in range(5)]
    path = str(tmp_path / "x.bam")
    bam.register(spark)
    bam.write_bam(spark.createDataFrame(rows, schema.READS).repartition(5), contigs, path)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["x.bam", f"x.bam{ending}"]
    load = lambda **o: spark.read.format("bam").options(range_bytes=4000, **o).load(path)
    assert sorted(tuple(r) for r in load().collect()) == sorted(rows)
    draw = random.Random(5)
    for regions in ([], [("c2", 1, 400_001)], [("c1", a, a + draw.choice((1, 500, 60_000))) for a in (draw.randrange(1, long) for _ in range(6))], [("c1", 1, 9), ("c2", 100, 30_000), ("c2", 20_000, 31_000), ("zz", 1, 9)], [("c2", 399_999, 400_000)]):
        want = [r for r in rows if any(r[2] == c and r[3] < z and r[3] + span(r[5]) > a for c, a, z in regions)]
        got = load(regions=json.dumps(regions))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert sorted(tuple(r) for r in got.where("chrom = 'c2' and pos > 5000").collect()) == sorted(r for r in want if r[2] == "c2" and r[3] > 5000)


def test_a_region_reads_little(tmp_path, spark):
    """One per cent of a contig is about one per cent of its bytes."""
    contigs = [("c", 2_000_000)]
    draw = random.Random(2)
    rows = [(f"r{k}", 0, "c", draw.randrange(1, 1_960_000), 60, "30M", "".join(draw.choices("ACGT", k=30))) for k in range(60_000)]
    path = str(tmp_path / "x.bam")
    bam.write_bam(spark.createDataFrame(rows, schema.READS), contigs, path)
    reader = bam.BamReader(path, 1 << 20, [("c", 1_000_000, 1_020_000)])
    held = sum((p.end >> 16) - (p.begin >> 16) + (1 << 15) for p in reader.partitions())
    assert held < 0.12 * (tmp_path / "x.bam").stat().st_size
    found = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert found == sum(r[3] < 1_020_000 and r[3] + 30 > 1_000_000 for r in rows)


def test_index_of_bam(tmp_path, spark):
    """What the sink leaves is what a plain pass over the file's reads gives."""
    contigs = [("c1", 900_000), ("c2", 400_000)]
    rows = placed(3, 2000, contigs)
    path = str(tmp_path / "x.bam")
    bam.write_bam(spark.createDataFrame(rows, schema.READS).repartition(3), contigs, path)
    index = bam.read_bam_index(path, ["c1", "c2"])
    ordered = sorted(rows, key=lambda r: (r[2], r[3], r[0]))
    for name, _ in contigs:
        own = [r for r in ordered if r[2] == name]
        number = blocks.bin_numbers(np.array([r[3] - 1 for r in own]), np.array([r[3] - 1 + span(r[5]) for r in own]), 5)
        assert set(index.bins[name]) == set(number.tolist())
        assert set(index.linear[name]) == set(range(max((r[3] - 2 + span(r[5]) >> 14) for r in own) + 1))


def test_no_contig_is_one_task(tmp_path, spark, monkeypatch):
    """Reads of one contig are not met with the header's by an exchange of contigs, and go to more parts than a session's exchanges have if they are many."""
    contigs = [("c1", 900_000)]
    rows = placed(4, 2000, contigs)
    seen, put = [], blocks.write_parts

    def spy(lines, folder, depth):
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        put(lines, folder, depth)
        seen.append((plan, len(json.loads(open(f"{folder}/_parts.json").read()))))

    monkeypatch.setattr(bam, "write_parts", spy)
    monkeypatch.setattr(bam, "PART_READS", 100)
    path = str(tmp_path / "x.bam")
    bam.write_bam(spark.createDataFrame(rows, schema.READS).repartition(3), contigs, path)
    (plan, parts), = seen
    assert "rightHint=(strategy=broadcast)" in plan and parts > 10
    reader = bam.BamReader(path)
    got = [tuple(x.values()) for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(got) == sorted(rows) and [r[3] for r in got] == sorted(r[3] for r in rows)
