"""Small hand-computed cases, random pileups against a plain evaluator, and whole-plan runs."""

import collections
import gzip
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ploidyflow import schema
from ploidyflow.cli import checked_contigs
from ploidyflow.config import CallerConfig, ConfigError, model_files, model_folder, parallelism
from ploidyflow.functions import numbers, tokens
from ploidyflow.operators import candidates, depth, encode, pileup, reads, regions, scoring, vcf
from ploidyflow.plans.calling import call_variants, scored_sites
from ploidyflow.sources import bam, bed, blocks, fasta, sam

OBS = schema.OBSERVATIONS


def obs_of(spark, columns):
    """columns: {(chrom, pos): [(token, flag, mapq), ...]}"""
    rows = [(c, p, f"r{k}", f, m, t) for (c, p), shown in columns.items() for k, (t, f, m) in enumerate(shown)]
    return spark.createDataFrame(rows, OBS)


def refs_of(spark, bases):
    return spark.createDataFrame([(c, p, b) for (c, p), b in bases.items()], "chrom string, pos bigint, base string")


def one_site(spark, shown, ref="A", around="CGTACGTACGTACGTACGTACGTACG", **kw):
    bases = {("c", 10): ref, **{("c", 11 + k): b for k, b in enumerate(around)}}
    found = candidates.candidate_sites(obs_of(spark, {("c", 10): [(t, 99, 60) for t in shown]}), refs_of(spark, bases), kw.pop("least", 1), 0.1, **kw).collect()
    return found[0] if found else None


@pytest.mark.parametrize(
    ("shown", "alt", "kind", "n"),
    [
        (["C", "C", "G", "G"] + ["A"] * 6, "C", "SNP", 2),
        (["A+2AC"] * 2 + ["A+10ACGTACGTAC"] * 2 + ["A"] * 6, "AACGTACGTAC", "INS", 2),
        (["C"] * 3 + ["A+1T"] * 3 + ["A"] * 4, "C", "SNP", 3),
        (["C"] + ["A+1T"] * 3 + ["A-1N"] * 3 + ["A"] * 4, "AT", "INS", 3),
        (["a-2nn"] * 3 + ["a"] * 4, "A", "DEL", 3),
        (["C+2TG"] * 3 + ["A"] * 3, "C", "SNP", 3),
        (["N"] * 3 + ["A"] * 3, "N", "SNP", 3),
    ],
)
def test_chosen_allele(spark, shown, alt, kind, n):
    got = one_site(spark, shown)
    assert (got.alt, got.kind, got.alt_num, got.rd) == (alt, kind, n, len(shown))
    assert got.ref == ("ACG" if kind == "DEL" else "A")


def test_sites_that_are_none(spark):
    assert one_site(spark, ["C"] * 5 + ["A"] * 5, ref="a") is None
    assert one_site(spark, ["C"] * 5 + ["A"] * 5, ref="a", uppercase=True).alt == "C"
    assert one_site(spark, ["C"] * 3 + [f"A+21{'ACGTACGTACGTACGTACGTA'}"] * 4) is None
    assert one_site(spark, ["C"] * 3 + [f"A-21{'N' * 21}"] * 4) is None
    assert one_site(spark, ["*"] * 5 + ["A"]) is None
    assert one_site(spark, ["C"] + ["A"] * 10) is None
    assert one_site(spark, ["C"] + ["A"] * 9).alt_num == 1
    assert one_site(spark, ["C"] * 9, least=10) is None
    assert one_site(spark, ["N"] * 3 + ["A"] * 3, acgt_only=True) is None


def test_ref_count_and_deletion_span_with_gaps(spark):
    got = one_site(spark, ["A+2TG", "A", "a", "C"])
    assert got.ref_num == 2
    bases = {("c", 10): "A", ("c", 11): "c", ("c", 13): "G"}
    spans = candidates.deletion_spans(spark.createDataFrame([("c", 10, 3)], "chrom string, pos bigint, n int"), refs_of(spark, bases)).collect()
    assert spans[0].span == "A*G"


def test_read_filter_bits(spark):
    flags = [0, 1, 3, 4, 9, 256, 512, 1024, 2048, 99, 16, 3 | 8]
    df = spark.createDataFrame([(f, m) for f in flags for m in (4, 5)], "flag int, mapq int")
    assert sorted((r.flag, r.mapq) for r in reads.read_filter(df).collect()) == [(0, 5), (3, 5), (16, 5), (99, 5)]
    named = reads.rename_reads(spark.createDataFrame([("q", 83)], "qname string, flag int")).first()
    assert (named.qname, named.strand) == ("q_83", 1)


def test_stream_of_reads(spark, tmp_path):
    from ploidyflow.streaming import filtered_reads

    df = spark.createDataFrame([("a", 0, 60), ("b", 4, 60)], "qname string, flag int, mapq int")
    df.write.parquet(f"{tmp_path}/in")
    q = filtered_reads(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.qname for r in spark.table("kept").collect()] == ["a_0"]


@pytest.mark.parametrize(("mean", "ploidy", "floor", "want"), [(10, 4, 1, 2), (14, 4, 1, 4), (100, 4, 10, 25), (8, 4, 10, 10)])
def test_min_depth(spark, mean, ploidy, floor, want):
    assert spark.range(1).select(numbers.min_depth(F.lit(mean), ploidy, floor).alias("x")).first().x == want


def test_numbers(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    assert row(numbers.qual(F.lit(1.0)), numbers.qual(F.lit(0.0)), numbers.qual(F.lit(0.9))) == (72.25, 0.0, 10.0)
    assert row(numbers.allele_fraction(F.lit(1), F.lit(32)), numbers.allele_fraction(F.lit(1), F.lit(160)), numbers.allele_fraction(F.lit(0), F.lit(0))) == (0.0312, 0.0063, 0.0)
    assert row(*[numbers.plain_number(F.lit(x)) for x in (0.0005, 1.0, 0.25, 1234.5)]) == ("0.0005", "1.0", "0.25", "1234.5")
    assert row(numbers.genotype(F.lit(2), 6), numbers.genotype(F.lit(0), 4), numbers.genotype(F.lit(4), 4)) == ("0/0/0/0/1/1", "0/0/0/0", "1/1/1/1")
    assert row(tokens.base_code(F.lit("T")), tokens.base_code(F.lit("*")), tokens.indel_length(F.lit("12AC")), tokens.indel_sequence(F.lit("12AC"))) == (3, 4, 12, "AC")


def test_cigar_observations(spark):
    rows = [("q", 0, "c", 100, 60, "2S3M2I2M1D2M3N1M2H", "TTACGTTGACCA"), ("r", 16, "c", 5, 60, "1M2N1=1X", "ACG"), ("s", 0, "c", 5, 60, "*", "A"), ("t", 0, "c", 7, 60, None, None)]
    got = pileup.observations(spark.createDataFrame(rows, schema.READS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.qname, []).append((r.pos, r.token))
    assert sorted(by["q"]) == [(100, "A"), (101, "C"), (102, "G+2TT"), (103, "G"), (104, "A-1N"), (105, "*"), (106, "C"), (107, "C"), (108, ">"), (109, ">"), (110, ">"), (111, "A")]
    assert sorted(by["r"]) == [(5, "A"), (6, "<"), (7, "<"), (8, "C"), (9, "G")]
    assert set(by) == {"q", "r"}


def test_depth(spark):
    contigs = spark.createDataFrame([("a", 100, 1), ("b", 300, 2), ("none", 50, 3)], schema.CONTIGS)
    rows = [("q", 0, "a", 1, 60, "10M2D3N5I=".replace("5I=", "5I5="), "A")] * 10 + [("q", 0, "b", 1, 60, "30M", "A")] * 5
    depths = depth.contig_depth(spark.createDataFrame(rows, schema.READS), contigs)
    assert sorted(tuple(r) for r in depths.collect()) == [("a", 100, 2.0), ("b", 300, 0.5)]
    assert depth.genome_depth_value(depths) == 1
    with pytest.raises(depth.NoDepthError):
        depth.genome_depth_value(depths.limit(0))


def bed_of(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")


def test_bed(spark):
    lines = bed_of(spark, ["# x", "track a", "browser b", "", "chr2\t10\t20", "chr1\t10\t20\tname", "chr1\t20\t30", "chr1\t5\t5", "chr2\t12\t14"])
    parsed = regions.parse_bed(lines)
    assert sorted(tuple(r)[1:] for r in parsed.collect()) == [("chr1", 11, 21), ("chr1", 21, 31), ("chr2", 11, 21), ("chr2", 13, 15)]
    assert sorted(tuple(r) for r in regions.merge_intervals(parsed).collect()) == [("chr1", 11, 31), ("chr2", 11, 21)]
    assert sorted(tuple(r) for r in regions.bed_contigs(lines).collect()) == [("chr1", 2), ("chr2", 1)]
    sites = spark.createDataFrame([("chr2", p) for p in (10, 11, 20, 21)] + [("chr3", 15)], "chrom string, pos bigint")
    assert sorted(r.pos for r in regions.within_regions(sites, parsed).collect()) == [11, 20]
    with pytest.raises(Exception, match="fewer than 3"):
        regions.parse_bed(bed_of(spark, ["chr1\t1"])).collect()
    for wrong in ("chr1\tx\t5", "chr1\t1\t5y", "chr1\t1.5\t9", "chr1\t\t5"):
        with pytest.raises(Exception, match="no whole number"):
            regions.parse_bed(bed_of(spark, ["chr1\t1\t9", wrong])).collect()


def test_semi_join_against_brute_force(spark):
    draw = random.Random(4)
    spans = [("c", a, a + draw.choice((1, 50, 40_000))) for a in (draw.randrange(100_000) for _ in range(40))]
    sites = [("c", p) for p in sorted({draw.randrange(160_000) for _ in range(500)})]
    got = {r.pos for r in regions.within_regions(spark.createDataFrame(sites, "chrom string, pos bigint"), spark.createDataFrame(spans, schema.REGIONS)).collect()}
    assert got == {p for _, p in sites if any(a <= p < b for _, a, b in spans)}


# ------------------------------------------------------------------- features


def plain_features(ref, shown, mean):
    """30 numbers of one column, from the rules."""

    def side(s):
        own = [(t.upper(), m) for t, f, m in shown if (f & 16) // 16 == s]
        top = {}
        for mark in "+-":
            counts = collections.Counter(t.split(mark)[1] for t, _ in own if mark in t)
            top[mark] = min(counts.items(), key=lambda x: (-x[1], x[0])) if counts else None
        out = [sum(t[0] == b for t, _ in own) for b in "ACGT"]
        out += [top["+"][1] if top["+"] else 0, top["-"][1] if top["-"] else 0, sum(t == "*" for t, _ in own)]
        mq = [0] * 7
        for t, m in own:
            if "*" in t:
                mq[6] += m
                continue
            if t[0] not in "ACGT":
                continue
            mq["ACGT".index(t[0])] += m
            for k, mark in ((4, "+"), (5, "-")):
                if top[mark]:
                    digits = "".join(c for c in top[mark][0] if c.isdigit())
                    if mark + digits in t:
                        mq[k] += m
        return out + mq

    return [mean, "ACGT".find(ref) if ref in "ACGT" else 4, *side(1), *side(0)]


def random_columns(seed, n=25):
    draw = random.Random(seed)
    at, columns = 1, {}
    for _ in range(n):
        at += draw.choice((1, 1, 1, 7))
        shown = [(draw.choice(["A", "c", "G", "T", "*", "N", ">", "A+1C", "A+12ACGTACGTACGT", "a-2NN", "C-1N", "*+1T", "g+2AC"]), draw.choice((99, 83, 147, 163)), draw.randrange(5, 61)) for _ in range(draw.randint(1, 15))]
        columns[("c", at)] = shown
    return columns


@pytest.mark.parametrize("seed", [1, 2])
def test_features_against_plain_rules(spark, seed):
    columns = random_columns(seed)
    draw = random.Random(seed)
    bases = {k: draw.choice("ACGTaN") for k in columns}
    got = encode.column_features(obs_of(spark, columns), refs_of(spark, bases), 17).collect()
    assert len(got) == len(columns)
    for r in got:
        assert [r[x] for x in encode.FEATURES] == plain_features(bases[r.chrom, r.pos], columns[r.chrom, r.pos], 17)


def test_windows_close_gaps(spark):
    columns = {("c", p): [("A", 99, 60)] * p for p in (2, 3, 4, 50, 51, 52, 53, 54, 55, 56)} | {("d", 5): [("A", 99, 60)]}
    refs = refs_of(spark, {k: "A" for k in columns})
    numbered = encode.with_ordinals(encode.column_features(obs_of(spark, columns), refs, 1))
    assert sorted(r.ord for r in encode.full_windows(numbered, 1).collect()) == list(range(3, 10))
    sites = spark.createDataFrame([("c", p) for p in (3, 50, 56)] + [("d", 5)], "chrom string, pos bigint")
    for joined in (False, True):
        got = {r.pos: r.x for r in encode.window_tensors(numbered, sites, 1, joined).collect()}
        assert set(got) == {50} and [got[50][30 * k + 2 + 14] for k in range(3)] == [4, 50, 51]


def test_ordinals_over_bins(spark):
    df = spark.createDataFrame([("c", p) for p in range(3, 400, 3)] + [("d", 1)], "chrom string, pos bigint")
    got = sorted((r.chrom, r.pos, r.ord, r.n_cols) for r in encode.with_ordinals(df, 10).collect())
    assert got == [("c", p, k, 133) for k, p in enumerate(range(3, 400, 3), 1)] + [("d", 1, 1, 1)]


def test_first_position_is_no_column(spark):
    assert pileup.token_counts(obs_of(spark, {("c", 1): [("A", 0, 60)], ("c", 2): [("A", 0, 60)]})).count() == 1


def test_depth_cap(spark):
    obs = obs_of(spark, {("c", 5): [("A", 0, 60)] * 20})
    assert pileup.depth_capped(obs, 7).count() == 7 and pileup.depth_capped(obs, None).count() == 20


def test_scorers(spark):
    sites = spark.createDataFrame([("c", 1, 20, 0), ("c", 2, 20, 5), ("c", 3, 20, 10), ("c", 4, 20, 20)], "chrom string, pos bigint, rd int, alt_num int")
    assert [r.pred_label for r in scoring.binomial_scores(sites, 4).orderBy("pos").collect()] == [0, 1, 2, 4]
    p = spark.range(1).select(*scoring.dosage(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))).first()
    assert (p.pred_prob, p.pred_label) == (0.4, 1)
    x = spark.range(1).select(scoring.standardized(F.array(F.lit(3.0), F.lit(5.0)), [1.0, 1.0], [2.0, 4.0]).alias("x")).first().x
    assert x == [1.0, 1.0]


def test_batch_scores_equal_the_model(spark):
    draw = np.random.default_rng(1)
    x = draw.random((50, 3 * 30)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, x array<float>")
    mean, std = [0.5] * 90, [2.0] * 90
    got = {r.k: (r.pred_prob, r.pred_label) for r in scoring.batch_scores(df, scoring.seeded_dense(1, 6), 1, mean, std, batch_size=7).collect()}
    want = scoring.seeded_dense(1, 6)()(((x - 0.5) / 2).reshape(50, 3, 30))
    assert {k: v[1] for k, v in got.items()} == dict(enumerate(want.argmax(axis=1)))
    assert [got[k][0] for k in range(50)] == pytest.approx(want.max(axis=1).tolist(), rel=1e-5)


# ------------------------------------------------------------- files and plans


def bam_bytes(contigs, rows):
    """An uncompressed BAM stream of coordinate-sorted rows of schema.READS."""
    names = [n for n, _ in contigs]
    text = b"@HD\tVN:1.6\tSO:coordinate\n"
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(contigs))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs]
    records = []
    for q, flag, chrom, pos, mapq, cigar, seq in rows:
        import re

        ops = [int(n) << 4 | bam.OPERATIONS.index(o) for n, o in re.findall(r"(\d+)(.)", cigar)]
        codes = [bam.PACKED_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body = struct.pack("<iiBBHHHiiii", names.index(chrom), pos - 1, len(q) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(seq)
        records.append(struct.pack("<i", len(body)) + body)
    return b"".join(out), records


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    """A folder with a FASTA file, its index, SAM and BAM of the same reads, and the sequences."""
    where = tmp_path_factory.mktemp("genome")
    draw = random.Random(6)
    seqs = {n: "".join(draw.choice("ACGT") for _ in range(size)) for n, size in (("chrA", 400), ("chrB", 150), ("chrC", 60))}
    seqs["chrB"] = seqs["chrB"][:50] + seqs["chrB"][50:60].lower() + seqs["chrB"][60:]
    with open(where / "ref.fa", "w") as f, open(where / "ref.fa.fai", "w") as g:
        at = 0
        for n, s in seqs.items():
            head = f">{n} text\n"
            f.write(head)
            at += len(head)
            g.write(f"{n}\t{len(s)}\t{at}\t60\t61\n")
            for k in range(0, len(s), 60):
                f.write(s[k : k + 60] + "\n")
                at += len(s[k : k + 60]) + 1
    rows = []
    for n in ("chrA", "chrB"):
        for k in range(1, len(seqs[n]) - 50):
            for copy in range(2):
                bases = list(seqs[n][k - 1 : k + 39].upper())
                if n == "chrA" and k <= 200 < k + 40 and (k + copy) % 2:
                    bases[200 - k] = {"A": "C", "C": "G", "G": "T", "T": "A"}[bases[200 - k]]
                rows.append((f"r{k}_{copy}", 99 if k % 2 else 83, n, k, 60, "40M", "".join(bases)))
    with open(where / "reads.sam", "w") as f:
        f.write("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chrA\tLN:400\n")
        f.writelines("\t".join((q, str(fl), c, str(p), str(m), cg, "*", "0", "0", s, "*")) + "\n" for q, fl, c, p, m, cg, s in rows)
    head, records = bam_bytes([(n, len(s)) for n, s in seqs.items()], rows)
    # blocks of some records each, and an index of a chunk a block
    blob, chunks = b"".join(blocks.packed([head])), {}
    for n in ("chrA", "chrB"):
        own = [r for r, x in zip(records, rows) if x[2] == n]
        for k in range(0, len(own), 50):
            begin = len(blob)
            blob += b"".join(blocks.packed([b"".join(own[k : k + 50])]))
            chunks.setdefault(n, []).append((begin << 16, len(blob) << 16))
    (where / "reads.bam").write_bytes(blob + blocks.END_OF_FILE)
    index = b"BAI\1" + struct.pack("<i", 3)
    for n in seqs:
        own = chunks.get(n, [])
        index += struct.pack("<iIi", 1, 4681, len(own)) + b"".join(struct.pack("<QQ", *c) for c in own) + struct.pack("<i", 0)
    (where / "reads.bam.bai").write_bytes(index)
    return where, seqs, rows


def test_fasta(spark, genome):
    where, seqs, _ = genome
    path = str(where / "ref.fa")
    want = [(n, len(s), k) for k, (n, s) in enumerate(seqs.items(), 1)]
    assert sorted(tuple(r)[:3] for r in fasta.read_fai(spark, f"{path}.fai").collect()) == want
    assert sorted(tuple(r) for r in fasta.fasta_contigs(spark, path).collect()) == want
    assert sorted(tuple(r) for r in fasta.fai_lines(spark, path).collect()) == sorted(tuple(r[:1] + r[1:2] + r[3:]) for r in (tuple(x) for x in fasta.read_fai(spark, f"{path}.fai").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")  # lines of many parts
    try:
        bases = {(r.chrom, r.pos): r.base for r in fasta.fasta_bases(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bases == {(n, k): b for n, s in seqs.items() for k, b in enumerate(s, 1)}


def rows_of(reader):
    return sorted(tuple(x.values()) for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist())


def test_sam_and_bam(spark, genome):
    where, _, rows = genome
    assert sorted(tuple(r) for r in sam.read_sam(spark, str(where / "reads.sam")).collect()) == sorted(rows)
    assert sam.sam_sort_order(spark, str(where / "reads.sam")) == "coordinate"
    bam.register(spark)
    path = str(where / "reads.bam")
    assert bam.sort_order(path) == "coordinate"
    reader = bam.BamReader(path, 2000)
    assert len(reader.partitions()) > 3
    assert rows_of(reader) == sorted(rows)
    df = spark.read.format("bam").option("range_bytes", 2000).load(path)
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    near = df.where("chrom in ('chrA', 'chrC') and pos >= 100 and pos < 130")
    assert sorted(tuple(r) for r in near.collect()) == sorted(r for r in rows if r[2] == "chrA" and 100 <= r[3] < 130)
    assert df.where("chrom = 'chrB'").count() == sum(r[2] == "chrB" for r in rows)
    assert df.where("chrom = 'chrC'").count() == 0


@pytest.mark.parametrize("range_bytes", [bam.RANGE_BYTES, 3000, 400])
def test_bam_without_index(genome, tmp_path, range_bytes):
    """Parted by bytes: each read is in one part, whatever block and place it begins in."""
    where, seqs, rows = genome
    (tmp_path / "x.bam").write_bytes((where / "reads.bam").read_bytes())
    head, records = bam_bytes([(n, len(s)) for n, s in seqs.items()], rows)
    text = head + b"".join(records)
    (tmp_path / "y.bam").write_bytes(b"".join(blocks.block(text[k : k + 1500]) for k in range(0, len(text), 1500)) + blocks.END_OF_FILE)  # reads across blocks
    for name in ("x.bam", "y.bam"):
        reader = bam.BamReader(str(tmp_path / name), range_bytes)
        assert rows_of(reader) == sorted(rows)
        assert len(reader.partitions()) > (1 if range_bytes < bam.RANGE_BYTES else 0)


def test_bins_of_the_index():
    assert [bam.bin_span(k) for k in (0, 1, 8, 9, 4681, 4682, 37448)] == [(0, 1 << 29), (0, 1 << 26), (7 << 26, 1 << 29), (0, 1 << 23), (0, 1 << 14), (1 << 14, 2 << 14), ((1 << 29) - (1 << 14), 1 << 29)]


def test_write_bam(spark, genome, tmp_path):
    where, seqs, rows = genome
    bam.register(spark)
    path = str(tmp_path / "out.bam")
    bam.write_bam(sam.read_sam(spark, str(where / "reads.sam")), [(n, len(s)) for n, s in seqs.items()], path)
    assert bam.sort_order(path) == "coordinate" and bam.read_header(path)[1] == [(n, len(s)) for n, s in seqs.items()]
    got = [tuple(r) for r in spark.read.format("bam").load(path).collect()]
    assert sorted(got) == sorted(rows)
    assert [n for n in sorted(x.name for x in tmp_path.iterdir())] == ["out.bam", "out.bam.bai"]


def test_reference_in_blocks(spark, genome):
    """Blocks of any length meet positions as single bases do, gaps and ends included."""
    where, seqs, _ = genome
    wanted = spark.createDataFrame([(n, p) for n, s in seqs.items() for p in (*range(1, len(s) + 1), len(s) + 1, 5000)], "chrom string, pos bigint")
    for cut in (1, 7, 60, 500):
        blocks = [(n, k + 1, s[k : k + cut]) for n, s in seqs.items() for k in range(0, len(s), cut) if n != "chrA" or k != cut]
        got = {(r.chrom, r.pos): r.base for r in candidates.bases_at(wanted, spark.createDataFrame(blocks, "chrom string, start bigint, seq string")).collect()}
        assert got == {(n, a + i): b for n, a, s in blocks for i, b in enumerate(s)}


def test_windows_over_bins(spark):
    columns = random_columns(3, 120)
    refs = refs_of(spark, {k: "A" for k in columns})
    numbered = encode.with_ordinals(encode.column_features(obs_of(spark, columns), refs, 1))
    sites = spark.createDataFrame([(c, p, k) for k, (c, p) in enumerate(sorted(columns)) if k % 5 == 0 or k in (52, 53)], "chrom string, pos bigint, k int")
    want = sorted(tuple(r) for r in encode.window_tensors(numbered, sites, 4, True).collect())
    for size in (1, 3, 16, 4096):
        assert sorted(tuple(r) for r in encode.window_tensors(numbered, sites, 4, window_bin=size).collect()) == want
    assert want


def test_tabix_lines(spark, tmp_path):
    rows = [(3, c, p, f"chr{c}\t{p}\t.\tA\tC") for c in (1, 2) for p in range(1, 60_000, 7)]
    path = str(tmp_path / "x.vcf.gz")
    vcf.write_vcf(spark.createDataFrame(rows, "section int, chrom_ord int, pos bigint, line string"), path)
    for _ in range(2):
        for c, a, z in (("chr1", 1, 100), ("chr2", 30_000, 30_500), ("chr2", 59_990, 99_999), ("chr3", 1, 9), ("chr1", 70_000, 80_000)):
            assert sorted(r.line for r in vcf.region_lines(spark, path, c, a, z).collect()) == sorted(line for _, n, p, line in rows if f"chr{n}" == c and a <= p <= z)
        vcf.write_tabix(path)  # of the finished file


def test_bed_file(spark, tmp_path):
    with gzip.open(tmp_path / "r.bed.gz", "wt") as f:
        f.write("# x\nchr1\t0\t5\n\nchr2\t3\t3\n")
    assert [tuple(r) for r in bed.read_bed(spark, str(tmp_path / "r.bed.gz")).collect()] == [("chr1", 1, 6)]


def test_whole_plan(spark, genome, tmp_path):
    where, seqs, _ = genome
    ref, contigs = fasta.fasta_bases(spark, str(where / "ref.fa")), fasta.fasta_contigs(spark, str(where / "ref.fa"))
    alignments = sam.read_sam(spark, str(where / "reads.sam"))
    config = CallerConfig(ploidy=4, window=3)
    scored = scored_sites(alignments, ref, contigs, config).collect()
    assert [(r.chrom, r.pos, r.kind, r.pred_label) for r in scored] == [("chrA", 200, "SNP", 2)]
    by_model = scored_sites(alignments, ref, contigs, config, make_predictor=scoring.seeded_dense(3, 4)).collect()
    assert [(r.chrom, r.pos) for r in by_model] == [("chrA", 200)]
    away = spark.createDataFrame([("chrA", 1, 200)], schema.REGIONS)
    assert scored_sites(alignments, ref, contigs, config, regions=away).count() == 0
    bam.register(spark)
    inside = spark.createDataFrame([("chrA", 190, 201), ("chrA", 195, 260)], schema.REGIONS)
    wide = regions.wide_regions(inside, margin=5)
    assert wide == [("chrA", 185, 265)] and regions.wide_regions(inside.union(away), margin=0, most=1) == [("chrA", 1, 260)] and regions.wide_regions(spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], schema.REGIONS), 0, 1) is None
    near = spark.read.format("bam").option("regions", json.dumps(wide)).load(str(where / "reads.bam"))
    assert [tuple(r) for r in scored_sites(alignments, ref, contigs, config, regions=inside, near=near).collect()] == [tuple(r) for r in scored] and near.count() < alignments.count()
    lines = call_variants(alignments, ref, contigs, config)
    path = str(tmp_path / "out.vcf.gz")
    vcf.write_vcf(lines, path)
    text = gzip.open(path, "rt").read().splitlines()
    assert text[0] == "##fileformat=VCFv4.2" and text[8:11] == [f"##contig=<ID={n},length={len(s)}>" for n, s in seqs.items()]
    record = text[-1].split("\t")
    assert len(text) == 13 and record[:2] == ["chrA", "200"] and record[9].split(":")[0] == "0/0/1/1"
    assert gzip.open(vcf.write_tabix(path), "rb").read()[:4] == b"TBI\1"
    only = call_variants(alignments, ref, contigs, CallerConfig(ploidy=4, contigs=("chrB", "chrB"))).collect()
    assert sum("##contig" in r.line for r in only) == 1 and not any(r.section == 3 for r in only)


def test_results_dont_depend_on_partitions(spark):
    columns = random_columns(7, 60)
    refs = {k: "ACGT"[k[1] % 4] for k in columns}
    seen = []
    for n in ("1", "8", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(tuple(r) for r in candidates.candidate_sites(obs_of(spark, columns), refs_of(spark, refs), 2, 0.1).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_config(spark, tmp_path):
    for wrong in ({"ploidy": 5}, {"min_af": 0}, {"min_af": 1}, {"rd_floor": 0}, {"mode": "x"}, {"species": "rose", "ploidy": 6}, {"window": -1}):
        with pytest.raises(ConfigError):
            CallerConfig(**wrong).checked()
    assert CallerConfig(ploidy=6).checked().chosen_species() == "sweetpotato"
    assert [parallelism(x, 8) for x in (-1, None, 4, 100)] == [8, 8, 4, 8]
    assert parallelism(-1, 64) == 24
    with pytest.raises(ConfigError):
        parallelism(0, 8)
    folder = tmp_path / "03_Samantha_Rose" / "01_speed_model_w=16"
    folder.mkdir(parents=True)
    assert model_folder(str(tmp_path), "rose", "speed") == (str(folder), 16)
    with pytest.raises(ConfigError):
        model_folder(str(tmp_path), "rose", "performance")
    contigs = spark.createDataFrame([("a", 5, 1), ("b", 5, 2)], schema.CONTIGS)
    assert checked_contigs(spark, contigs, None, ["b", "a", "b"]) == ("b", "a")
    with pytest.raises(ConfigError):
        checked_contigs(spark, contigs, None, ["a", "zz"])


def test_blocks_and_end_mark():
    text = b"line\n" * 40_000
    blob = b"".join(blocks.packed([text[:100_000], text[100_000:]])) + blocks.END_OF_FILE
    assert gzip.decompress(blob) == text


def test_command_line(spark, genome, tmp_path, monkeypatch):
    from ploidyflow import cli

    where, _, _ = genome
    (tmp_path / "r.bed").write_text("chrA\t150\t250\n")
    out = tmp_path / "calls.vcf"
    cli.main(["-r", str(where / "ref.fa"), "-b", str(where / "reads.bam"), "-p", "4", "-l", str(tmp_path / "r.bed"), "-o", str(out)])
    text = gzip.open(f"{out}.gz", "rt").read().splitlines()
    assert text[-1].startswith("chrA\t200\t") and (tmp_path / "calls.vcf.gz.tbi").exists()
    # a model folder by species and mode, its window and statistics, and the scored sites kept
    folder = tmp_path / "models" / "01_C88_Potato_default" / "02_performance_mode_w=3"
    folder.mkdir(parents=True)
    np.savez(folder / "statistics.npz", mean=np.full(210, 2.0), std=np.full(210, 4.0))
    (folder / "model.onnx").write_bytes(b"")
    seen = []

    def predictor(path):
        weights = np.zeros((210, 5))
        weights[:, 3] = 1e-3  # class 3 wherever the standardized entries are not all negative

        def make():
            assert path == str(folder / "model.onnx")
            return scoring.linear(weights)()

        seen.append(path)
        return make

    monkeypatch.setattr(cli, "model_predictor", predictor)
    cli.main(["-r", str(where / "ref.fa"), "-b", str(where / "reads.bam"), "-p", "4", "-m", "performance", "-t", "2", "--models", str(tmp_path / "models"), "--scored", str(tmp_path / "scored"), "-o", str(out)])
    kept = spark.read.parquet(str(tmp_path / "scored"))
    assert seen == [str(folder / "model.onnx")] and (tmp_path / "scored" / "chrom=chrA").is_dir()
    assert [(r.chrom, r.pos, r.pred_label) for r in kept.collect()] == [("chrA", 200, 3)]
    assert gzip.open(f"{out}.gz", "rt").read().splitlines()[-1].split("\t")[9].startswith("0/1/1/1:")
    with pytest.raises(SystemExit):
        cli.main(["-r", str(where / "ref.fa"), "-b", str(where / "reads.bam"), "-p", "4", "-s", "rose", "--models", str(tmp_path / "models")])
    with pytest.raises(ConfigError):
        model_files(str(tmp_path))
    for wrong in (["-r", "/none.fa", "-b", "x", "-p", "4"], ["-r", str(where / "ref.fa"), "-b", str(where / "reads.sam"), "-p", "4", "-c", "chrZ"], ["-r", str(where / "ref.fa"), "-b", str(where / "reads.sam"), "-p", "4", "--min_af", "2"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
