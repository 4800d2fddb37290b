import random

import pytest
from pyspark.sql import functions as F

from ploidyflow import schema
from ploidyflow.config import CallerConfig
from ploidyflow.operators import admission
from ploidyflow.plans.calling import scored_sites


def span(cigar):
    return {"10M": 10, "5M4D5M": 14, "3M900N7M": 910, "10S": 1, "*": 1}[cigar]


def plain(rows, most):
    """The rule read by read: the first of a position enters, a later one while fewer than the cap are open."""
    out = []
    for chrom in sorted({r[2] for r in rows}):
        inside, at = [], None
        for r in sorted((r for r in rows if r[2] == chrom), key=lambda r: (r[3], r[0], r[1], r[5])):
            new, at = r[3] != at, r[3]
            inside = [x for x in inside if x[3] + span(x[5]) >= at]
            if new or len(inside) < most:
                inside.append(r)
                out.append(r)
    return sorted(out)


def made(seed, n, places):
    draw = random.Random(seed)
    return [(f"r{k}", draw.choice((0, 16)), draw.choice("cccd"), draw.choice((draw.randrange(1, places), 50, 51, 70, 16_384)), 60, draw.choice(("10M", "10M", "5M4D5M", "3M900N7M", "10S", "*")), "A" * 10) for k in range(n)]


@pytest.mark.parametrize("most", [1, 4, 30, 1000])
def test_against_plain_rule(spark, most):
    """Deep places apart and together, gaps that hold reads open over bins, and places below the cap."""
    for seed, n, places in ((1, 600, 200), (2, 400, 40_000)):
        rows = made(seed, n, places)
        df = spark.createDataFrame(rows, schema.READS)
        assert sorted(tuple(r) for r in admission.admitted(df, most).collect()) == plain(rows, most)
    assert most > 30 or len(plain(rows, most)) < len(rows)


def test_no_cap_and_no_reads(spark):
    df = spark.createDataFrame(made(3, 20, 9), schema.READS)
    assert admission.admitted(df, None) is df and admission.admitted(df.limit(0), 3).count() == 0


def test_cap_of_a_call(spark):
    """What is over the cap has no part in depth and counts of alleles."""
    rows = [(f"a{k:03d}", 0, "c", 10, 60, "10M", "ACGTACGTAC") for k in range(40)] + [(f"b{k:03d}", 0, "c", 10, 60, "10M", "ACGTTCGTAC") for k in range(40)]
    ref = spark.createDataFrame([("c", 9 + k, "ACGTACGTACGT"[k - 1]) for k in range(1, 13)], "chrom string, pos bigint, base string")
    contigs = spark.createDataFrame([("c", 50, 1)], schema.CONTIGS)
    got = {}
    for most in (None, 50):
        found = scored_sites(spark.createDataFrame(rows, schema.READS), ref, contigs, CallerConfig(ploidy=4, max_depth=most)).collect()
        got[most] = [(r.pos, r.rd, r.alt_num) for r in found]
    assert got == {None: [(14, 80, 40)], 50: [(14, 50, 10)]}


def watched(monkeypatch):
    """Small bins; how many files with rows each pass over them leaves, and which of the passes are whole sequences."""
    files, whole, put, decider = [], [], admission.written, admission._decider

    def spy(df, name):
        out = put(df, name)
        if name == "decided":
            files.append(out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(admission, "BIN", 64)
    monkeypatch.setattr(admission, "written", spy)
    monkeypatch.setattr(admission, "_decider", lambda most, size, one: whole.append(one) or decider(most, size, one))
    return files, whole


def test_a_deep_contig_is_many_tasks(spark, monkeypatch):
    """Over the cap from end to end, with gaps that hold reads open over bins: decided bin by bin, and dealt by position."""
    files, whole = watched(monkeypatch)
    draw = random.Random(7)
    rows = [(f"r{draw.random()}", 0, "c", 1 + k // 3, 60, draw.choices(("10M", "5M4D5M", "10S", "3M900N7M"), (50, 30, 20, 0.1))[0], "A" * 10) for k in range(4500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = admission.admitted(spark.createDataFrame(rows, schema.READS), 13)
        assert sorted(tuple(r)[:7] for r in got.collect()) == plain(rows, 13)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < sum(sizes) / 2
    assert min(files[:2]) > 1 and not any(whole)


def test_a_begin_that_is_never_forgotten(spark, monkeypatch):
    """Equal reads at every place: what was open at a bin's begin matters for ever, so the bins are one sequence in the end."""
    _, whole = watched(monkeypatch)
    rows = [(f"r{k}", 0, c, k // 4 + (1 if c == "c" else 30), 60, "10M", "A" * 10) for c in "cd" for k in range(3600)]
    assert sorted(tuple(r) for r in admission.admitted(spark.createDataFrame(rows, schema.READS), 25).collect()) == plain(rows, 25)
    assert whole == [False] * admission.ROUNDS + [True]
