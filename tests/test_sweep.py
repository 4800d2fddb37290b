"""The pass over bins against the operators that are one DataFrame step each, and scans against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ploidyflow import schema
from ploidyflow.operators import candidates, encode, pileup, regions, scan, sweep
from ploidyflow.store import written

from .test_calling import obs_of, random_columns, refs_of


def random_reads(seed, n=150):
    """Reads of every operation, some across bins, with soft clips, gaps and missing sequences."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        ops, bases = [], 0
        for o in draw.choices("MIDNS=XHP", weights=(8, 3, 3, 1, 1, 2, 2, 1, 1), k=draw.randrange(1, 7)):
            size = draw.choice((0, 1, 2, 5, 11)) if o != "M" else draw.randrange(1, 30)
            ops.append(f"{size}{o}")
            bases += size * (o in "MIS=X")
        seq = "".join(draw.choices("ACGTNacgt", k=bases)) if draw.random() < 0.95 else draw.choice(("*", "A", ""))
        rows.append((f"r{k}", draw.choice((99, 83, 147, 0, 16)), draw.choice("cd"), draw.randrange(1, 300), draw.randrange(5, 61), "".join(ops), seq))
    return [*rows, ("s", 0, "c", 5, 60, "*", "A"), ("t", 0, "c", 7, 60, None, None), ("u", 16, "c", 1, 7, "3M", None)]


@pytest.mark.parametrize("size", [sweep.BIN, 40, 7])
def test_folded_reads_against_observations(spark, size):
    reads = spark.createDataFrame(random_reads(size), schema.READS)
    want = encode.strand_tokens(pileup.observations(reads.fillna({"seq": ""}))).select("chrom", "pos", "strand", "token", "n", "mq")
    got = sweep.read_tokens(reads, size).groupBy("chrom", "pos", "strand", "token").agg(F.sum("n").alias("n"), F.sum("mq").alias("mq"))
    got = sorted(tuple(r) for r in got.collect())
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 500
    assert sweep.read_tokens(reads.limit(0), size).count() == 0


def test_reads_are_exchanged_once(spark):
    reads = spark.createDataFrame(random_reads(1), schema.READS)
    plan = sweep.read_tokens(reads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate explode" in plan.split("Exchange ")[1]


def tables(spark, seed, n=80):
    columns = random_columns(seed, n)
    draw = random.Random(seed)
    bases = {("c", p): draw.choice("ACGTACGTaN") for p in range(1, 4 * n) if draw.random() < 0.9}
    return obs_of(spark, columns), refs_of(spark, bases), columns


@pytest.mark.parametrize(("seed", "size", "kw"), [(1, sweep.BIN, {}), (2, 32, {"acgt_only": True}), (3, 8, {"uppercase": True, "max_indel": 2}), (4, 100, {"min_af": 0.4})])
def test_candidates_and_features(spark, seed, size, kw):
    obs, refs, _ = tables(spark, seed)
    swept = sweep.swept(encode.strand_tokens(obs), refs, depth=9, least=2, every=True, size=size, **kw).cache()
    want = candidates.candidate_sites(obs, refs, 2, kw.get("min_af", 0.1), kw.get("max_indel", 20), kw.get("uppercase", False), kw.get("acgt_only", False))
    got = sorted(tuple(r) for r in sweep.sites_of(swept).collect())
    assert got == sorted(tuple(r) for r in want.select(*sweep.SITE).collect()) and got
    features = encode.column_features(obs, refs, 9, kw.get("uppercase", False))
    assert sorted(tuple(r) for r in sweep.featured_columns(swept).select(*features.columns).collect()) == sorted(tuple(r) for r in features.collect())
    numbers = encode.with_ordinals(features)
    assert sorted(tuple(r) for r in sweep.numbered(written(swept, "t")).select("pos", "ord", "n_cols").collect()) == sorted(tuple(r) for r in numbers.select("pos", "ord", "n_cols").collect())
    assert swept.agg(F.sum("n_cols")).first()[0] == features.count()


def test_reference_in_blocks_and_parts_that_add_up(spark):
    obs, _, columns = tables(spark, 5)
    draw = random.Random(5)
    text = "".join(draw.choices("ACGTa", k=400))
    single = refs_of(spark, {("c", k): b for k, b in enumerate(text, 1) if not 61 <= k < 91})
    whole = spark.createDataFrame([("c", k + 1, text[k : k + 30]) for k in range(0, 400, 30) if k != 60] + [("c", 500, "")], "chrom string, start bigint, seq string")
    tokens = encode.strand_tokens(obs).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", F.floor(F.col("n") / 2)).select("chrom", "pos", "strand", "token", F.when(F.col("part") == 0, F.col("half")).otherwise(F.col("n") - F.col("half")).alias("n"), F.when(F.col("part") == 0, F.col("mq")).otherwise(0).alias("mq"))
    for size in (16, sweep.BIN):
        got = sorted(tuple(r) for r in sweep.sites_of(sweep.swept(tokens, whole, least=2, size=size)).collect())
        assert got == sorted(tuple(r) for r in sweep.sites_of(sweep.swept(encode.strand_tokens(obs), single, least=2, size=size)).collect()) and got


def test_regions(spark):
    obs, refs, columns = tables(spark, 6)
    spans = spark.createDataFrame([("c", 10, 31), ("c", 20, 25), ("c", 64, 65), ("c", 150, 10_000), ("z", 1, 9)], schema.REGIONS)
    tokens = encode.strand_tokens(obs)
    want = sorted(tuple(r) for r in regions.within_regions(sweep.sites_of(sweep.swept(tokens, refs, least=1)), spans).collect())
    for size in (16, sweep.BIN):
        assert sorted(tuple(r) for r in sweep.sites_of(sweep.swept(tokens, refs, least=1, size=size, regions=spans)).collect()) == want
    assert want and sweep.sites_of(sweep.swept(tokens, refs, least=1, regions=spans.limit(0))).count() == 0


@pytest.mark.parametrize("size", [sweep.BIN, 64, 5])
def test_windows(spark, size):
    """Windows within a bin, across one edge and across many."""
    obs, refs, _ = tables(spark, 7, 120)
    numbers = encode.with_ordinals(encode.column_features(obs, refs, 3))
    sites = candidates.candidate_sites(obs, refs, 2, 0.3)
    for window in (0, 1, 6):
        table = written(sweep.swept(encode.strand_tokens(obs), refs, depth=3, least=2, min_af=0.3, window=window, size=size), "t")
        want = sorted((r.pos, r.alt, tuple(r.x)) for r in encode.window_tensors(numbers, sites, window).collect())
        for edge_bin in (sweep.EDGE_BIN, 9):
            assert sorted((r.pos, r.alt, tuple(r.x)) for r in sweep.windows_of(table, window, edge_bin).collect()) == want
        assert want and all(len(x) == 30 * (2 * window + 1) for *_, x in want)


def test_features_only_around_candidates(spark):
    """Of 3,000 columns with one candidate those of its window have features, and the edges of their bin."""
    columns = {("c", p): [("A", 99, 60)] * 4 for p in range(10, 3010)} | {("c", 1500): [("A", 99, 60), ("C", 83, 60)]}
    refs = refs_of(spark, {k: "A" for k in columns})
    table = written(sweep.swept(encode.strand_tokens(obs_of(spark, columns)), refs, least=1, window=4), "t")
    assert table.where("f is not null").count() == 18 and table.where("x is not null").count() == 1 and table.count() == 20


def test_exchanges_of_windows(spark):
    obs, refs, _ = tables(spark, 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = sweep.swept(encode.strand_tokens(obs), refs, least=2, window=2)
        plans = [first, sweep.windows_of(written(first, "t"), 2)]
        counts = [p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for p in plans]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert counts[0] == 2 and sum(counts) <= 5


def plain_merge(spans):
    out = []
    for chrom, a, z in sorted(spans):
        if out and out[-1][0] == chrom and a <= out[-1][2]:
            out[-1] = (chrom, out[-1][1], max(out[-1][2], z))
        else:
            out.append((chrom, a, z))
    return out


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_merge_over_parts(spark, parts):
    """Intervals that reach over many parts, that touch, that repeat, and contigs of one."""
    draw = random.Random(int(parts))
    spans = [(draw.choice(("a", "b", "b", "b", "c")), a, a + draw.choice((1, 1, 3, 40, 5000))) for a in (draw.randrange(20_000) for _ in range(900))]
    spans += [("d", 5, 6), ("b", 100, 15_000), spans[0], spans[0]] + [("e", k, k + 1) for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(spans, schema.REGIONS)
        islands = scan.merged_in_parts(df)
        got = sorted(tuple(r) for r in scan.joined_parts(islands).collect())
        assert islands.select("part").distinct().count() == int(parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == plain_merge(spans)
    assert regions.merge_intervals(df.limit(0)).count() == 0


@pytest.mark.parametrize("bin_columns", [1, 7, sweep.EDGE_BIN])
def test_framed_sums(spark, bin_columns):
    """Sums over neighbours in bins of any size, contigs' ends and short contigs included."""
    values = {"a": [k * 7 % 11 for k in range(60)], "b": [5], "c": [1, 2, 3]}
    df = spark.createDataFrame([(c, k * 3, k, v) for c, own in values.items() for k, v in enumerate(own, 1)], "chrom string, pos bigint, ord bigint, v bigint")
    for window in (0, 1, 9):
        got = {(r.chrom, r.ord): r.x for r in sweep.framed(df, window, "x", F.sum("v"), bin_columns).collect()}
        assert got == {(c, k): sum(own[max(k - 1 - window, 0) : k + window]) for c, own in values.items() for k in range(1, len(own) + 1)}


def test_depth_of_swept_columns(spark):
    obs, refs, columns = tables(spark, 9)
    got = {r.pos: r.rd for r in sweep.swept(encode.strand_tokens(obs), refs, every=True, featured=False).where("pos is not null").collect()}
    assert got == {r.pos: r.rd for r in pileup.pileup_columns(obs, refs).collect()}
