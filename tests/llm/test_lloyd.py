import hashlib
import math
import random

import numpy as np
import pytest

from ploidyflow.llm import delta_lloyd

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error double"


def table(spark, rows):
    """rows: (vec_id, vector, label); two columns clash with names of results."""
    return spark.createDataFrame([(i, v, k, "x", 0.5) for i, v, k in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    """The rounds straight from their definition, over all vectors each time."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    ids = sorted({i for i, *_ in kept}, key=lambda i: (i is None, i or 0))[:entries]
    seeds = [min(v for j, v, _ in kept if j == i) for i in ids]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]

    def assigned(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[assigned(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(seeds)):
                own = [cut(v, p) for (_, v, _), codes in zip(kept, found, strict=True) if codes[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = [[assigned(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in x) for x in final]
    by = {k: sum(e for e, (_, _, j) in zip(errors, kept, strict=True) if j == k) for _, _, k in kept}
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in x), err, by[k], sha) for (i, _, k), x, err in zip(kept, final, errors, strict=True)]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def made(spark, rows, **options):
    return sorted((tuple(r) for r in delta_lloyd.vector_codes(table(spark, rows), **options).collect()), key=key)


def vectors(seed, n, dim=16, centres=20):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i * 3, [x + draw.gauss(0, 0.2) for x in middle[draw.randrange(centres)]], draw.choice([None, 1, 1, 1, 2, 3, i])) for i in range(n)]


def test_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr("ploidyflow.llm.common.BATCH_ROWS", 40)
    rows = vectors(1, 400)
    rows += [(5000, None, 1), (5001, [0.5] * 15 + [None], 1), (5002, [0.5] * 15 + [math.nan], 2), (5003, [math.inf] + [0.5] * 15, 2)]
    rows += [(None, [0.25] * 16, None), (None, [0.25] * 16, 7), rows[0], rows[0], (0, [-3.0] * 16, 1), (3, rows[1][1], 9)]
    want = sorted(plain(rows), key=key)
    assert made(spark, rows) == want and len(want) == 406
    assert len({r[1] for r in want}) > 30


def test_ties_and_equal_vectors(spark):
    rows = [(k, [0.125 * (k % 3)] * 8, k % 2) for k in range(40)]
    assert made(spark, rows) == sorted(plain(rows), key=key)
    rows = [(7, [1.0] * 8, None)] * 5
    assert made(spark, rows) == sorted(plain(rows), key=key)
    few = vectors(2, 5, dim=8)
    assert made(spark, few, entries=3, rounds=2) == sorted(plain(few, entries=3, rounds=2), key=key)
    nameless = [(None, [float(k)] * 8, 1) for k in range(3)]
    assert made(spark, nameless) == sorted(plain(nameless), key=key)


def test_nothing_and_errors(spark):
    assert made(spark, []) == made(spark, [(1, None, 2), (2, [None] * 8, 2)]) == []
    with pytest.raises(ValueError, match="don't divide"):
        made(spark, [(1, [1.0] * 9, 2)])
    with pytest.raises(Exception, match="must all have 8"):
        made(spark, [(1, [1.0] * 8, 2), (2, [1.0] * 16, 2)])
    with pytest.raises(Exception, match="must be within"):
        made(spark, [(1, [1e30] * 8, 2)])


def test_labels_by_shuffle_and_broadcast(spark):
    """A label of a third of all rows, many of one row, and null, whichever way they are met."""
    rows = [(k, str(k % 40) if k % 3 else None if k % 2 else "hot", "0a", k) for k in range(300)]
    coded = delta_lloyd.written(spark.createDataFrame(rows, "vec_id bigint, label string, code string, error bigint"), "coded")
    want = sorted((i, sum(e for _, k, _, e in rows if k == label)) for i, label, _, _ in rows)
    for share in (1, 10, 1024):
        got = delta_lloyd.with_label_error(coded, share)
        assert sorted((r.vec_id, r.label_error) for r in got.collect()) == want


def test_only_changes_are_exchanged(spark):
    """Vectors meet their assignments bucket by bucket; a round returns sums of the parts that moved, which are what the sums change by."""
    draw = np.random.default_rng(4)
    x = draw.integers(-50, 50, (100, 4, 3))
    books = draw.integers(-50, 50, (4, 5, 3))
    old, new = delta_lloyd.nearest(x, books)[0], delta_lloyd.nearest(x, books + draw.integers(-9, 9, books.shape))[0]
    assert (old != new).any() and (old == new).any()
    moved = delta_lloyd.contributions(x, new, old, 5)
    assert (delta_lloyd.contributions(x, old, None, 5) + moved == delta_lloyd.contributions(x, new, None, 5)).all()
    assert not delta_lloyd.contributions(x, old, old, 5).any()
    tables = delta_lloyd._Bucketed(spark, 4)
    blocks = spark.range(20).select(delta_lloyd.F.col("id").alias("block"), delta_lloyd.F.lit(b"\0" * 48).alias("x"))
    vectors_ = tables.write(blocks.repartition(4, "block"), "vectors")
    before = tables.write(delta_lloyd._round(vectors_, None, books), "codes0").where("codes is not null").select("block", "codes")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = delta_lloyd._round(vectors_, before, books)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for name in ("codes0", "vectors"):
        tables.drop(name)
