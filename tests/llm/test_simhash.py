import random

import numpy as np
import pytest
import xxhash

from ploidyflow.llm import simhash

from .cases import EDGES, documents, words


def fingerprint(t, n):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)), {*shingles}


def grouped(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_texts(n, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(i % 12, 120, 900)
        for _ in range(draw.choice((0, 0, 1, 2, 5))):
            w[draw.randrange(len(w))] = f"edit{draw.randrange(999)}"
        rows.append((i, " ".join(w) if i % 5 else " ".join(w).upper()))
    return rows


@pytest.mark.parametrize("most", [simhash.SWEEP_ROWS, 1])
def test_components_against_brute_force(spark, most):
    rows = near_texts(120) + EDGES
    made = [(i, fingerprint(t, 3)[0]) for i, t in rows]
    by_id = dict(made)
    want = grouped(by_id, [(a, b) for a, x in by_id.items() for b, y in by_id.items() if a < b and (x ^ y).bit_count() <= 2])
    got = sorted(tuple(r) for r in simhash.simhash_components(documents(spark, rows), sweep_rows=most).collect())
    assert got == sorted((i, f"{f:016x}", want[i]) for i, f in made)


def test_random_fingerprints_lose_no_link(spark):
    draw = random.Random(1)
    fps = {draw.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2}
    for most in (4096, 1):
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_links(nodes, sweep_rows=most).collect()}
        if most > 1:
            assert got == want
        assert grouped(range(len(fps)), got) == grouped(range(len(fps)), want)


@pytest.mark.parametrize("radius", [0, 1])
def test_smaller_radius_loses_no_link_of_full_buckets(spark, radius):
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        fps |= {f ^ (1 << draw.randrange(64)), f ^ (1 << 63), f ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= radius}
    for most in (4096, 1):
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_links(nodes, radius, most).collect()} == want


def test_empty(spark):
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_more_rows_than_a_sweep_takes(spark):
    """One bucket of 2,600 fingerprints, over SWEEP_ROWS: no link is lost, by either radius."""
    draw = random.Random(11)
    low = draw.getrandbits(64)
    fps = sorted({low ^ (draw.getrandbits(30) & draw.getrandbits(30) & draw.getrandbits(30)) for _ in range(2600)})
    assert len(fps) > simhash.SWEEP_ROWS
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    have = np.array(fps, np.uint64)
    for radius in (1, 2):
        apart = np.bitwise_count(have[:, None] ^ have[None, :])
        i, j = np.nonzero((apart <= radius) & (np.arange(len(have))[:, None] < np.arange(len(have))[None, :]))
        got = [(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_links(nodes, radius).collect()]
        assert grouped(range(len(fps)), got) == grouped(range(len(fps)), list(zip(i.tolist(), j.tolist(), strict=True)))
        assert all(apart[a, b] <= radius or radius == 2 for a, b in got)


def test_pivots_bound_distance():
    a, b = (np.random.default_rng(k).integers(0, 1 << 63, 500).astype(np.uint64) for k in (1, 2))
    apart = np.abs(simhash.pivot_table(a).astype(int) - simhash.pivot_table(b).astype(int)).max(axis=1)
    assert (apart <= np.bitwise_count(a ^ b)).all()
