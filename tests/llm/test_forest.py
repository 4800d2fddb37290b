import numpy as np
import pytest

from ploidyflow.llm import prefix_forest

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def brute(rows, every, k):
    usable = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None:
            usable.setdefault(len(v), {})[i] = np.array(v, np.float32).astype(float)
    out = {}
    for group in usable.values():
        for q, x in group.items():
            if q % every == 0:
                near = [(-float(x @ y / np.sqrt((x @ x) * (y @ y))), i) for i, y in group.items() if i != q]
                out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    return [(i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]


def test_recall(spark, vectors):
    want = brute(vectors, 50, 5)
    got = {}
    for r in prefix_forest.nearest(spark.createDataFrame([(i, v, 0, 0.5) for i, v in vectors], SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    vector = dict(vectors)
    for q, found in got.items():
        for i, s in found:
            x, y = (np.array(vector[j], np.float32).astype(float) for j in (q, i))
            assert s == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-12)


def test_parts_change_nothing(spark, vectors):
    df = spark.createDataFrame([(i, v, 0, 0.5) for i, v in vectors[:600]], SCHEMA)
    one, many = (sorted(tuple(r) for r in prefix_forest.nearest(df, part_rows=n).collect()) for n in (1 << 15, 16))
    assert one == many


def test_candidates_needn_t_grow_with_clustered_vectors(spark):
    """The same number of candidates a query serves four times the rows, and is far fewer than all."""
    for rows in (4000, 16000):
        draw = np.random.default_rng(rows)
        centres = draw.normal(size=(rows // 20, 24))
        x = (centres[np.arange(rows) % len(centres)] + 0.15 * draw.normal(size=(rows, 24))).astype(np.float32)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        asked = np.arange(0, rows, 50)
        near = unit[asked] @ unit.T
        near[np.arange(len(asked)), asked] = -2
        want = {int(q): set(np.argsort(-near[i])[:5].tolist()) for i, q in enumerate(asked)}
        got = {}
        for r in prefix_forest.nearest(spark.createDataFrame([(i, v.tolist(), 0, 0.5) for i, v in enumerate(x)], SCHEMA), candidates=400).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.9


def test_small_tables_are_searched_whole(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    want = brute(rows, 10, 5)
    got = {}
    for r in prefix_forest.nearest(spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows], SCHEMA), query_every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in x] for q, x in want.items()}


def test_edges_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (50, [0.5, 0.5]), (51, [1.0, 0.0, 0.0]), (50, [0.5, 0.5]), (None, [1.0, 1.0])]
    got = sorted(tuple(r) for r in prefix_forest.nearest(spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows], SCHEMA)).collect())
    half = 1 / np.sqrt(2)
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert [x[3] for x in got] == pytest.approx([1, 1, half, half, half, half])


def test_one_value_fills_a_leaf(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1000)]
    got = [tuple(r)[:3] for r in prefix_forest.nearest(spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows], SCHEMA), query_every=500, part_rows=64).orderBy("query_id", "rank").collect()]
    assert got == [(0, r, r) for r in range(1, 6)] + [(500, r, r - 1) for r in range(1, 6)]


def test_empty(spark):
    assert prefix_forest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ascent_is_in_step():
    """Every leaf taken matches at least as long as any left: but for one letter, by which trees ascend one after another; and no more is taken than the share asks for."""
    draw = np.random.default_rng(12)
    x = draw.normal(size=(4000, 24))
    letters = prefix_forest.projected(x, 5)
    strings = prefix_forest.hash_strings(letters)
    forest = prefix_forest.Leaves(strings, len(x))
    asked = letters[:60]
    homes = np.stack([forest.leaf(t, strings[:60, t]) for t in range(5)], axis=1)
    for share in (0.02, 0.2, 0.6):
        taken = {(q, t): set() for q in range(60) for t in range(5)}
        for q, t, leaf in forest.ascended(asked, share):
            for a, b, c in zip(q.tolist(), t.tolist(), leaf.tolist(), strict=True):
                taken[a, b].add(c)
        match = [forest.matched(asked, t) for t in range(5)]
        for q in range(60):
            inside = [min(match[t][q][list(taken[q, t])]) for t in range(5)]
            outside = [max((m for k, m in enumerate(match[t][q].tolist()) if k not in taken[q, t]), default=-1) for t in range(5)]
            assert all(homes[q, t] in taken[q, t] for t in range(5)) and max(outside) <= min(inside)
            missed = np.prod([1 - forest.share[t][list(taken[q, t])].sum() for t in range(5)])
            assert 1 - missed >= share - 1e-9
