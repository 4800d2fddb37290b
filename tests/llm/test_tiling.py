import random

import numpy as np
import pytest

from ploidyflow.llm import tiling

from .cases import EDGES, documents, words


def plain_tiles(doc, item, least):
    """Greedy tiling straight from its definition."""
    free_d, free_i, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = None
        for i in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while i + n < len(item) and a + n < len(doc) and item[i + n] == doc[a + n] and free_i[i + n] and free_d[a + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, a)
        if best is None:
            return total
        n, i, a = best
        free_i[i : i + n] = [False] * n
        free_d[a : a + n] = [False] * n
        total += n


@pytest.mark.parametrize("broadcast_ids", [tiling.BROADCAST_IDS, 0])
def test_against_plain_tiling(spark, broadcast_ids):
    draw = random.Random(2)
    items = [(k, " ".join(words(f"i{k}", draw.randint(6, 30), 60))) for k in range(8)] + [(90, None), (91, ""), (92, "too few"), (93, "")]
    rows = [(i, t) for i, t in EDGES if i != 905]
    for i in range(40):
        body = words(i, 25, 3000)
        item = dict(items)[draw.randrange(8)].split()
        cut = draw.randint(0, len(item))
        for part in draw.choice(([item], [item[cut:], item[:cut]], [item[:cut]])):
            at = draw.randint(0, len(body))
            body[at:at] = part
        rows.append((i, " ".join(body).upper() if i % 4 == 0 else ", ".join(body)))
    got = sorted(tuple(r) for r in tiling.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), coverage=0.5, broadcast_ids=broadcast_ids).collect())
    want = []
    for i, t in rows:
        doc = (t or "").lower().replace(",", " ").split()
        for k, x in items:
            item = (x or "").split()
            if len(item) >= 5 and (n := plain_tiles(doc, item, 5)) >= 0.5 * len(item):
                want.append((i, k, n, len(item), n / len(item)))
    assert got == sorted(want)
    assert len(want) > 20


def test_seeds_that_all_items_and_documents_have(spark):
    """Items and documents that share most of their seeds: those left out of the join lose no match."""
    common = words("common", 24, 10_000)
    draw = random.Random(7)
    items = [(k, " ".join([*words(f"own{k}", draw.choice((0, 2, 6)), 10_000), *common[: draw.choice((12, 24))], *words(f"end{k}", draw.choice((0, 3)), 10_000)])) for k in range(12)]
    rows = []
    for i in range(60):
        body = words(i, 20, 3000) + common[: draw.choice((8, 16, 24))] + words(i + 100, 5, 3000)
        if i % 3 == 0:
            body += dict(items)[draw.randrange(12)].split()
        rows.append((i, " ".join(body)))
    got = sorted((r.doc_id, r.item_id, r.n_matched) for r in tiling.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    want = sorted((i, k, n) for i, t in rows for k, x in items if (n := plain_tiles(t.split(), x.split(), 5)) >= 0.8 * len(x.split()))
    assert got == want and len(want) > 30


def test_filter_lets_every_key_through(spark):
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 1 << 63, 5000) * 2 + draw.integers(0, 2, 5000)
    made = tiling.key_filter(spark.createDataFrame([(int(x),) for x in keys.astype(np.int64)], "key bigint"))
    assert made.has(keys.astype(np.int64).view(np.uint64)).all()
    assert made.has(draw.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def test_items_shorter_than_a_seed(spark):
    items = [(1, "one"), (2, "two words"), (3, "now three words"), (4, "four words are here"), (5, "!!"), (6, "five words are in this")]
    rows = [(10, "x Two, WORDS y two words"), (11, "words two"), (12, "four words are here"), (13, "now three words one"), (14, "two"), (15, "z five words are in this"), (16, None)]
    got = sorted((r.doc_id, r.item_id, r.n_matched, r.n_words) for r in tiling.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == [(10, 2, 2, 2), (12, 4, 4, 4), (13, 1, 1, 1), (13, 3, 3, 3), (15, 6, 5, 5)]


def test_reordered_passage_and_long_text(spark):
    item = words("item", 40, 10_000)
    body = words(1, 3000, 10_000)
    shuffled = body[:500] + item[20:] + body[500:2000] + item[:20] + body[2000:]
    got = tiling.leaks(documents(spark, [(1, " ".join(shuffled)), (2, " ".join(body)), (2, " ".join(item)), (2, " ".join(item))]), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item))], "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got.collect()) == [(1, 7, 1.0), (1, 8, 1.0), (2, 7, 1.0), (2, 7, 1.0), (2, 8, 1.0), (2, 8, 1.0)]


def test_long_text_of_one_word(spark):
    """A text that repeats a word has a pair of seeds for every place of the item; the runs are found in bounded memory."""
    items = [(1, "zero " * 200), (2, "zero one " * 40), (3, "zero " * 30 + " ".join(words("end", 10, 1000)))]
    rows = [(1, "zero " * 60_000), (2, "zero one " * 30_000), (3, "zero " * 3000 + " ".join(words("end", 10, 1000)))]
    got = sorted((r.doc_id, r.item_id, r.n_matched) for r in tiling.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == [(1, 1, 200), (2, 2, 80), (3, 1, 200), (3, 3, 40)]


def test_runs_against_all_pairs():
    draw = np.random.default_rng(5)
    for _ in range(200):
        n_doc, n_item, letters = draw.integers(5, 60), draw.integers(5, 30), draw.integers(1, 5)
        doc, item = (draw.integers(0, letters, n).astype(np.uint64) for n in (n_doc, n_item))
        have, want = tiling.seed_hashes(doc, 3), tiling.seed_hashes(item, 3)
        order = np.argsort(have, kind="stable")
        first, last = (np.searchsorted(have[order], want, side) for side in ("left", "right"))
        runs = tiling.shared_runs(have, order, first, last - first, want, most=int(draw.integers(1, 50)))
        assert tiling.tiled_words(*runs, 3, len(item), len(doc)) == plain_tiles(doc.tolist(), item.tolist(), 3)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert tiling.leaks(documents(spark, EDGES), none).count() == 0
    assert tiling.leaks(documents(spark, []), some).count() == 0
