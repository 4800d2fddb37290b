import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ploidyflow.llm import max_tree

from .cases import EDGES, documents, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda x: x[0].lower(), x) for x in TERM.findall(text or "")]


def plain(rows, items, k=10):
    """Every document's score for every item."""
    docs = [(i, Counter(terms(t))) for i, t in rows if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=key)


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def found(spark, rows, items, **sizes):
    extra = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id bigint, text string, score double")
    return sorted((tuple(r) for r in max_tree.ranked(documents(spark, rows), extra, **sizes).collect()), key=key)


ITEMS = [(1, " ".join(words("q", 12, 60))), (2, "W3X w3x, w7x;w7x unheard"), (3, None), (4, "!! --"), (5, "unheard of words"), (None, "w5x"), (6, "w5x"), (6, "w9x w9x w1x"), (7, "é日本 word123 one"), (8, "w1x " * 50)]


@pytest.mark.parametrize("sizes", [{}, {"range_docs": 40, "block_terms": 5, "broadcast_terms": 0}, {"range_docs": 1, "range_postings": 1}])
def test_against_all_scores(spark, sizes):
    """Ties by the hundred, repeated documents and items, terms in every document and in one."""
    draw = random.Random(4)
    rows = [(i, " ".join(words(f"d{i}", draw.choice((1, 2, 5, 40)), draw.choice((3, 12, 60))))) for i in range(300)]
    rows += [(i, " ".join(words("same", 5, 12))) for i in range(2000, 2100)]
    draw.shuffle(rows)
    rows += [*EDGES, rows[0], rows[0], (None, "w1x w5x")]
    want = plain(rows, ITEMS)
    assert found(spark, rows, ITEMS, **sizes) == want
    assert len(want) > 60 and any(a[3] == b[3] for a, b in zip(want, want[1:], strict=False))
    assert found(spark, rows, ITEMS[:2], k=3, **sizes) == plain(rows, ITEMS[:2], 3)


def test_empty(spark):
    assert found(spark, [], ITEMS) == found(spark, [(1, None), (2, "..")], ITEMS) == found(spark, EDGES[:4], []) == found(spark, EDGES[:4], [(1, None)]) == []
    assert found(spark, EDGES[:4], [(1, "unheard")]) == []


def tree(seed, n, vocabulary):
    draw = np.random.default_rng(seed)
    counts = draw.poisson(draw.gamma(0.3, 2.0, (n, 1)) * draw.gamma(0.5, 1.0, (1, vocabulary)))
    counts = counts[counts.sum(axis=1) > 0]
    counts = counts[:, counts.sum(axis=0) > 0]
    key, doc = np.nonzero(counts.T)
    firsts = np.searchsorted(key, np.arange(counts.shape[1] + 1))
    sizes = counts.sum(axis=1)
    return counts, max_tree.Tree(np.arange(len(counts)), sizes, np.arange(counts.shape[1]).astype(np.uint64), firsts, doc, counts[doc, key].astype(np.int64), len(counts), int(sizes.sum()))


def test_bounds_and_pruning():
    """No document beats its leaf's bound, no leaf its node's; few leaves are opened, and those suffice."""
    opened, leaves = 0, 0
    for seed in range(30):
        counts, own = tree(seed, 1000, 40)
        draw = np.random.default_rng(seed)
        terms = np.sort(draw.choice(counts.shape[1], 3, replace=False))
        weights = draw.integers(1, 9, 3)
        length = 25 + 75 * counts.sum(axis=1) * len(counts) // counts.sum()
        own_terms = counts[:, terms].astype(np.int64)
        scores = (1_000_000_000 * own_terms // (1000 * own_terms + 8 * length[:, None]) * weights).sum(axis=1)
        bounds = own._leaf_bounds(terms, weights)[0]
        assert all((scores[k * 16 : k * 16 + 16] <= b).all() for k, b in enumerate(bounds.tolist()))
        best = max_tree.Best(10)
        opened += own.search(terms, weights, best)
        leaves += own.n_leaves
        by = np.lexsort((np.arange(len(scores)), -scores))[:10]
        by = by[scores[by] > 0]
        assert best.ids.tolist() == by.tolist() and best.scores.tolist() == scores[by].tolist()
    assert opened < 0.8 * leaves
