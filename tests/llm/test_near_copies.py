import random

import numpy as np
import pytest

from ploidyflow.llm import near_copies

from .cases import EDGES, documents, words
from .test_simhash import fingerprint, grouped, near_texts


def classes(rows, least=0.8):
    """Brute force: the classes of all pairs' exact similarities."""
    sets = {i: fingerprint(t, 5)[1] for i, t in rows}
    return grouped(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


def found(spark, rows, **sizes):
    return {r.doc_id: r.class_id for r in near_copies.near_copies(documents(spark, rows), **sizes).collect()}


@pytest.mark.parametrize("common, block_rows, broadcast_ids", [(128, 1024, 1 << 20), (2, 1024, 0), (2, 3, 0), (0, 1, 1 << 20)])
def test_against_brute_force(spark, common, block_rows, broadcast_ids):
    """Rare keys alone; common keys in a block each; common keys in many blocks whose texts visit each other."""
    rows = near_texts(100, 9) + [(i, t) for i, t in EDGES if i != 905]
    assert found(spark, rows, common=common, block_rows=block_rows, broadcast_ids=broadcast_ids) == classes(rows)


@pytest.mark.parametrize("common, block_rows", [(128, 1024), (4, 16)])
def test_edits_of_one_text(spark, common, block_rows):
    """A group of which a part is linked: copies of a text that itself is missing, two to four words edited in each."""
    base, draw = words("base", 150, 10**6), random.Random(4)
    rows = []
    for i in range(300):
        w = list(base)
        for at in draw.sample(range(150), draw.choice((2, 3, 4))):
            w[at] = f"edit{draw.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = classes(rows)
    assert 10 < len({*want.values()}) < 290
    assert found(spark, rows, common=common, block_rows=block_rows) == want


def test_lines_repeat_and_short_texts(spark):
    """A line once against the same many times; four, five and six shingles: 0.8 and 0.83 in a row, 0.67 between the ends."""
    rows = []
    for i in range(12):
        head, line = " ".join(words(f"head{i}", 100, 10**6)), " ".join(words(f"line{i}", 10, 10**6))
        rows += [(3 * i, f"{head} {line}"), (3 * i + 1, " ".join([head, *[line] * (8 + 4 * i)])), (3 * i + 2, " ".join(words(f"other{i}", 60, 10**6)))]
    for i in range(40):
        w = words(f"short{i}", 12, 10**6)
        rows += [(1000 + 10 * i + k, " ".join(w[:n])) for k, n in enumerate((10, 8, 9))]
        rows += [(1000 + 10 * i + 3, " ".join([*w[:8], "another"])), (1000 + 10 * i + 4, " ".join([*w[:7], "unlike", "end"]))]
    assert found(spark, rows) == classes(rows)
    assert found(spark, rows, common=1, block_rows=8) == classes(rows)


def test_texts_that_share_a_passage_only(spark):
    """More than COMMON texts with one long passage and a few words of their own; some are near, by what they have of their own."""
    passage, draw, rows = " ".join(words("passage", 60, 10**6)), random.Random(6), []
    for i in range(200):
        own = words(f"own{i // 2 if i % 7 else i}", draw.choice((10, 30, 80)) if i % 2 == 0 else 30, 10**6)
        rows.append((i, f"{passage} {' '.join(own)}"))
    assert found(spark, rows) == classes(rows)


def test_copies_make_no_pairs(spark):
    rows = [(i, "the same words as all the others here") for i in range(50)]
    assert found(spark, rows) == dict.fromkeys(range(50), 0)


def test_ids_that_repeat_and_empty_tables(spark):
    text = " ".join(words(1, 80, 10**6))
    rows = [(5, text), (5, text), (7, text + " more"), (7, " ".join(words(2, 80, 10**6))), (9, " ".join(words(2, 80, 10**6)) + " end"), (None, text)]
    assert found(spark, rows) == {5: 5, 7: 5, 9: 5}
    assert near_copies.near_copies(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_copies.near_copies(documents(spark, []), least_similarity=0.5)


def test_overlaps():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 7000, 6000, 0, 300)]
    got = near_copies.overlaps(sets[:4], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets[:4]]


def test_recall_on_the_given_documents(spark):
    """Classes of the smallest tables' documents against all pairs' exact similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in near_copies.near_copies(docs).collect()} == classes(rows)


def test_rare_keys_fit_a_sweep(spark):
    with pytest.raises(ValueError, match="at most|from 0 to"):
        near_copies.near_copies(documents(spark, [(1, "a b")]), common=5000)
    rows = near_texts(60, 5)
    assert found(spark, rows, common=near_copies.SWEEP_ROWS) == classes(rows)
