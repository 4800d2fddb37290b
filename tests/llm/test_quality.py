import random

import numpy as np
import pytest

from ploidyflow.llm import line_quality

from .cases import EDGES, documents, text


def chain(lead, tie):
    """Marginals by going through every labelling."""
    n = len(lead)
    total, good, equal = 0.0, np.zeros(n), np.zeros(n)
    for k in range(1 << n):
        y = [k >> i & 1 for i in range(n)]
        w = np.exp(sum(a for a, b in zip(lead, y) if b) + tie * sum(y[i] == y[i + 1] for i in range(n - 1)))
        total += w
        good += w * np.array(y)
        equal[:-1] += w * np.array([y[i] == y[i + 1] for i in range(n - 1)])
    return good / total, equal / total


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(1)
    sizes = [1, 4, 2, 7, 1]
    lead = draw.normal(size=sum(sizes)) * 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    for tie in (0.0, 0.7, 3.0):
        good, equal = line_quality.marginals(lead, first, tie)
        for a, b in zip(first[:-1], first[1:]):
            g, e = chain(lead[a:b], tie)
            assert good[a:b] == pytest.approx(g) and equal[a:b] == pytest.approx(e)


def test_lines_of_a_slice():
    texts = [b"a\nb\n", b"", b"\n\n", b"x", b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    lines, first = line_quality.line_bounds(data, bounds)
    got = [[bytes(data[lines[k] : lines[k + 1]]) for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [[b"a\n", b"b\n"], [b""], [b"\n", b"\n"], [b"x"], [b""]]


def quality_rows(n, seed):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        lines = [text(f"{seed}-{i}-{k}", draw.randint(3, 20)).capitalize() + "." for k in range(draw.randint(1, 8))]
        if bad:
            lines = [draw.choice((x.upper().replace(" ", "!! "), " | ".join(x.split()), (x.split()[0] + " ") * 20)) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = quality_rows(300, 4)
    model = line_quality.train(documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (5000, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int"))
    held, marks = quality_rows(150, 5)
    got = {r.doc_id: r for r in line_quality.score(documents(spark, held + EDGES), model).collect()}
    assert sum(got[i].predicted == q for i, q, _ in marks) >= 145
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = line_quality.train(documents(spark, EDGES), none)
    assert {r.score for r in line_quality.score(documents(spark, EDGES), model).collect()} == {0.5}
    assert line_quality.score(documents(spark, []), model).count() == 0


def test_junk_late_in_a_long_text_is_learned(spark):
    """Heads of 25,000 bytes are alike; only what follows tells the labels apart."""
    head = lambda i: "\n".join(text(f"{i}-{k}", 12) for k in range(400))
    junk = "\n".join(["$$$ >>> 4711 !!! 0815 ###"] * 600)
    assert len(head(0)) > 20_000
    rows = [(i, head(i) + "\n" + (junk if i % 2 else head(1000 + i))) for i in range(24)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)], "doc_id bigint, quality int")
    model = line_quality.train(documents(spark, rows), labels)
    got = {r.doc_id: r.score for r in line_quality.score(documents(spark, [(1, junk), (2, head(500))]), model).collect()}
    assert got[2] - got[1] > 0.3
