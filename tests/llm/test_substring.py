import hashlib
import random

import pytest

from ploidyflow.llm import substring

from .cases import EDGES, LONG, documents, text, words


def brute(rows, window):
    first, out = {}, []
    docs = sorted(((i, (t or "").encode().split()) for i, t in rows), key=lambda x: x[0])
    for i, w in docs:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, w in docs:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                keep[s : s + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [1, 2, 7, 50])
def test_against_brute_force(spark, window):
    draw = random.Random(window)
    passages = [words(f"p{k}", draw.randint(window, window + 40), 300) for k in range(6)]
    rows = list(EDGES)
    for i in range(60):
        body = words(i, draw.randint(0, 90), 5000)
        for _ in range(draw.randint(0, 3)):
            p = list(draw.choice(passages))
            if draw.random() < 0.4:
                p[draw.randrange(len(p))] = "edited"
            at = draw.randint(0, len(body))
            body[at:at] = p
        rows.append((i, draw.choice((" ", "\n", "  ")).join(body)))
    rows += [(200, LONG), (201, "same " * 300), (202, "same " * 200), (203, rows[-1][1])]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substring.remove_repeats(documents(spark, rows), window, with_text=True).collect()), key=lambda x: x[:4])
    want = sorted(brute(rows, window), key=lambda x: x[:4])
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4].encode().split() for x in got] == [x[4] for x in want]


def test_untouched_text_and_carried_columns(spark):
    rows = [(1, "a  b\n c"), (2, text(5, 80)), (3, "x\n" + text(5, 80) + "\ny")]
    got = {r.doc_id: r for r in substring.remove_repeats(documents(spark, rows), 50, with_text=True, carry=("lang", "source")).collect()}
    assert got[1].text == "a  b\n c" and got[1].source == "src0"
    assert got[3].text == "x\ny" and got[3].n_removed == 80


def test_empty(spark):
    assert substring.remove_repeats(documents(spark, [])).count() == 0
