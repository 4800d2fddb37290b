import collections
import math
import os

import numpy as np
import pytest

from ploidyflow.llm import hash_arrays, kneser_ney

from .cases import EDGES, documents, text


def plain(rows):
    """Counts and scores by dictionaries."""
    docs = [((t or "").encode().lower().split() + [0]) for _, t in rows]
    c = collections.Counter(x for w in docs for x in w)
    b = collections.Counter(p for w in docs for p in zip([1, *w], w))
    followed = collections.Counter(y for _, y in b)

    def discount(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        return kneser_ney.discounts(n)

    d, e = discount(b), discount(followed)
    context, gamma = collections.Counter(), collections.Counter()
    for (x, _), v in b.items():
        context[x] += v
        gamma[x] += d[min(v, 3)]
    left = sum(e[min(v, 3)] for v in followed.values()) / len(b)

    def score(t):
        w = (t or "").encode().lower().split() + [0]
        out = base = 0.0
        for x, y in zip([1, *w], w):
            p = max(followed[y] - e[min(followed[y], 3)], 0) / len(b) + left / (len(c) + 1)
            if context[x]:
                p = (max(b[x, y] - d[min(b[x, y], 3)], 0) + gamma[x] * p) / context[x]
            out += math.log10(p)
            base += math.log10((c[y] + 1) / (sum(c.values()) + len(c) + 1))
        return out, base, sum(c[y] > 0 for y in w), len(w)

    return score, sum(c.values())


@pytest.mark.parametrize("bucket", [kneser_ney.BUCKET_BYTES, 4000])
def test_against_dictionaries(spark, bucket):
    rows = [(i, text(i, 5 + i, 60)) for i in range(80)]
    extra = [x for x in EDGES if x[0] != 905]
    model = kneser_ney.train(documents(spark, rows + extra[:5]), bucket_bytes=bucket)
    score, tokens = plain(rows + extra[:5])
    for r in kneser_ney.score(documents(spark, rows + extra + [(700, "Never SEEN before")]), model).collect():
        own = dict(rows + extra + [(700, "Never SEEN before")])[r.doc_id]
        s, base, known, n = score(own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(s, abs=1e-9)


def plain_trigrams(rows, order=3):
    """Counts and scores of any order by dictionaries; texts have one begin."""
    split = lambda t: [1, *(t or "").encode().lower().split(), 0]
    grams = {k: collections.Counter(tuple(w[i : i + k]) for _, t in rows for w in [split(t)] for i in range(len(w) - k + 1)) for k in range(1, order + 1)}
    counts = {order: grams[order]}
    for k in range(order - 1, 0, -1):
        ends = collections.Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: ends[g] or (n if k > 1 else 0) for g, n in grams[k].items()}
    less = {k: kneser_ney.discounts([sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4)]) for k in counts}
    after = {k: collections.defaultdict(list) for k in counts}
    for k in counts:
        for g, n in counts[k].items():
            after[k][g[:-1]].append(n)
    types, distinct = len(grams[2]), sum(n > 0 for n in counts[1].values())
    left = sum(less[1][min(v, 3)] for v in counts[1].values()) / types / (distinct + 1)
    contexts = {k: {g: (sum(seen), sum(less[k][min(v, 3)] for v in seen)) for g, seen in after[k].items()} for k in counts}

    def score(t):
        w, out = split(t), 0.0
        for i in range(1, len(w)):
            n = counts[1].get((w[i],), 0)
            p = max(n - less[1][min(n, 3)], 0) / types + left
            for k in range(2, min(order, i + 1) + 1):
                if seen := contexts[k].get(tuple(w[i - k + 1 : i])):
                    n = counts[k].get(tuple(w[i - k + 1 : i + 1]), 0)
                    p = (max(n - less[k][min(n, 3)], 0) + seen[1] * p) / seen[0]
            out += math.log10(p)
        return out

    return score


@pytest.mark.parametrize(("order", "bucket"), [(2, 4000), (3, kneser_ney.BUCKET_BYTES), (3, 4000), (4, 4000)])
def test_higher_orders_against_dictionaries(spark, order, bucket):
    rows = [(i, text(i % 70, 5 + i % 70, 12)) for i in range(80)] + [x for x in EDGES if x[0] != 905]
    score = plain_trigrams(rows, order)
    model = kneser_ney.train(documents(spark, rows), order, bucket)
    asked = rows + [(700, "Never SEEN before"), (701, text(999, 40, 12))]
    for r in kneser_ney.score(documents(spark, asked), model).collect():
        assert r.score == pytest.approx(score(dict(asked)[r.doc_id]), abs=1e-9)


def test_query_sees_two_words_of_context(spark, tmp_path):
    """After 'x a' comes b, after 'y a' comes c: one word of context can't tell."""
    from ploidyflow.llm import queries

    rows = [(i, " ".join(["x a b", "y a c"][(i + j) % 2] for j in range(30))) for i in range(60)] + [(100, "x a b"), (101, "x a c")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op3_kneser_ney(spark, str(tmp_path)).collect()}
    assert got[100] - got[101] > 0.8


def test_probabilities_sum_to_one(spark):
    rows = [(i, text(i, 30, 25)) for i in range(20)]
    model = kneser_ney.train(documents(spark, rows))
    from ploidyflow.llm.common import word_hashes

    vocabulary = sorted({w for _, t in rows for w in t.encode().split()})
    data = np.frombuffer(b" ".join(vocabulary), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in vocabulary]) - 1
    hashes = np.append(word_hashes(data, ends - [len(w) for w in vocabulary], ends), np.uint64(kneser_ney.END))
    reader = model.reader()
    total = 0.0
    for h in hashes:  # after the first word of the vocabulary
        logs, _ = reader.log_probabilities(np.array([hashes[0], h]), np.array([0, 2]))
        total += 10 ** logs[1]
    unseen, _ = reader.log_probabilities(np.array([hashes[0], np.uint64(12345)]), np.array([0, 2]))
    assert total + 10 ** unseen[1] == pytest.approx(1)


def test_beats_base_on_held_out(spark):
    rows = [(i, " ".join(f"a{k % 7} b{k % 7}" for k in range(i, i + 40))) for i in range(60)]
    model = kneser_ney.train(documents(spark, rows[:50]))
    got = kneser_ney.score(documents(spark, rows[50:]), model).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.parametrize("bits", [1, 9, 33, 44, 57, 64])
def test_spread_is_a_bijection(bits):
    x = np.unique(np.random.default_rng(bits).integers(0, 1 << 63, 1000).astype(np.uint64) >> np.uint64(max(0, 63 - bits)))
    assert (hash_arrays.unspread(hash_arrays.spread(x, bits), bits) == x).all()
    assert bits == 64 or int(hash_arrays.spread(x, bits).max()) < 1 << bits


def test_ngrams_have_keys_of_their_own():
    """Numbers of more than 32 bits together with those of words make distinct keys, and are read from them."""
    model = kneser_ney.Model("", 14, 3, [np.array([0, 1 << 27]), np.arange((1 << 14) + 1) << 22])
    draw, own = np.random.default_rng(3), model.reader()
    for k, most in ((2, 1 << 27), (3, 1 << 36)):
        context, word = draw.integers(0, most, 1000), draw.integers(0, 1 << 27, 1000)
        bucket, keys = own.located(k, context, word)
        for b in np.unique(bucket).tolist():
            here = bucket == b
            got = own.split(k, b, keys[here])
            assert (got[0] == context[here]).all() and (got[1] == word[here]).all()
        assert len(set(zip(bucket.tolist(), keys.tolist(), strict=True))) == len(set(zip(context.tolist(), word.tolist(), strict=True)))


def test_distinct_beyond_64_bits():
    draw = np.random.default_rng(4)
    bucket, keys = draw.integers(0, 1 << 20, 500) // 1000, draw.integers(0, 9, 500).astype(np.uint64) << np.uint64(50)
    for back in (True, False):
        small = kneser_ney.distinct(bucket, keys, 54, back)
        large = kneser_ney.distinct(bucket + (1 << 20), keys, 54, back)
        assert (small[0] == large[0] - (1 << 20)).all() and (small[1] == large[1]).all() and (small[2] == large[2]).all()


def test_packed_keys_and_counts(tmp_path):
    folder, draw = hash_arrays.Folder(str(tmp_path)), np.random.default_rng(5)
    for bits in (3, 20, 32, 40, 47):
        keys = np.unique(draw.integers(0, 1 << bits, 6 if bits == 3 else 5000).astype(np.uint64))
        folder.put_keys(f"k{bits}", keys, bits)
        assert (folder.keys(f"k{bits}", bits) == keys).all()
        assert (folder.find(f"k{bits}", bits, keys) == np.arange(len(keys))).all()
        other = draw.integers(0, 1 << bits, 900).astype(np.uint64)
        assert ((folder.find(f"k{bits}", bits, other) >= 0) == np.isin(other, keys)).all()
    counts = draw.integers(0, 400, (700, 4)) ** 4
    folder.put_counts("c", counts)
    assert (folder.counts("c") == counts).all() and (folder.counts("c", np.array([5, 600, 5])) == counts[[5, 600, 5]]).all()
    folder.put_counts("d", counts[:, 0])
    assert (folder.counts("d", np.array([699, 1])) == counts[[699, 1], 0]).all()
    assert folder.get("none") is None and folder.counts("none") is None


def test_open_arrays_are_bounded(tmp_path):
    """Of more arrays than are kept mapped, all are read; none holds a file descriptor."""
    folder, n = hash_arrays.Folder(str(tmp_path), 300), 600
    for i in range(n):
        folder.put(f"a{i}", np.array([i]))
    before = len(os.listdir("/proc/self/fd"))
    assert [int(folder.get(f"a{i}")[0]) for i in range(n)] == list(range(n))
    assert len(folder.open) == 300 and len(os.listdir("/proc/self/fd")) <= before + 1


def test_empty(spark):
    model = kneser_ney.train(documents(spark, []))
    assert model.tokens == 0
    assert [r.n_known for r in kneser_ney.score(documents(spark, [(1, "a b"), (2, None)]), model).collect()] == [0, 0]
    assert kneser_ney.score(documents(spark, []), model).count() == 0
