"""Words of two letters in Thue-Morse order, which polynomials modulo a power of two can't tell apart."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ploidyflow.llm import common, kneser_ney, near_copies, queries, substring, tiling, token_output

from .cases import documents, words


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (512, 1024, 2048, 4096)]


def hashes(strings, seed=0):
    ends = np.cumsum([len(x) for x in strings])
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    return common.word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(int), ends.astype(int), seed)


def test_hashes_tell_strings_apart():
    strings = ["", "a", "b", "ab", "ba", "a\0", "a\0\0", *("x" * n for n in range(2, 70)), *(thue_morse(n, *x) for n in (8, 16, 64, 512, 1024, 2048, 4096) for x in ("ab", "ba"))]
    assert len(set(hashes(strings).tolist())) == len(set(strings)) > 80
    assert not set(hashes(strings).tolist()) & set(hashes(strings, 1).tolist())
    # the place in the buffer and what follows don't count
    assert hashes(["pad", "word", "tail"])[1] == hashes(["word"])[0] == hashes(["", "word", ""])[1]
    swapped = ["12345678abcdefgh", "abcdefgh12345678", "12345678" * 2, "abcdefgh" * 2]
    assert len(set(hashes(swapped).tolist())) == 4


def test_lanes_in_parts(monkeypatch):
    strings = [("word%d" % k) * (k % 40) for k in range(300)]
    whole = hashes(strings)
    monkeypatch.setattr(common, "_LANES", 7)
    assert (hashes(strings) == whole).all()


def test_substring(spark):
    x, y = PAIRS[1]
    head, tail = words("h", 30, 10_000), words("t", 30, 10_000)
    rows = [(1, " ".join([*head, x, *tail])), (2, " ".join([*head, y, *tail])), (3, " ".join([*head, x, *tail]))]
    got = sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(documents(spark, rows), window=50).collect())
    assert got == [(1, 0), (2, 0), (3, 61)]


def test_counts_of_words(spark):
    x, y = PAIRS[1]
    model = kneser_ney.train(documents(spark, [(1, f"{x} other"), (2, "other words")]), order=3)
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in kneser_ney.score(documents(spark, [(5, f"{y} other"), (6, f"{x} other")]), model).collect()}
    assert got == {5: (3, 2), 6: (3, 3)}


@pytest.mark.parametrize("pair", PAIRS)
def test_tokens(spark, pair):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    rows = [(k, x) for k, x in enumerate(pair)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.token_table(documents(spark, rows).coalesce(1), queries.BYTE_BPE, end_id=2).collect()}
    ids = {k: [*library.encode(x, add_special_tokens=False).ids, 2] for k, x in rows}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ids.items()}


def test_leaks(spark):
    x, y = PAIRS[1]
    items = spark.createDataFrame([(1, x), (2, y)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in tiling.leaks(documents(spark, [(1, f"a {y} b"), (2, "nothing")]), items).collect())
    assert got == [(1, 2)]


def test_near_copies(spark):
    x, y = PAIRS[1]
    got = {r.doc_id: r.class_id for r in near_copies.near_copies(documents(spark, [(1, f"a b {x} c d"), (2, f"a b {y} c d"), (3, f"A b {x} c d")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
