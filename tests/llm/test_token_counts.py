import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ploidyflow.llm import token_counts
from ploidyflow.llm.pieces import encoder
from ploidyflow.llm.queries import BYTE_BPE

from .cases import EDGES, LONG, documents

LIBRARY = Tokenizer.from_file(BYTE_BPE)
PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", "a", "Z", "é", "日", "1", "²", "!", "-", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "\x00", "́", "😀", "ª", "Ⅷ", "'s", "'re", "the", " the", "\r\n"]


def buffer(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return token_counts.TokenCounter(encoder(BYTE_BPE), token_counts.whole_tokens(BYTE_BPE), bits=17)


def test_pre_tokens_and_counts_against_the_library(own):
    draw = random.Random(1)
    for _ in range(1500):
        texts = ["".join(draw.choices(PARTS, k=draw.randrange(14))) for _ in range(draw.randrange(1, 6))]
        data, bounds = buffer(texts)
        want = [int(bounds[k]) + len(x[:a].encode()) for k, x in enumerate(texts) for _, (a, _) in LIBRARY.pre_tokenizer.pre_tokenize_str(x)]
        assert token_counts.pre_tokens(data, bounds, own.classes).tolist() == want
        total, direct = own.count(data, bounds)
        assert total.tolist() == [library(x) for x in texts] and (direct <= total).all()


def test_proof(own):
    """Every proved string is one token alone, and a string that isn't one token isn't proved."""
    proved = token_counts.whole_tokens(BYTE_BPE)
    assert len(proved) == len(set(proved)) > 49_000
    assert all(library(x.decode()) == 1 for x in proved[::97])
    assert b"<|endoftext|>" not in proved and b" the" in proved
    total, direct = own.count(*buffer([" the of", "qzxqzx", ""]))
    assert direct.tolist() == [2, 0, 0] and total.tolist() == [2, library("qzxqzx"), 0]


def test_table_that_overflows():
    """Far more distinct pre-tokens than slots: what is held goes, counts stay right."""
    draw = random.Random(3)
    own = token_counts.TokenCounter(encoder(BYTE_BPE), token_counts.whole_tokens(BYTE_BPE), bits=17)
    for _ in range(8):
        texts = [" ".join("".join(draw.choices("abcdefgh", k=draw.randrange(3, 9))) for _ in range(2000)) for _ in range(5)]
        assert own.count(*buffer(texts))[0].tolist() == [library(x) for x in texts]
    tiny = token_counts.TokenCounter(encoder(BYTE_BPE), [b" the"], bits=4)
    assert tiny.count(*buffer([LONG[:5000]]))[0].tolist() == [library(LONG[:5000])]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 1 << 14)
    rows = [*EDGES, (910, "x" * 70_000), (911, "<|endoftext|><|endoftext|> a" * 3), (912, "a " * 600), (913, "a " * 511 + "b a"), (None, "no id")]
    got = sorted(tuple(r) for r in token_counts.token_counts(documents(spark, rows), BYTE_BPE).collect())
    want = sorted((i, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t in rows if i is not None)
    assert [x[:4] for x in got] == want and any(x[3] for x in want)
    assert token_counts.token_counts(documents(spark, rows), BYTE_BPE, limit=3).where("over_limit").count() == sum(n > 3 for _, _, n, _ in want)
    assert token_counts.token_counts(documents(spark, []), BYTE_BPE).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        plain = SentencePieceProcessor(model_file=path)
        count = lambda x: len(plain.encode(x))
    else:
        other = Tokenizer.from_file(path)
        count = lambda x: len(other.encode(x, add_special_tokens=False).ids)
    rows = [x for x in EDGES if x[0] != 905]
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(documents(spark, rows), path).collect())
    assert got == sorted((i, count(t or "")) for i, t in rows)
