"""Every registered query on the smallest tables: the columns of its contract, and its rows against another way to them."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from ploidyflow.llm import html_text, queries

from .test_kneser_ney import plain, plain_trigrams
from .test_simhash import grouped
from .test_tiling import plain_tiles

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
LIBRARY = Tokenizer.from_file(queries.BYTE_BPE)


def table(name, *columns):
    return duckdb.sql(f"select {', '.join(columns)} from '{FOLDER}/{name}.parquet'").fetchall()


DOCS = table("documents", "doc_id", "text") if os.path.isdir(FOLDER) else []


def rows(spark, name, columns):
    """The query's rows; its first columns, with their types, are those of the contract."""
    df = queries.QUERIES[name](spark, FOLDER)
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in columns} == columns
    return df.collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark):
    got = rows(spark, "op1_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in DOCS)
    lang, text = dict(table("documents", "doc_id", "lang")), dict(DOCS)
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in got)
    tested = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und" and len(text[r.doc_id].split()) > 3]
    assert len(tested) > 20 and np.mean(tested) >= 0.95


def test_op3(spark):
    got = rows(spark, "op3_kneser_ney", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    learnt = [x for x in DOCS if crc(x[0], 7) != 2]
    (base, tokens), score = plain(learnt), plain_trigrams(learnt)
    for r in got:
        _, b, known, n = base(dict(DOCS)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, n, known, tokens)
        assert r.base_score == pytest.approx(b, rel=1e-9) and r.score == pytest.approx(score(dict(DOCS)[r.doc_id]), rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op4(spark):
    got = rows(spark, "op4_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {}
    for i, t in DOCS:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        prints[i] = int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=int) > len(shingles)).tobytes(), "big")
    want = grouped(prints, [(a, b) for a, x in prints.items() for b, y in prints.items() if a < b and (x ^ y).bit_count() <= 2])
    assert sorted(tuple(r)[:3] for r in got) == sorted((i, f"{x:016x}", want[i]) for i, x in prints.items())


def test_op5_and_op10(spark):
    ids = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids for i, t in DOCS}
    start, want = 0, []
    for i, t in sorted(DOCS, key=lambda x: x[0]):
        own = [*ids[i], 2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(tuple(r)[:4] for r in rows(spark, "op5_token_output", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})) == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted((i, len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False))) for i, x in ids.items())
    assert sorted(tuple(r)[:4] for r in rows(spark, "op10_bpe_chunks", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})) == digests


def test_op6(spark):
    got = rows(spark, "op6_line_quality", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    quality = dict(table("labels", "doc_id", "quality"))
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in DOCS)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    tested = [r.predicted == quality[r.doc_id] for r in got if r.held_out and quality.get(r.doc_id) is not None]
    assert len(tested) >= 5 and np.mean(tested) >= 0.9


def test_op7(spark):
    got = {r.page_id: r for r in rows(spark, "op7_html_text", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})}
    pages = table("pages", "page_id", "url", "html")
    assert set(got) == {p for p, _, _ in pages}
    for p, url, page in pages:
        r = got[p]
        assert r.url == url and r.n_chars == len(r.text)
        if page and "<article>" in page:
            assert r.text == html_text.region_text(html_text.sequence(f"<div>{page[page.index('<article>') + 9 : page.index('</article>')]}</div>"))


def test_op8(spark):
    got = rows(spark, "op8_prefix_forest", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    vectors = {i: np.array(v, float) for i, v in table("embeddings", "vec_id", "embedding") if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    found = Counter()
    for q in [i for i in vectors if i % 50 == 0]:
        x = vectors[q]
        near = sorted((-(x @ y) / np.sqrt((x @ x) * (y @ y)), i) for i, y in vectors.items() if i != q)[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [k for k, *_ in own] == list(range(1, len(near) + 1))
        found["all"] += len(near)
        found["hit"] += len({i for _, i, _ in own} & {i for _, i in near})
        assert all(s == pytest.approx((x @ vectors[i]) / np.sqrt((x @ x) * (vectors[i] @ vectors[i])), abs=1e-12) for _, i, s in own)
    assert found["hit"] >= 0.9 * found["all"] > 0


def test_op9(spark):
    got = {(r.doc_id, r.item_id): r for r in rows(spark, "op9_tiling", {"doc_id": "bigint", "item_id": "bigint", "n_matched": "bigint", "n_words": "bigint", "coverage": "double"})}
    plain_words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t or "").split()
    items = {k: plain_words(t) for k, t in table("benchmark", "item_id", "text")}
    whole = {(i, k) for i, t in DOCS for d in [f" {' '.join(plain_words(t))} "] for k, x in items.items() if x and f" {' '.join(x)} " in d}
    assert whole and whole <= set(got)
    for (i, k), r in got.items():
        doc = plain_words(dict(DOCS)[i])
        assert r.n_words == len(items[k]) and r.coverage == r.n_matched / r.n_words >= 0.8
        if len(doc) < 300:
            assert r.n_matched == plain_tiles(doc, items[k], 5)


def test_op13(spark):
    got = rows(spark, "op13_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    counts = {i: len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t in DOCS}
    assert sorted(tuple(r)[:4] for r in got) == sorted((i, len((t or "").encode()), counts[i], counts[i] > 1024) for i, t in DOCS)
    assert 0 < sum(r.n_direct for r in got) < sum(r.n_tokens for r in got)


def test_columns_of_op11_and_op12(spark):
    """Their rows are held against DuckDB's in test_sql.py."""
    assert queries.QUERIES["op11_max_tree"](spark, FOLDER).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert queries.QUERIES["op12_delta_lloyd"](spark, FOLDER).dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
