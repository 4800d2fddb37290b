import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ploidyflow.llm import bpe_chunks, piece_table, pieces, token_output
from ploidyflow.llm.common import local_of, shared_path, string_list

from .cases import EDGES, documents, text

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ROWS = EDGES + [(i, text(i, 40) + ".\n" * (i % 3)) for i in range(30)]


def ids_of(t):
    return LIBRARY.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,'!1 \n\t\r\x0b\x1c\x85\xa0 \0é日🙂<|>")), max_size=4))
def test_pieces_and_chunks_equal_the_library(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    want = [ids_of(t) for t in texts]
    read = lambda xs: [np.frombuffer(x, "<u4").tolist() for x in xs]
    assert read(pieces.encoder(PATH).encode(string_list(data, bounds))) == want
    assert read(bpe_chunks.coder(PATH).encode(*bpe_chunks.chunked_texts(data, bounds), {})) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,'!1 \n\n \xa0\u3000\x85\t\0é日🙂«<|>")), max_size=5), st.sampled_from([4, 8, 22]))
def test_table_equals_the_library(texts, bits):
    own = piece_table.PieceTable(pieces.encoder(PATH), bits)
    raw = [t.encode() for t in [*texts, "x <|endoftext|> y"] * 2]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    for _ in range(2):
        ids, counts = own.encode(data, bounds)
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [ids_of(x.decode()) for x in raw]


def test_small_tables():
    own = piece_table.PieceTable(pieces.encoder(PATH), 6)
    for k in range(30):
        raw = [text(f"{k}-{j}", 12).encode() for j in range(3)] + [("y" * 40_000 if k % 9 == 0 else "").encode()]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        ids, counts = own.encode(data, bounds)
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [ids_of(x.decode()) for x in raw]


def test_pool_of_long_pieces_is_bounded():
    own = piece_table.PieceTable(pieces.encoder(PATH), 12, pool_ids=1000)
    made = 0
    for k in range(40):
        raw = [("".join(f"{k}{j}é" for j in range(150)) + " end").encode(), b""]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        ids, counts = own.encode(data, bounds)
        assert ids.tolist() == ids_of(raw[0].decode()) and counts.tolist() == [len(ids), 0]
        made += len(ids)
        assert own.used <= 1000 + len(ids)
    assert made > 4000


def test_small_caches(monkeypatch):
    own = pieces.PieceEncoder(PATH, most=5)
    for t in ("a b c d e f g", "h i j a b", "<|endoftext|> x", "k  l\n\nm"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == ids_of(t)


@pytest.mark.parametrize("bucket_chunks", [bpe_chunks.BUCKET_CHUNKS, 4])
def test_shared_chunks_are_encoded_once(spark, bucket_chunks):
    """Chunks of a passage that 40 documents share are in the table once each; what is encoded beside them occurs once."""
    passage = text("passage", 800)
    rows = [(k, f"{text(k, 30)} {passage} {text(k + 1000, 30)}") for k in range(40)] + EDGES
    docs = bpe_chunks.documents_of(documents(spark, rows))
    shared = bpe_chunks.shared_chunks(docs, PATH, bucket_chunks)
    folder = bpe_chunks.Folder(shared.folder)
    chunks = [x for b in range(1 << shared.bits) if (x := folder.get(f"chunk-{b}")) is not None]
    chunks = np.concatenate(chunks)
    assert len(np.unique(chunks)) == len(chunks) and (shared.bits > 1) == (bucket_chunks == 4)
    raw = [t.encode() for _, t in rows[:40]]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    cuts, hashes = bpe_chunks.chunk_bounds(data, bounds)
    found, times = np.unique(hashes, return_counts=True)
    assert set(found[times > 1].tolist()) <= set(chunks.tolist()) and not set(found[times == 1].tolist()) & set(chunks.tolist())
    code = bpe_chunks.ChunkEncoder(pieces.PieceEncoder(PATH))
    got = bpe_chunks.encoded(code, shared, data, bounds)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(x.decode()) for x in raw]
    assert code.encoded == (times == 1).sum() and code.reused == (times > 1).sum() > 10


def test_entries_of_another_text_are_not_taken():
    data = bpe_chunks._packed("one two three", ("one", b"1234", " three"))
    assert bpe_chunks._unpacked("one two three", data) == (True, ("one", b"1234", " three"))
    assert bpe_chunks._unpacked("one two  three", data) == (False, None)
    assert bpe_chunks._unpacked("nocut", bpe_chunks._packed("nocut", None)) == (True, None)


def test_bpe_digest_and_round_trip(spark):
    docs = documents(spark, ROWS)
    got = sorted(tuple(r) for r in bpe_chunks.bpe_digest(docs, PATH).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted((i, len(ids_of(t)), sha(",".join(map(str, ids_of(t)))), sha(LIBRARY.decode(ids_of(t), skip_special_tokens=False))) for i, t in ROWS)
    back = {r.doc_id: r.text for r in bpe_chunks.bpe_decode(bpe_chunks.bpe_ids(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in ROWS}
    assert bpe_chunks.bpe_digest(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, encoding):
    docs = documents(spark, ROWS)
    path = shared_path(spark, "tokens")
    token_output.write_tokens(docs, path, PATH, end_id=2, encoding=encoding)
    got = sorted(tuple(r) for r in token_output.token_digest(spark, path).collect())
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda x: (x[0], x[1] or "")):
        ids = [*ids_of(t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert {r.doc_id: r.ids for r in token_output.read_tokens(spark, path, 3, 5).collect()} == {i: [*ids_of(t), 2] for i, t in ROWS if 3 <= i <= 5}
    assert sum(r.n_tokens for r in token_output.read_metadata(spark, path).collect()) == start
    from glob import glob

    files = [f for f in glob(f"{local_of(path)}/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    column = next(c for c in (pq.ParquetFile(files[0]).metadata.row_group(0).column(k) for k in range(5)) if c.path_in_schema.startswith("ids"))
    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "PLAIN_DICTIONARY") in column.encodings
    assert column.has_offset_index and column.has_column_index


def test_token_files_of_nothing(spark):
    assert token_output.token_table(documents(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        token_output.parquet_options("other")
