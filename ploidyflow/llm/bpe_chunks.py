"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts every text into chunks at places that
depend on the content alone, so a passage that many documents share gives the
same chunks in each. Chunks that occur again anywhere in the table are counted first;
each is encoded once, by the smallest doc_id that has it, and its ids are kept in sorted arrays
in the shared folder, which all workers map. Other chunks occur once and are encoded where they are.

At a join of two chunks the text around it is encoded again, from the last place in the left
chunk to the first place in the right one at which the tokenizer surely cuts; a chunk
without such a place joins its neighbours, until both edges are such places. There the ids agree
exactly with those of the whole text.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, U64, discard, documents_of, list_array, prefix_sums, range_hash, session_setup, shared_path, string_list, text_slices, written
from .hash_arrays import Folder
from .pieces import PieceEncoder, encoder, token_bytes

#: Bytes under the rolling hash, and mean bytes of a chunk (a power of 2).
WINDOW = 16
MEAN_CHUNK = 256
#: Shared chunks of a bucket: about so many are held by a task.
BUCKET_CHUNKS = 1 << 16
#: First piece, ids between, last piece of a chunk; None if it has no cut.
Entry = tuple[str, bytes, str] | None


def chunk_bounds(data: np.ndarray, bounds: np.ndarray, mean: int = MEAN_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cuts of the slice, its documents' bounds and those that the rolling hash sets, and each chunk's hash."""
    n, sums = len(data), prefix_sums(BYTE_CODES[data])
    cuts = np.unique(bounds)
    if n > WINDOW:
        at = np.arange(WINDOW, n)
        cut = range_hash(sums, at - WINDOW, at) & U64(mean - 1) == 0
        at = at[cut & ((data[WINDOW:] & 0xC0) != 0x80)]
        inside = at - bounds[np.searchsorted(bounds, at, "right") - 1] >= WINDOW
        cuts = np.unique(np.concatenate([at[inside], bounds]))
    return cuts, range_hash(sums, cuts[:-1], cuts[1:])


class ChunkEncoder:
    """Encodes texts chunk by chunk; the ids equal those of the whole texts."""

    def __init__(self, pieces: PieceEncoder):
        self.pieces = pieces
        self.bytes_of = token_bytes(pieces.tokenizer)
        self.encoded = self.reused = 0

    def entries(self, chunks: list[str]) -> dict[str, Entry]:
        """What is kept of each chunk."""
        split = {x: p for x in chunks if len(p := self.pieces.pieces(x)) > 1}
        long = self.pieces.learn([p[1:-1] for p in split.values()])
        get = self.pieces.ids.__getitem__
        out: dict[str, Entry] = dict.fromkeys(chunks)
        out.update((x, (p[0], b"".join(map(get, p[1:-1])), p[-1])) for x, p in split.items())
        self.pieces.forget(long)
        return out

    def encode(self, texts: list[str], chunks: list[list[str]], known: dict[str, Entry]) -> list[bytes]:
        """chunks: each text's chunks in order; joined they are the text. known: entries of some of them."""
        pieces = self.pieces
        whole = {i for i, x in enumerate(texts) if not pieces.cuts or any(t in x for t in pieces.added)}
        wanted = {x: None for i, parts in enumerate(chunks) if i not in whole for x in parts}
        new = [x for x in wanted if x not in known]
        self.encoded += len(new)
        self.reused += len(wanted) - len(new)
        have = known | self.entries(new)
        plans: list[list] = []
        joins: list[list[str]] = []
        for i, parts in enumerate(chunks):
            plan: list = []
            open_text = texts[i] if i in whole else ""
            for x in parts if i not in whole else ():
                if (e := have[x]) is None:
                    open_text += x
                    continue
                joins.append(pieces.pieces(open_text + e[0]))
                plan += [joins[-1], e[1]]
                open_text = e[2]
            joins.append(pieces.pieces(open_text))
            plans.append([*plan, joins[-1]])
        long = pieces.learn(joins)
        get = pieces.ids.__getitem__
        out = [b"".join([step if isinstance(step, bytes) else b"".join(map(get, step)) for step in plan]) for plan in plans]
        pieces.forget(long)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def chunked_texts(data: np.ndarray, bounds: np.ndarray, cuts: np.ndarray | None = None) -> tuple[list[str], list[list[str]]]:
    """The slice's texts and each text's chunks."""
    cuts = chunk_bounds(data, bounds)[0] if cuts is None else cuts
    parts = string_list(data, cuts) if len(cuts) > 1 else []
    at = np.searchsorted(cuts, bounds).tolist()
    return string_list(data, bounds), [parts[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_coders: dict[str, ChunkEncoder] = {}


def coder(tokenizer: str) -> ChunkEncoder:
    if tokenizer not in _coders:
        _coders[tokenizer] = ChunkEncoder(encoder(tokenizer))
    return _coders[tokenizer]


# ------------------------------------------------------------- chunks that recur


@dataclass
class Shared:
    """Where the entries of the chunks that recur are; buckets go by the upper bits of a chunk's hash."""

    folder: str
    bits: int

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def places(self, folder: Folder, name: str, hashes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Bucket, rows and places of the hashes that a table has."""
        bucket, out = self.bucket(hashes), []
        for b in np.unique(bucket).tolist():
            rows, keys = np.flatnonzero(bucket == b), folder.get(f"{name}-{b}")
            if keys is not None and len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[rows]), len(keys) - 1)
                found = keys[at] == hashes[rows]
                out.append((b, rows[found], at[found]))
        return out


_folders: dict[str, Folder] = {}


def _folder(uri: str) -> Folder:
    if uri not in _folders:
        _folders.clear()
        _folders[uri] = Folder(uri)
    return _folders[uri]


def _packed(text: str, entry: Entry) -> bytes:
    """A chunk's entry with a second hash of its text."""
    head, ids, tail = entry or ("", b"", "")
    head, tail = head.encode(), tail.encode()
    return struct.pack("<QiI", xxhash.xxh64_intdigest(text, 7), len(head) if entry else -1, len(tail)) + head + tail + ids


def _unpacked(text: str, data: bytes) -> tuple[bool, Entry]:
    """Whether the entry is this text's, and the entry."""
    check, head, tail = struct.unpack_from("<QiI", data)
    if check != xxhash.xxh64_intdigest(text, 7):
        return False, None
    if head < 0:
        return True, None
    return True, (data[16 : 16 + head].decode(), data[16 + head + tail :], data[16 + head : 16 + head + tail].decode())


def known_entries(shared: Shared, parts: list[str], hashes: np.ndarray) -> dict[str, Entry]:
    """Entries of those of a slice's chunks that recur in the table."""
    folder, out = _folder(shared.folder), {}
    for b, rows, places in shared.places(folder, "chunk", hashes):
        at, data = folder.get(f"at-{b}"), folder.get(f"data-{b}")
        for i, k in zip(rows.tolist(), places.tolist(), strict=True):
            if (text := parts[i]) not in out:
                same, entry = _unpacked(text, data[at[k] : at[k + 1]].tobytes())
                if same:
                    out[text] = entry
    return out


def encoded(code: ChunkEncoder, shared: Shared, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """ids of a slice's texts."""
    cuts, hashes = chunk_bounds(data, bounds)
    texts, chunks = chunked_texts(data, bounds, cuts)
    return code.encode(texts, chunks, known_entries(shared, [x for parts in chunks for x in parts], hashes))


def shared_chunks(docs: DataFrame, tokenizer: str, bucket_chunks: int = BUCKET_CHUNKS) -> Shared:
    """Encodes every chunk that occurs more than once, once each. docs: as documents_of() gives them."""
    spark = docs.sparkSession

    def count(batches):
        for rows, data, bounds in text_slices(batches):
            cuts, hashes = chunk_bounds(data, bounds)
            doc = rows.column("doc_id").to_numpy()[np.searchsorted(bounds, cuts[:-1], "right") - 1]
            found, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
            owner = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(owner, back, doc)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(owner)], ["chunk", "n", "owner"])

    counts = docs.mapInArrow(count, "chunk bigint, n bigint, owner bigint").groupBy("chunk").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
    again = written(counts.where("n > 1").select("chunk", "owner"), "recurring")
    bits = max(0, int(np.ceil(np.log2(max(again.count(), 1) / bucket_chunks))))
    shared = Shared(shared_path(spark, "chunks"), bits)
    bucket = F.shiftrightunsigned("chunk", 64 - bits).cast("int") if bits else F.lit(0)

    def dealt(df):
        return df.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")

    def store(names):
        """Writes each bucket's rows in order of their chunks; repeats of a chunk are left out."""

        def run(batches):
            folder, at, held = Folder(shared.folder), None, []

            def put():
                chunk = np.concatenate([h[0] for h in held])
                chunk, first = np.unique(chunk, return_index=True)
                folder.put(f"{names[0]}-{at}", chunk)
                if names[1] == "owner":
                    folder.put(f"owner-{at}", np.concatenate([h[1] for h in held])[first])
                else:
                    every = [x for h in held for x in h[1]]
                    data = [every[k] for k in first.tolist()]
                    folder.put(f"at-{at}", np.cumsum([0, *map(len, data)]))
                    folder.put(f"data-{at}", np.frombuffer(b"".join(data), np.uint8))
                held.clear()

            for b in batches:
                key = b.column("bucket").to_numpy()
                edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    if x == y:
                        continue
                    if held and key[x] != at:
                        put()
                    at = int(key[x])
                    value = b.column(names[1]).slice(x, y - x)
                    held.append((b.column("chunk").slice(x, y - x).to_numpy().view(U64), value.to_numpy() if names[1] == "owner" else value.to_pylist()))
            if held:
                put()
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["bucket"])

        return run

    written(dealt(again.select(bucket.alias("bucket"), "chunk", "owner")).mapInArrow(store(("wanted", "owner")), "bucket int"), "stored")

    def encode(batches):
        code, folder = coder(tokenizer), _folder(shared.folder)
        for rows, data, bounds in text_slices(batches):
            cuts, hashes = chunk_bounds(data, bounds)
            doc = rows.column("doc_id").to_numpy()[np.searchsorted(bounds, cuts[:-1], "right") - 1]
            own: dict[int, int] = {}
            for b, mine, places in shared.places(folder, "wanted", hashes):
                mine = mine[folder.get(f"owner-{b}")[places] == doc[mine]]
                own.update(zip(hashes[mine].tolist(), mine.tolist(), strict=True))
            texts = [data[cuts[k] : cuts[k + 1]].tobytes().decode() for k in own.values()]
            entries = code.entries(texts) if code.pieces.cuts else {}
            chunk = np.array([h for h, x in zip(own, texts, strict=True) if x in entries], U64)
            yield pa.RecordBatch.from_arrays([pa.array(shared.bucket(chunk).astype(np.int32)), pa.array(chunk.view(np.int64)), pa.array([_packed(x, entries[x]) for x in texts if x in entries], pa.binary())], ["bucket", "chunk", "data"])

    owned = docs.mapInArrow(encode, "bucket int, chunk bigint, data binary")
    written(dealt(owned).mapInArrow(store(("chunk", "data")), "bucket int"), "stored")
    discard(again)
    return shared


# ------------------------------------------------------------------ the operator


def bpe_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every whole text; a null or empty text has no ids.

    Other columns are left out; repeated rows are encoded each. Empty tables give none.
    """
    docs = documents_of(docs)
    session_setup(docs.sparkSession)
    shared = shared_chunks(docs, tokenizer)

    def encode(batches):
        code = coder(tokenizer)
        for rows, data, bounds in text_slices(batches):
            ids = encoded(code, shared, data, bounds)
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), list_array(np.frombuffer(b"".join(ids), "<i4"), counts, pa.int32())], ["doc_id", "ids"])

    return docs.mapInArrow(encode, "doc_id bigint, ids array<int>")


def bpe_decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that the ids decode to, special tokens included. Null ids: empty."""

    def decode(batches):
        code = coder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([code.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    session_setup(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def bpe_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass: ids are encoded, then decoded, in the same batch. Rows without doc_id are left out."""

    docs = documents_of(docs)
    session_setup(docs.sparkSession)
    shared = shared_chunks(docs, tokenizer)

    def digest(batches):
        code = coder(tokenizer)
        number = [str(i).encode() for i in range(len(code.bytes_of))]
        for rows, data, bounds in text_slices(batches):
            counts, shas, texts = [], [], []
            for x in encoded(code, shared, data, bounds):
                ids = np.frombuffer(x, "<u4").tolist()
                counts.append(len(ids))
                shas.append(hashlib.sha256(b",".join(map(number.__getitem__, ids))).hexdigest())
                texts.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
