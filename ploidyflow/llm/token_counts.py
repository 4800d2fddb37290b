"""Token counts of whole texts without their ids.

Which strings of the vocabulary encode alone as one token is proved once, by giving each of them to
the library. Texts are cut into pre-tokens by classes of characters, in numpy arrays over the
bytes of many documents. A pre-token that is a proved string counts one; only the rest is merged
by the library, each distinct one once as long as its count is held.

The classes (letter, number, white space, other) are the library's own: a character is classed by how
the library cuts it from a letter, a digit and a mark. Texts that spell an added token go to the library
whole, as does every text of a tokenizer that isn't byte-level BPE with the usual pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, documents_of, session_setup, string_list, text_slices, word_hashes
from .pieces import PieceEncoder, encoder, token_bytes

#: Slots of a worker's table (a power of 2) and the part of them that is filled at most.
SLOT_BITS = 21
FULL = 0.6
#: Texts that the library is given whole at once.
WHOLE_TEXTS = 64

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: Endings after an apostrophe that are a pre-token with it. Fixed values of the pattern.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class Classes:
    """Class of every code point, asked of the library when it is first met."""

    def __init__(self, pre_tokenizer):
        self.pre_tokenizer = pre_tokenizer
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.table[:128] = [self._ask(k) for k in range(128)]

    def _ask(self, point: int) -> int:
        alone = lambda x: len(self.pre_tokenizer.pre_tokenize_str(x + chr(point))) == 1
        return LETTER if alone("a") else NUMBER if alone("1") else OTHER if alone("!") else SPACE

    def of(self, data: np.ndarray) -> np.ndarray:
        """Class of the character of each byte."""
        out = self.table[data]
        lead = np.flatnonzero(data >= 0xC0)
        if not len(lead):
            return out
        first = data[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = (first & (0x7F >> size)).astype(np.int32)
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        unknown = np.unique(point[self.table[point] == UNKNOWN])
        self.table[unknown] = [self._ask(k) for k in unknown.tolist()]
        kind = self.table[point]
        for k in (0, 1, 2, 3):
            out[lead[size > k] + k] = kind[size > k]
        return out


def pre_tokens(data: np.ndarray, bounds: np.ndarray, classes: Classes) -> np.ndarray:
    """Where the pre-tokens of all documents begin; each ends where the next one, or its document, does."""
    kind = classes.of(data)
    before = np.concatenate([[UNKNOWN], kind[:-1]]).astype(np.uint8)
    spaced = np.concatenate([[False], data[:-1] == 32])  # the byte before is a space
    head = bounds[:-1][bounds[1:] > bounds[:-1]]
    before[head], spaced[head] = UNKNOWN, False
    run = kind != before
    white = kind == SPACE
    start = run & ~spaced | run & white
    # of white space before something else the last character stands by itself, or, a space, leads what follows
    lone = np.flatnonzero(run & ~white & (before == SPACE)) - 1
    while len(odd := np.flatnonzero(data[lone] & 0xC0 == 0x80)):
        lone[odd] -= 1
    start[lone] = True
    mark = np.flatnonzero(start & (data == 39))
    if len(mark):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        left = bounds[np.searchsorted(bounds, mark, "right")] - mark - 1  # bytes that follow in the document
        taken = np.zeros(len(mark), np.int64)
        for x in ENDINGS:
            hit = left >= len(x)
            for k, b in enumerate(x):
                hit &= padded[mark + 1 + k] == b
            taken[hit] = len(x)
        mark, taken, left = mark[taken > 0], taken[taken > 0], left[taken > 0]
        start[mark + 1] = False
        after = mark + 1 + taken
        inside = after[taken < left]
        start[inside[kind[inside] == LETTER]] = True
    return np.flatnonzero(start)


def whole_tokens(path: str) -> list[bytes]:
    """The proof: strings of the vocabulary that the library, given nothing else, encodes as one token."""
    own = encoder(path)
    if not own.cuts:
        return []
    strings = []
    for raw in token_bytes(own.tokenizer):
        try:
            strings.append(raw.decode())
        except UnicodeDecodeError:
            continue  # part of a character is no pre-token
    strings = sorted({x for x in strings if x and not any(t in x for t in own.added)})
    found = own.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return [x.encode() for x, e in zip(strings, found, strict=True) if len(e.ids) == 1]


class CountTable:
    """How many tokens each known pre-token has: open addressing by a 64-bit hash, checked by another of 32 bits."""

    def __init__(self, proved: list[bytes], bits: int = SLOT_BITS):
        self.bits = bits
        ends = np.cumsum([len(x) for x in proved]).astype(np.int64)
        data = np.frombuffer(b"".join(proved), np.uint8)
        self.proved = self.hashed(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if proved else None
        self.clear()

    @staticmethod
    def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(data, starts, ends) | U64(1), (word_hashes(data, starts, ends, seed=1) >> U64(32)).astype(np.uint32)

    def clear(self) -> None:
        """Only what is proved stays."""
        n = 1 << self.bits
        self.key, self.check, self.count = np.zeros(n, U64), np.zeros(n, np.uint32), np.zeros(n, np.int64)
        self.filled = 0
        if self.proved is not None:
            self.insert(*self.proved, np.ones(len(self.proved[0]), np.int64), proved=True)

    @property
    def room(self) -> int:
        return int(FULL * (1 << self.bits)) - self.filled

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Count of each pre-token: negative if it was proved, 0 if it is unknown."""
        mask = (1 << self.bits) - 1
        out, live = np.zeros(len(key), np.int64), np.arange(len(key))
        slot = (key & U64(mask)).astype(np.int64)
        while len(live):
            have = self.key[slot]
            hit = (have == key[live]) & (self.check[slot] == check[live])
            out[live[hit]] = self.count[slot[hit]]
            go = ~hit & (have != 0)
            live, slot = live[go], (slot[go] + 1) & mask
        return out

    def insert(self, key: np.ndarray, check: np.ndarray, count: np.ndarray, proved: bool = False) -> None:
        """Distinct unknown pre-tokens."""
        mask = (1 << self.bits) - 1
        live, slot = np.arange(len(key)), (key & U64(mask)).astype(np.int64)
        self.filled += len(key)
        while len(live):
            free = np.flatnonzero(self.key[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[slot[won]], self.check[slot[won]] = key[live[won]], check[live[won]]
            self.count[slot[won]] = -count[live[won]] if proved else count[live[won]]
            rest = np.ones(len(live), bool)
            rest[won] = False
            live, slot = live[rest], (slot[rest] + 1) & mask


class TokenCounter:
    """Counts of whole texts by one vocabulary file."""

    def __init__(self, own: PieceEncoder, proved: list[bytes], bits: int = SLOT_BITS):
        self.own, self.table = own, CountTable(proved, bits)
        self.classes = Classes(own.tokenizer.pre_tokenizer) if own.cuts else None
        self.added = [x.encode() for x in own.added]

    def _merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The library's counts of pre-tokens."""
        raw = data.tobytes()
        words = [str(raw[a:b], "utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out = np.zeros(len(words), np.int64)
        tail = np.array([x[-1].isspace() for x in words], bool)  # can't stand before another
        for own in (np.flatnonzero(~tail), np.flatnonzero(tail)):
            if len(own):
                out[own] = self.own.library_ids([words[k] for k in own.tolist()])[1]
        return out

    def plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each document, and how many of them are proved strings; no document spells an added token."""
        if not len(data):
            return (np.zeros(len(bounds) - 1, np.int64),) * 2
        starts = pre_tokens(data, bounds, self.classes)
        ends = np.append(starts[1:], len(data))
        key, check = self.table.hashed(data, starts, ends)
        count = self.table.find(key, check)
        missing = np.flatnonzero(count == 0)
        if len(missing):
            by = np.lexsort((check[missing], key[missing]))
            k, c = key[missing][by], check[missing][by]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            one = missing[by[new]]
            merged = self._merged(data, starts[one], ends[one])
            count[missing[by]] = merged[np.cumsum(new) - 1]
            if len(one) > self.table.room:
                self.table.clear()
            if len(one) <= self.table.room:
                self.table.insert(key[one], check[one], merged)
        at = np.searchsorted(starts, bounds)
        total, direct = (np.concatenate([[0], np.cumsum(x)]) for x in (np.abs(count), count < 0))
        return np.diff(total[at]), np.diff(direct[at])

    def long(self, data: np.ndarray) -> tuple[int, int]:
        """A document of any length, in parts that end before white space, which is a sure cut."""
        cut = np.flatnonzero(((data[1:] == 32) | (data[1:] == 10)) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
        edges = [0]
        while len(data) - edges[-1] > CHUNK_BYTES:
            k = np.searchsorted(cut, edges[-1] + CHUNK_BYTES)
            if k == len(cut):
                break
            edges.append(int(cut[k]))
        parts = [self.plain(data[a:b], np.array([0, b - a])) for a, b in zip(edges, [*edges[1:], len(data)], strict=True)]
        return sum(int(n[0]) for n, _ in parts), sum(int(d[0]) for _, d in parts)

    def count(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each document of a slice, and how many of them are proved strings."""
        n = len(bounds) - 1
        total, direct = np.zeros(n, np.int64), np.zeros(n, np.int64)
        whole = np.full(n, not self.own.cuts)
        if self.own.cuts and self.added:
            raw = data.tobytes()
            for token in self.added:
                p = raw.find(token)
                while p >= 0:
                    whole[np.searchsorted(bounds, p, "right") - 1] = True
                    p = raw.find(token, p + 1)
        edge = np.concatenate([[0], np.flatnonzero(whole[1:] != whole[:-1]) + 1, [n]]).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            if whole[a]:
                texts = string_list(part.tobytes(), own)
                total[a:b] = [len(e.ids) for k in range(0, b - a, WHOLE_TEXTS) for e in self.own.tokenizer.encode_batch_fast(texts[k : k + WHOLE_TEXTS], add_special_tokens=False)]
            elif b - a == 1 and len(part) > CHUNK_BYTES:
                total[a], direct[a] = self.long(part)
            else:
                total[a:b], direct[a:b] = self.plain(part, own)
        return total, direct


_counters: dict[str, TokenCounter] = {}


def counter(path: str, proved: list[bytes]) -> TokenCounter:
    """The worker's counter for a vocabulary file; tasks that share the worker share its table."""
    if path not in _counters:
        _counters[path] = TokenCounter(encoder(path), proved)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than limit), n_direct (tokens that are proved strings) of every document.

    Counts are those of the library for the file: tokenizers for .json, sentencepiece for .model, without begin, end or
    added special tokens; special strings inside texts are handled as it does by default. Null texts are empty ones, of no tokens.
    Repeated rows are returned as often; rows without doc_id and other columns are left out; an empty table gives none.
    What is sent to the workers is the vocabulary's proved strings.
    """
    session_setup(docs.sparkSession)
    docs = documents_of(docs)
    if path.endswith(".model"):
        counted = _by_sentencepiece(docs, path)
    else:
        proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

        def count(batches):
            own = counter(path, proved.value)
            for rows, data, bounds in text_slices(batches):
                total, direct = own.count(data, bounds)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(total), pa.array(direct)], ["doc_id", "n_bytes", "n_tokens", "n_direct"])

        counted = docs.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, n_direct bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")


def _by_sentencepiece(docs: DataFrame, path: str) -> DataFrame:
    def count(batches):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        for rows, data, bounds in text_slices(batches):
            total = [len(x) for x in own.encode(string_list(data.tobytes(), bounds), num_threads=1)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(total, pa.int64()), pa.array([0] * len(total), pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_direct"])

    return docs.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, n_direct bigint")
