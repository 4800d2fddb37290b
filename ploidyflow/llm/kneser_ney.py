"""Interpolated modified Kneser-Ney model of any order, counted in Spark, read by memory map.

Counting: each batch of texts is counted with numpy and leaves as a few blocks, one
a bucket, each with the batch's sorted keys and counts. A bucket's blocks meet in
one task, are merged and are written as sorted arrays into the shared folder. A
bucket holds a bounded number of n-grams, as the number of buckets follows
the input; a frequent n-gram is one entry of a block.

Words have a 64-bit hash, so all counts are exact but for hash collisions of words.
Distinct n-grams of a length are numbered in order of their arrays. The key of a
longer one is a bijection of the number of all its words but the last and the number of
the last, so no two share a key, and both parts are read from it. N-grams of three
words and more lie in the bucket of their context, so a context's statistics lie beside
its own entry and need no exchange.

Scoring: workers map the arrays into memory, look up each batch's distinct n-grams
length by length, and sum log10 probabilities by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, documents_of, lowered, session_setup, shared_path, text_slices, word_hashes, word_spans, written
from .hash_arrays import Folder, spread, unspread

#: Training bytes to a bucket: about 4 million words, so some 20 MB of distinct bigrams.
BUCKET_BYTES = 24 << 20
#: Bytes of text that are counted at once: more make fewer repeated entries and larger blocks.
COUNT_BYTES = 8 << 20
#: Bytes of text that are scored at once: more share more look-ups.
SCORE_BYTES = 2 << 20
#: Stored n-grams whose last words are looked up at once.
KEYS_AT_ONCE = 1 << 20
#: Hashes of the text's begin and end, which no word has but by chance.
BEGIN, END = 0x5BD1E9955BD1E995, 0xC6A4A7935BD1E995
#: Bits of a key within its bucket: more make the directory longer than the keys.
MOST_BITS = 57


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's words, lower-cased, each document ended by END; and its first token."""
    data = lowered(data)
    starts, ends, at = word_spans(data, bounds)
    n = np.diff(at)
    out = np.full(len(starts) + len(n), U64(END))
    out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = word_hashes(data, starts, ends)
    return out, at + np.arange(len(at))


# ------------------------------------------------------------------- counting


def distinct(bucket: np.ndarray, keys: np.ndarray, bits: int, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of so many bits by bucket, in order, and where each row's is (back) or how often each is there."""
    if bits == 64 or not len(keys):  # the bucket is the upper part of the key, and left to the caller
        return bucket[:0], *np.unique(keys, return_inverse=back, return_counts=not back)[:2]
    if int(bucket.max()).bit_length() + bits <= 64:
        found, more = np.unique((bucket.astype(U64) << U64(bits)) | keys, return_inverse=back, return_counts=not back)[:2]
        return (found >> U64(bits)).astype(np.int64), found & U64((1 << bits) - 1), more
    order = np.lexsort((keys, bucket))
    new = np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(keys[order]) != 0)])
    first = np.flatnonzero(new)
    if back:
        more = np.empty(len(keys), np.int64)
        more[order] = np.cumsum(new) - 1
    else:
        more = np.diff(np.append(first, len(keys)))
    return bucket[order][first], keys[order][first], more


def _blocks(kind: int, bucket: np.ndarray, keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Rows (bucket, kind, data) of keys with columns of unsigned numbers, as narrow as they fit; in order of bucket.

    A key's upper bytes stand apart from the lower four: they are ascending, and so take little room on the way.
    """
    edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).astype(int) if len(bucket) else [0]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = keys[a:b].astype(U64)
        upper = own >> U64(32)
        high = np.min_scalar_type(int(upper[-1]))
        wide = np.min_scalar_type(max(int(c[a:b].max()) for c in columns))
        yield int(bucket[a]), kind, bytes([high.itemsize, wide.itemsize]) + upper.astype(high).tobytes() + own.astype(np.uint32).tobytes() + b"".join(c[a:b].astype(wide).tobytes() for c in columns)


def _read_block(data: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    high, wide = np.dtype(f"u{data[0]}"), np.dtype(f"u{data[1]}")
    n = (len(data) - 2) // (4 + data[0] + data[1] * columns)
    at = 2 + (4 + data[0]) * n
    keys = (np.frombuffer(data, high, n, 2).astype(U64) << U64(32)) | np.frombuffer(data, np.uint32, n, 2 + data[0] * n)
    return keys, [np.frombuffer(data, wide, n, at + data[1] * k * n) for k in range(columns)]


def _merged(blocks: list[bytes], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of the blocks with their columns' sums."""
    if not blocks:
        return np.zeros(0, U64), [np.zeros(0, np.int64)] * columns
    parts = [_read_block(b, columns) for b in blocks]
    keys = np.concatenate([k for k, _ in parts])
    numbers = [np.concatenate([c[k] for _, c in parts]) for k in range(columns)]
    del parts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], [np.add.reduceat(n[order], new, dtype=np.int64) for n in numbers]


_BLOCK = "bucket int, kind int, data binary"
#: GRAMS: keys and counts; CONTEXTS: places of words and their statistics; FOLLOWED: places of n-grams and how many go before them; SIZES and TOTALS: sums.
GRAMS, CONTEXTS, FOLLOWED, SIZES, TOTALS = range(5)


def _rows(rows) -> pa.RecordBatch:
    b, k, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def _counted(docs: DataFrame, model: Model, k: int) -> DataFrame:
    """Blocks of n-grams of k words and their counts."""

    def count(batches):
        own = reader(model)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            rows = list(_blocks(GRAMS, *own.counted(k, *(np.concatenate([h[x] for h in held]) for x in (0, 1)))))
            held.clear()
            for a in range(0, len(rows), 256):
                yield _rows(rows[a : a + 256])

        for _, data, bounds in text_slices(batches):
            tokens, first = tokens_of(data, bounds)
            if k == 1:
                words = np.concatenate([tokens, np.full(len(bounds) - 1, U64(BEGIN))])
                held.append((own.bucket_of_word(words), words))
            else:
                held.append(own.keys(tokens, first, k))
            size += len(data) + len(bounds)
            if size >= COUNT_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(count, _BLOCK)


def _by_bucket(batches) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Blocks of each bucket, from rows in order of bucket."""
    at, held = None, {}
    for b in batches:
        for bucket, kind, data in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
            if bucket != at:
                if held:
                    yield at, held
                at, held = bucket, {}
            held.setdefault(kind, []).append(data)
    if held:
        yield at, held


def discounts(counts: list[float]) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams seen 1, 2, 3 and 4 times.

    Where a number is missing so that the rule gives nothing between 0 and the count, half a count is taken.
    """
    n = [max(float(x), 0.0) for x in counts]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return np.array([0.0, *(d if 0 < d < k + 1 else 0.5 for k, d in enumerate(out))])


@dataclass
class Model:
    """Where the arrays are, and the numbers of the whole corpus.

    bases has for each length of n-gram but the last how many lie before each bucket, from
    length 1 on; last_discounts those of each length from 2 on.
    """

    folder: str
    bits: int
    order: int
    bases: list[np.ndarray]
    tokens: int = 0
    distinct: int = 0
    documents: int = 0
    types: int = 0
    last_discounts: list[np.ndarray] | None = None
    word_discounts: np.ndarray | None = None
    word_left: float = 1.0

    @property
    def width(self) -> int:
        """Bits of a word's number."""
        return max(1, int(self.bases[0][-1]).bit_length())

    def reader(self) -> Reader:
        return Reader(self)


def train(docs: DataFrame, order: int = 2, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts every document's whole text, n-grams of up to order words. No documents: a model that knows no word.

    doc_id and text alone are read; null texts are empty ones; repeated rows count each time.
    bucket_bytes of text make a bucket, which a task holds.
    """
    if order < 2:
        raise ValueError("an order of 2 or more")
    spark = session_setup(docs.sparkSession)
    docs = documents_of(docs)
    size, documents = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = int(np.ceil(np.log2(max((size or 0) / bucket_bytes, 1))))
    parts = 1 << bits
    model = Model(shared_path(spark, "kneser-ney"), bits, order, [])

    def dealt(df):
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def sizes_of(table) -> np.ndarray:  # a small row a bucket
        out = np.zeros(parts + 1, np.int64)
        for r in table.where(F.col("kind") == SIZES).select("bucket", "data").collect():
            out[r["bucket"] + 1] = np.frombuffer(r["data"], np.int64)[0]
        return np.cumsum(out)

    def summed(table, n):
        rows = [np.frombuffer(r[0], np.int64) for r in table.where(F.col("kind") == TOTALS).select("data").collect()]
        return np.sum(rows, axis=0) if rows else np.zeros(n, np.int64)

    def contexts(own, k, bucket, keys, counts):
        """Statistics of the contexts of all n-grams of k words of a bucket, by their counts."""
        which = [counts, counts == 1, counts == 2, counts >= 3]
        at = own.split(k, bucket, keys)[0]
        if k > 2:  # they lie in the same bucket
            lo, hi = own.model.bases[k - 2][bucket : bucket + 2].tolist()
            own.folder.put_counts(f"context{k - 1}-{bucket}", np.stack([np.bincount(at - lo, weights=m, minlength=hi - lo).astype(np.int64) for m in which], axis=1))
        else:
            have, back = np.unique(at, return_inverse=True)
            home, place = own.home(1, have)
            yield from _blocks(CONTEXTS, home, place, [np.bincount(back, weights=m, minlength=len(have)).astype(np.int64) for m in which])
        yield bucket, TOTALS, np.array([(counts == j).sum() for j in (1, 2, 3, 4)] + [len(counts)], np.int64).tobytes()

    def merge(model, k):
        """Stores the n-grams of k words; leaves their number and, of the longest ones, what their contexts have."""

        def run(batches):
            own = reader(model)
            for bucket, held in _by_bucket(batches):
                keys, (n,) = _merged(held[GRAMS], 1)
                own.folder.put_counts(f"n{k}-{bucket}", n)
                if k == 1:
                    own.folder.put(f"gram1-{bucket}", keys)
                else:
                    own.folder.put_keys(f"gram{k}-{bucket}", keys, own.bits(k))
                rows = [(bucket, SIZES, np.array([len(keys)], np.int64).tobytes())]
                if k == order:
                    rows += contexts(own, k, bucket, keys, n)
                for a in range(0, len(rows), 256):
                    yield _rows(rows[a : a + 256])

        return run

    def ends(model, k):
        """Of each stored n-gram's last k - 1 words that they were seen, read from the arrays so that nothing more is written for it."""

        def run(batches):
            own = reader(model)
            for b in batches:
                for bucket in b.column("bucket").to_pylist():
                    table = own.folder.get(f"gram{k}-{bucket}")
                    for first in range(0, 0 if table is None else len(table), KEYS_AT_ONCE):
                        keys = own.folder.keys(f"gram{k}-{bucket}", own.bits(k), np.arange(first, min(first + KEYS_AT_ONCE, len(table))))
                        found, times = np.unique(own.last_words(k, *own.split(k, bucket, keys)), return_counts=True)
                        rows = list(_blocks(FOLLOWED, *own.home(k - 1, found), [times]))
                        for a in range(0, len(rows), 256):
                            yield _rows(rows[a : a + 256])

        return run

    def finish(model, k):
        """Stores the counts that n-grams of k words have as ends of longer ones; those at a text's begin end none and keep their own."""

        def run(batches):
            own = reader(model)
            for bucket, held in _by_bucket(batches):
                lo, hi = own.model.bases[k - 1][bucket : bucket + 2].tolist()
                if lo == hi:
                    continue
                counts = np.zeros(hi - lo, np.int64)
                place, (times,) = _merged(held.get(FOLLOWED, []), 1)
                counts[place.astype(np.int64)] = times
                rows = []
                if k > 1:
                    counts = np.where(counts == 0, own.folder.counts(f"n{k}-{bucket}"), counts)
                    rows += contexts(own, k, bucket, own.folder.keys(f"gram{k}-{bucket}", own.bits(k)), counts)
                else:
                    table = np.zeros((hi - lo, 4), np.int64)
                    place, stats = _merged(held.get(CONTEXTS, []), 4)
                    table[place.astype(np.int64)] = np.stack(stats, axis=1)
                    own.folder.put_counts(f"context1-{bucket}", table)
                    rows.append((bucket, TOTALS, np.array([own.folder.counts(f"n1-{bucket}").sum(), hi - lo] + [(counts == j).sum() for j in (1, 2, 3, 4)] + [(counts > 0).sum()], np.int64).tobytes()))
                own.folder.put_counts(f"followed{k}-{bucket}", counts)
                for a in range(0, len(rows), 256):
                    yield _rows(rows[a : a + 256])

        return run

    tables = {}
    for k in range(1, order + 1):
        tables[k] = written(dealt(_counted(docs, model, k)).mapInArrow(merge(model, k), _BLOCK), f"grams{k}")
        if k < order:
            model = replace(model, bases=[*model.bases, sizes_of(tables[k])])
            if model.reader().bits(k + 1) > MOST_BITS:
                raise ValueError(f"n-grams of {k + 1} words have no keys of {MOST_BITS} bits")
    every = spark.range(parts).select(F.col("id").cast("int").alias("bucket"), F.lit(SIZES).alias("kind"), F.lit(b"").alias("data"))
    done = {order: tables[order]}
    for k in range(order - 1, 0, -1):
        rows = every.union(every.repartition(parts, "bucket").mapInArrow(ends(model, k + 1), _BLOCK))
        if k == 1:
            rows = rows.union(done[2].where(F.col("kind") == CONTEXTS))
        done[k] = written(dealt(rows).mapInArrow(finish(model, k), _BLOCK), f"finished{k}")
    sums = [summed(done[k], 5) for k in range(2, order + 1)]
    word, types = summed(done[1], 7), int(sizes_of(tables[2])[-1])
    by_word = discounts(word[2:6].tolist())
    seen = [word[2], word[3], word[6] - word[2] - word[3]]
    return replace(
        model,
        tokens=int(word[0]) - int(documents),  # each text's begin was counted with the words
        distinct=int(word[6]),
        documents=int(documents),
        types=types,
        last_discounts=[discounts(x[:4].tolist()) for x in sums],
        word_discounts=by_word,
        word_left=float(np.dot(by_word[1:], seen) / types) if types else 1.0,
    )


# -------------------------------------------------------------------- scoring


class Reader:
    """Look-ups in the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.folder = Folder(model.folder)

    def bits(self, k: int) -> int:
        """Bits of the key that an n-gram of k words has in its bucket."""
        m = self.model
        if k == 1:
            return 64
        if k == 2:
            return max(2 * m.width, m.bits + 8) - m.bits
        return max(1, int(np.diff(m.bases[k - 2]).max()).bit_length()) + m.width

    def located(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key of n-grams of k words, by the numbers of all words but the last, and of the last."""
        bits, width = self.bits(k), U64(self.model.width)
        if k == 2:
            whole = spread((context.astype(U64) << width) | word.astype(U64), bits + self.model.bits)
            return (whole >> U64(bits)).astype(np.int64), whole & U64((1 << bits) - 1)
        bucket, place = self.home(k - 1, context)
        return bucket, spread((place.astype(U64) << width) | word.astype(U64), bits)

    def split(self, k: int, bucket: np.ndarray | int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words but the last, and of the last: the inverse of located()."""
        bits, width = self.bits(k), U64(self.model.width)
        if k == 2:
            keys = (np.full(len(keys), bucket).astype(U64) << U64(bits)) | keys
            bits += self.model.bits
        x = unspread(keys, bits)
        context, word = (x >> width).astype(np.int64), (x & U64((1 << self.model.width) - 1)).astype(np.int64)
        return context if k == 2 else context + self.model.bases[k - 2][bucket], word

    def home(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and place in it of numbered n-grams of k words."""
        base = self.model.bases[k - 1]
        bucket = np.searchsorted(base, numbers, "right") - 1
        return bucket, numbers - base[bucket]

    def bucket_of_word(self, hashes: np.ndarray) -> np.ndarray:
        bits = self.model.bits
        return (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)

    def counted(self, k: int, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bucket, key and count of the distinct n-grams, in order."""
        bucket, keys, n = distinct(bucket, keys, self.bits(k), False)
        return (self.bucket_of_word(keys) if k == 1 else bucket), keys, [n]

    @staticmethod
    def _each(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(bucket, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(bucket)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if a < b:
                yield int(bucket[order[a]]), order[a:b]

    def numbers(self, k: int, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of n-grams of k words (of the last length: places in the bucket), -1 where unknown, and, of the first and the last length, their counts."""
        bucket, keys, back = distinct(bucket, keys, self.bits(k), True)
        if k == 1:
            bucket = self.bucket_of_word(keys)
        out, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for b, rows in self._each(bucket):
            if k == 1:
                have = self.folder.get(f"gram1-{b}")
                if have is None or not len(have):
                    continue
                at = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                at = np.where(have[at] == keys[rows], at, -1)
            else:
                at = self.folder.find(f"gram{k}-{b}", self.bits(k), keys[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            out[rows] = at + (self.model.bases[k - 1][b] if k < self.model.order else 0)
            if k in (1, self.model.order) and len(rows):
                n[rows] = self.folder.counts(f"n{k}-{b}", at)
        return out[back], n[back]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words."""
        return self.numbers(1, np.zeros(len(hashes), np.int64), hashes)

    def read(self, name: str, k: int, numbers: np.ndarray, columns: int = 0) -> np.ndarray:
        """Counts of numbered n-grams of k words; zero where the number is -1."""
        numbers, back = np.unique(numbers, return_inverse=True)
        out = np.zeros((len(numbers), columns) if columns else len(numbers), np.int64)
        known = np.flatnonzero(numbers >= 0)
        bucket, place = self.home(k, numbers[known])
        for b, rows in self._each(bucket):
            if (found := self.folder.counts(f"{name}{k}-{b}", place[rows])) is not None:
                out[known[rows]] = found
        return out[back]

    def last_words(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Number of the last k - 1 of k words, given as split() does."""
        if k == 2:
            return word
        numbers, back = np.unique(context, return_inverse=True)
        bucket, place = self.home(k - 1, numbers)
        before, last = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for b, rows in self._each(bucket):
            keys = self.folder.keys(f"gram{k - 1}-{b}", self.bits(k - 1), place[rows])
            before[rows], last[rows] = self.split(k - 1, b, keys)
        middle = self.last_words(k - 1, before, last)[back]
        return self.numbers(k - 1, *self.located(k - 1, middle, word))[0]

    def _context(self, k: int, shorter: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of the k - 1 words before each token, given those that end at each; -1 if there are fewer, or they are unknown."""
        before = np.full_like(shorter, -1)
        before[1:] = shorter[:-1]
        before[first[:-1]] = self.words(np.array([BEGIN], U64))[0][0] if k == 2 else -1
        return before

    def keys(self, tokens: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and keys of all n-grams of k words; texts have one begin, so k - 2 tokens of each end none."""
        word = at = self.words(tokens)[0]
        for j in range(2, k + 1):
            context = self._context(j, at, first)
            known = (context >= 0) & (word >= 0)
            found = self.located(j, context[known], word[known])
            if j < k:
                at = np.full(len(tokens), -1, np.int64)
                at[known] = self.numbers(j, *found)[0]
        return found

    def log_probabilities(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after those before, and its count in training."""
        m = self.model
        word, count = self.words(tokens)
        followed = self.read("followed", 1, word)
        p = np.maximum(followed - m.word_discounts[np.minimum(followed, 3)], 0) / max(m.types, 1) + m.word_left / (m.distinct + 1)
        at = word
        for k in range(2, m.order + 1):
            context = self._context(k, at, first)
            stats = self.read("context", k - 1, context, 4)
            known = (context >= 0) & (word >= 0)
            at, n = np.full(len(tokens), -1, np.int64), np.zeros(len(tokens), np.int64)
            at[known], n[known] = self.numbers(k, *self.located(k, context[known], word[known]))
            if k < m.order:
                n = self.read("followed", k, at)
            less = m.last_discounts[k - 2]
            total, gamma = stats[:, 0], stats[:, 1:] @ less[1:]
            p = np.where(total > 0, (np.maximum(n - less[np.minimum(n, 3)], 0) + gamma * p) / np.maximum(total, 1), p)
        return np.log10(p), count


_readers: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    name = f"{model.folder} {len(model.bases)} {model.last_discounts is None}"  # in training a model grows
    if name not in _readers:
        _readers.clear()
        _readers[name] = model.reader()
    return _readers[name]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    A text's tokens are its words and one end. n_known is how many were seen in
    training. base_score sums log10((c + 1) / (N + V + 1)) over the tokens (c: the
    token's count, N and V: all and distinct training tokens); score is the
    model's log10 probability of the text, and perplexity 10 ** (-score / n_tokens).
    Null and empty texts are one end. Repeated rows are scored each. Rows without doc_id are left out.
    """
    session_setup(docs.sparkSession)

    def run(batches):
        own = reader(model)
        for rows, data, bounds in text_slices(batches, most=SCORE_BYTES):
            tokens, first = tokens_of(data, bounds)
            logs, count = own.log_probabilities(tokens, first)
            at = first[:-1]
            n = np.diff(first)
            got = np.add.reduceat(logs, at)
            known = np.add.reduceat(count > 0, at, dtype=np.int64)
            base = np.add.reduceat(np.log10((count + 1.0) / (model.tokens + model.distinct + 1.0)), at)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(got), pa.array(10 ** np.clip(-got / n, 0, 300))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return documents_of(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
