"""Documents that repeat benchmark passages, by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case. A
document and an item meet if they share seeds, windows of so many words whose
rolling (Karp-Rabin) hash is equal. Seeds that follow each other on a diagonal
make a match; the longest match whose words are still free on both sides is
marked as a tile, again and again, what is left of a match that overlaps a tile
coming back as a shorter one. The tiles' share of the item's words is its
coverage, so a passage whose parts were reordered is caught as well.

Seeds meet in a join by hash. A document's seeds pass a bit filter of all items' first.
Of an item those seeds that make the most pairs (in how many documents, times in how many items) are left out of
the join, as many as a document that covers the item can't do without; a pair whose seeds that met
are too few for the coverage is gone, too. The pairs left are tiled from their whole texts.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, discard, documents_of, mixed, prefix_sums, range_hash, session_setup, text_slices, word_hashes, word_spans, written

#: Bits of the filter to a seed, and the most of all, as powers of 2 (16 MB): with more seeds it lets more through, and the join decides.
FILTER_BITS, MOST_FILTER_BITS = 6, 27
#: Ids of documents up to which a semi join broadcasts them (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Pairs of equal seeds of a document and an item that are looked at at once.
RUN_PAIRS = 1 << 20
_BASE = 0xC2B2AE3D27D4EB4F
_INV = pow(_BASE, -1, 1 << 64)
#: Letters and digits in lower case, other ASCII as a space.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_PLAIN[65:91] += 32


def word_sequence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and how many come before each document."""
    data = _PLAIN[data]
    starts, ends, at = word_spans(data, bounds)
    return word_hashes(data, starts, ends), at


def seed_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums, here = prefix_sums(words, _BASE, _INV), np.arange(len(words) - n + 1)
    return range_hash(sums, here, here + n, _BASE, _INV)


def seed_keys(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes as keys of the join, in which seeds of different lengths differ."""
    return mixed(seed_hashes(words, n) ^ U64(n))


class Filter:
    """Two bits for each key; what lacks one is no key."""

    def __init__(self, log_bits: int, data: bytes):
        self.log_bits, self.data = log_bits, np.frombuffer(data, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the slice that the upper six bits of a key name."""
        own = U64(log_bits - 6)
        return (keys << U64(6)) >> (U64(64) - own), (keys << (U64(6) + own)) >> (U64(64) - own)

    def has(self, keys: np.ndarray) -> np.ndarray:
        base, out = (keys >> U64(58)) << U64(self.log_bits - 6), np.ones(len(keys), bool)
        for x in self.places(keys, self.log_bits):
            x = base | x
            out &= (self.data[x >> U64(3)] >> (x & U64(7)).astype(np.uint8)) & 1 > 0
        return out


def key_filter(keys: DataFrame) -> Filter:
    """The filter of all keys, which are written: made slice by slice, so the driver gets its bounded size."""
    n = max(keys.count(), 1)
    log_bits = min(MOST_FILTER_BITS, max(12, int(n).bit_length() + FILTER_BITS))

    def fill(batches):
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            key = b.column("key").to_numpy().view(U64)
            part = (key >> U64(58)).astype(int)
            for k in np.unique(part).tolist():
                bits = slices.setdefault(k, np.zeros(1 << log_bits - 9, np.uint8))
                for x in Filter.places(key[part == k], log_bits):
                    np.bitwise_or.at(bits, x >> U64(3), np.uint8(1) << (x & U64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([*slices], pa.int32()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], ["slice", "bits"])

    rows = keys.select("key").repartition(64, F.shiftrightunsigned("key", 58)).mapInArrow(fill, "slice int, bits binary").collect()
    have = {r["slice"]: bytes(r["bits"]) for r in rows}
    empty = bytes(1 << log_bits - 9)
    return Filter(log_bits, b"".join(have.get(k, empty) for k in range(64)))


def shared_runs(have: np.ndarray, order: np.ndarray, first: np.ndarray, times: np.ndarray, want: np.ndarray, most: int = RUN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal diagonal runs of equal seeds: place in the item, place in the document, seeds that follow each other.

    have and want are the seeds of document and item, order sorts have, and seed k of the item has times[k] equals from order[first[k]] on.
    A pair begins a run if the pair before it differs, and ends one if the next does, so pairs are looked at a bounded
    number at a time and only the ends of runs are kept.
    """
    begins, finishes = [], []
    upto = np.cumsum(times)
    a = 0
    while a < len(want):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        n = times[a:b]
        spots = np.repeat(np.arange(a, b), n)
        place = order[np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(len(spots))]
        edge = (spots == 0) | (place == 0)
        new = edge | (want[spots - 1] != have[place - 1])
        edge = (spots == len(want) - 1) | (place == len(have) - 1)
        last = edge | (want[np.minimum(spots + 1, len(want) - 1)] != have[np.minimum(place + 1, len(have) - 1)])
        begins.append((spots[new], place[new]))
        finishes.append((spots[last], place[last]))
        a = b
    if not begins:
        return (np.zeros(0, np.int64),) * 3

    def sorted_ends(ends):
        spots, place = (np.concatenate([x[k] for x in ends]) for k in (0, 1))
        by = np.lexsort((place, place - spots))
        return spots[by], place[by]

    (item, doc), (_, finish) = sorted_ends(begins), sorted_ends(finishes)
    return item, doc, finish - doc + 1


def tiled_words(item_at: np.ndarray, doc_at: np.ndarray, seeds: np.ndarray, seed: int, n_item: int, n_doc: int) -> int:
    """Words of the item that greedy tiling marks, from the runs of shared seeds.

    Longest first; ties to the earlier place in the item, then in the document. Once no free stretch of the item is as long as a seed nothing can follow.
    """
    size = seeds + seed - 1
    by = np.lexsort((doc_at, item_at, -size))
    queue: list[tuple[int, int, int]] = []  # what is left of runs that overlap a tile
    used_item, used_doc, total, k = bytearray(n_item), bytearray(n_doc), 0, 0
    while k < len(by) or queue:
        head = None
        if k < len(by):
            j = by[k]
            head = (-int(size[j]), int(item_at[j]), int(doc_at[j]))
        if queue and (head is None or queue[0] < head):
            head = heapq.heappop(queue)
        else:
            k += 1
        n, i, a = -head[0], head[1], head[2]
        if used_item.find(1, i, i + n) < 0 and used_doc.find(1, a, a + n) < 0:
            used_item[i : i + n] = used_doc[a : a + n] = b"\1" * n
            total += n
            if max(map(len, used_item.split(b"\1"))) < seed:
                break
            continue
        run = 0
        for x in range(n + 1):
            if x < n and not used_item[i + x] and not used_doc[a + x]:
                run += 1
                continue
            if run >= seed:
                heapq.heappush(queue, (-run, i + x - run, a + x - run))
            run = 0
    return total


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, digest, words (8 bytes each) of every item that has words."""

    def make(batches):
        for rows, data, bounds in text_slices(batches):
            words, at = word_sequence(data, bounds)
            raw = [words[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array([hashlib.sha256(x).digest()[:16] for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["item_id", "digest", "words"])
            yield out.filter(pa.array([bool(x) for x in raw], pa.bool_()))

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    return items.mapInArrow(make, "item_id bigint, digest binary, words binary")


def _seeds(sequences: DataFrame, seed: int) -> DataFrame:
    """item, key, times of every item's distinct seeds; an item of fewer words is a seed of its own."""

    def make(batches):
        for b in batches:
            out = []
            for item, raw in zip(b.column("item").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = np.frombuffer(raw, U64)
                keys, times = np.unique(seed_keys(words, min(seed, len(words))), return_counts=True)
                out.append((np.full(len(keys), item), keys.view(np.int64), times))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)])) for k in range(3)], ["item", "key", "times"])

    return sequences.mapInArrow(make, "item bigint, key bigint, times bigint")


def _hits(docs: DataFrame, lengths: list[int], keys: Filter) -> DataFrame:
    """doc_id, key: each document's distinct seeds that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def find(batches):
        for rows, data, bounds in text_slices(batches):
            words, at = word_sequence(data, bounds)
            ids = rows.column("doc_id").to_numpy()
            for n in lengths:
                key = seed_keys(words, n)
                place = np.flatnonzero(shared.value.has(key))
                doc = np.searchsorted(at, place, "right") - 1
                fits = place + n <= at[doc + 1]
                place, doc = place[fits], doc[fits]
                order = np.lexsort((key[place], doc))
                k, d = key[place][order], doc[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids[d[new]]), pa.array(k[new].view(np.int64))], ["doc_id", "key"])

    return docs.mapInArrow(find, "doc_id bigint, key bigint")


def _tiled(texts: DataFrame, pairs: DataFrame, seed: int, coverage: float) -> DataFrame:
    """doc_id, item, n_matched, n_words of the pairs that are tiled to the coverage: a document's texts come first, then its items stream past."""
    own = texts.select("doc_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("item"), F.col("text").cast("binary").alias("data"))
    asked = pairs.select("doc_id", F.lit(1).alias("kind"), "item", F.col("words").alias("data"))

    def match(batches):
        doc, held, sorted_seeds = None, [], {}
        for b in batches:
            out = []
            for doc_id, kind, item, data in zip(*(b.column(x).to_pylist() for x in ("doc_id", "kind", "item", "data")), strict=True):
                if doc_id != doc:
                    doc, held, sorted_seeds = doc_id, [], {}
                if kind == 0:
                    text = np.frombuffer(data, np.uint8)
                    held.append(word_sequence(text, np.array([0, len(text)]))[0])
                    continue
                words = np.frombuffer(data, U64)
                n = min(seed, len(words))
                if n not in sorted_seeds:
                    hashes = [seed_hashes(w, n) for w in held]
                    orders = [np.argsort(h, kind="stable") for h in hashes]
                    sorted_seeds[n] = [(h, h[o], o) for h, o in zip(hashes, orders, strict=True)]
                want = seed_hashes(words, n)
                for have, hashes, order in sorted_seeds[n]:
                    first, last = (np.searchsorted(hashes, want, side) for side in ("left", "right"))
                    times = last - first
                    least = np.zeros(len(words) + 1, np.int64)
                    found = np.flatnonzero(times)
                    np.add.at(least, found, 1)
                    np.add.at(least, found + n, -1)
                    if (np.cumsum(least[:-1]) > 0).sum() < coverage * len(words):
                        continue  # even all seeds together cover less
                    runs = shared_runs(have, order, first, times, want)
                    tiled = tiled_words(*runs, n, len(words), len(have) + n - 1)
                    if tiled >= coverage * len(words):
                        out.append((doc_id, item, tiled, len(words)))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item", "n_matched", "n_words"])

    return own.union(asked).repartition("doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(match, "doc_id bigint, item bigint, n_matched bigint, n_words bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, item_id, n_matched, n_words, coverage of each document and item tiled to that coverage or more.

    Null texts are empty ones. Items of fewer words than a seed are a seed of their
    own, so they match where they occur whole; items without words match nothing;
    copies of an item are matched once and reported each, copies of a document are reported each. Repeated rows give
    repeated results. Other columns, and rows without doc_id or item_id, are left out. Empty tables give none.
    """
    session_setup(docs.sparkSession)
    docs = documents_of(docs)
    items = written(_items(benchmark), "items")
    sequences = written(items.groupBy("digest").agg(F.first("words").alias("words")).select("digest", "words", F.xxhash64("digest").alias("item")), "sequences")
    size = (F.length("words") / 8).cast("int")
    lengths = sorted(r[0] for r in sequences.select(F.least(size, F.lit(seed))).distinct().collect())  # so many as a seed has words
    seeds = written(_seeds(sequences, seed), "seeds")
    hits = written(_hits(docs, lengths, key_filter(seeds)), "hits")
    # seeds an item needn't meet by: the commonest, as long as a document that covers the item must have another
    pairs_of = hits.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).join(seeds.groupBy("key").agg(F.count(F.lit(1)).alias("items")), "key").select("key", (F.col("docs") * F.col("items")).alias("pairs"))
    needed = F.ceil(F.ceil(F.lit(coverage) * size) / F.least(size, F.lit(seed)))
    commonest = Window.partitionBy("item").orderBy(F.desc("pairs"), "key")  # an item's seeds
    ranked = seeds.join(sequences.select("item", needed.alias("needed")), "item").join(pairs_of, "key")
    ranked = ranked.withColumn("passed", F.sum("times").over(commonest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = written(ranked.where("passed >= needed").select("key", "item", "times"), "kept")
    left_out = ranked.where("passed < needed").groupBy("item").agg(F.sum("times").alias("left_out"))
    need = sequences.select("item", needed.alias("needed")).join(left_out, "item", "left").select("item", (F.col("needed") - F.coalesce("left_out", F.lit(0))).alias("need"))
    met = hits.join(kept, "key").groupBy("doc_id", "item").agg(F.sum("times").alias("met"))
    pairs = written(met.join(need, "item").where("met >= need").select("doc_id", "item"), "pairs")
    ids = written(pairs.select("doc_id").distinct(), "ids")
    texts = docs.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left_semi")
    found = written(_tiled(texts, pairs.join(sequences.select("item", "words"), "item"), seed, coverage), "tiled")
    discard(seeds, hits, kept, pairs, ids)
    named = found.join(sequences.select("item", "digest"), "item").join(items.select("item_id", "digest"), "digest")
    return named.select("doc_id", "item_id", "n_matched", "n_words", (F.col("n_matched") / F.col("n_words")).alias("coverage"))
