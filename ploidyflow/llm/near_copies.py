"""Near copies of texts by the Jaccard similarity of their word shingles.

Every distinct text has a fingerprint, a table of its distances to the pivots and a
sketch, its LEAST smallest shingle hashes. Sketch hashes that many texts share
are common. A pair as similar as asked for is met under a rare hash of both (16 rare
ones are keys, 8 where few are common), or, where more than half of a text is common,
under one of 8 common ones; a pair at 0.8 misses by that with a chance of 0.0001 at
most. Under a key, pairs are discarded by their sizes, by their pivot tables and
distance, and by their sketches; the survivors are verified by all of their shingles.

A rare key has a bounded number of texts, so its survivors are written out as pairs.
Under common keys no pairs leave a task: texts are dealt into blocks, a block verifies
its survivors and returns links that connect what is linked. What then isn't
of a key's largest component meets the key's other blocks, so every pair of two
components has been tried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_of, lowered, prefix_sums, range_hash, session_setup, text_slices, word_hashes, word_spans, written
from .components import components
from .simhash import SWEEP_ROWS, fingerprints_of, pivot_table, shingle_hashes, swept_pairs, whole_buckets

#: Smallest shingle hashes in a sketch.
LEAST = 32
#: Texts that share a sketch hash from which on it is common: pairs under a rare key are fewer than the square of it.
COMMON = 128
#: Keys of a text: rare ones (FEW where less than a fifth of its sketch is common, MANY elsewhere), and common ones where more than 0.55 is.
FEW, MANY, SHARED = 8, 16, 8
#: Differing bits up to which pairs survive: at similarity 0.8 their mean is 10, with a deviation of 3. Shorter texts' bits tell too little.
WIDE, TELLING = 26, 16
#: Common sketch hashes, of LEAST, from which on a pair survives: at similarity 0.8 their mean is 25.6, with a deviation of 2.3.
SKETCHED = 14
#: Texts and hashes of a block, and columns of its incidence matrix made at once.
BLOCK_ROWS, BLOCK_HASHES, COLUMNS = 1024, 1 << 21, 4096
#: Ids up to which a semi join broadcasts them (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1 << 20
_NONE = np.iinfo(np.int64).max


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp of the distinct shingles, digest of the words, size (distinct shingles), least (the sketch, ascending)."""

    def make(batches):
        for rows, data, bounds in text_slices(batches):
            raw, at = data.tobytes(), bounds.tolist()
            got = [shingle_hashes(raw[a:b], words) for a, b in zip(at[:-1], at[1:], strict=True)]
            hashes = [np.unique(h.astype(np.uint64)) for h, _ in got]
            low = [(h[:LEAST] >> np.uint64(1)).view(np.int64) for h in hashes]
            columns = [rows.column("doc_id"), pa.array(fingerprints_of(hashes).view(np.int64)), pa.array([hashlib.sha256(x).digest()[:16] for _, x in got], pa.binary()), pa.array([*map(len, hashes)], pa.int32()), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest", "size", "least"])

    return docs.mapInArrow(make, "doc_id bigint, fp bigint, digest binary, size int, least array<bigint>")


def _keyed(reps: DataFrame, common: int) -> DataFrame:
    """node, rare, shared: each text's keys among the sketch hashes that two texts or more have. Texts without any are left out."""
    each = reps.select("node", F.size("least").alias("of"), F.explode("least").alias("key"))
    counts = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (F.col("n") > common).alias("common")), "counts")
    met = each.join(counts, "key").groupBy("node", "of").agg(F.collect_list(F.struct("common", "key")).alias("met"))
    of_kind = lambda kind: F.array_sort(F.transform(F.filter("met", lambda x: x["common"] == F.lit(kind)), lambda x: x["key"]))
    split = met.select("node", "of", of_kind(False).alias("rare"), of_kind(True).alias("shared"))
    few = F.when(F.size("shared") <= F.col("of") * 0.2, FEW).otherwise(MANY)
    most = F.when(F.size("shared") > F.col("of") * 0.55, SHARED).otherwise(0)
    keyed = written(split.select("node", F.slice("rare", F.lit(1), few).alias("rare"), F.slice("shared", F.lit(1), most).alias("shared")), "keyed")
    discard(counts)
    return keyed


# ------------------------------------------------------------ pairs of rare keys


def _padded(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row for each list, padded with a number that no hash has."""
    n = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), width), _NONE)
    out[np.arange(width)[None, :] < n[:, None]] = lists.flatten().to_numpy()
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


_ROWS = "bucket bigint, node bigint, fp bigint, size int, lead int, pivots binary, sketch binary, keys binary"


def _rare_rows(texts: DataFrame) -> DataFrame:
    """A row for each rare key of a text, with what tells its pairs apart."""

    def make(batches):
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            table, rare = pivot_table(fps), b.column("rare")
            row = np.repeat(np.arange(len(b)), np.diff(rare.offsets.to_numpy()))
            take = pa.array(row)
            packed = [_binary(x).take(take) for x in (table, _padded(b.column("least"), LEAST), _padded(rare, MANY))]
            yield pa.RecordBatch.from_arrays([rare.flatten(), *(b.column(x).take(take) for x in ("node", "fp", "size")), pa.array(table[row, 0].astype(np.int32)), *packed], ["bucket", "node", "fp", "size", "lead", "pivots", "sketch", "keys"])

    return texts.mapInArrow(make, _ROWS)


def surviving(bucket: np.ndarray, fps: np.ndarray, table: np.ndarray, size: np.ndarray, least_similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one bucket that neither sizes nor pivots nor bits discard; rows in order of bucket, then first entry.

    Bits are asked of texts of TELLING shingles or more. No pair comes twice.
    """

    def fit(i, j):
        return np.minimum(size[i], size[j]) >= least_similarity * np.maximum(size[i], size[j])

    for rows, radius, short in ((np.flatnonzero(size >= TELLING), WIDE, False), (np.flatnonzero(size * least_similarity < TELLING), 64, True)):
        for i, j, _ in swept_pairs(bucket[rows], fps[rows], table[rows], radius):
            i, j = rows[i], rows[j]
            ok = fit(i, j)
            if short:
                ok &= np.minimum(size[i], size[j]) < TELLING
            yield i[ok], j[ok]


def sketch_overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of sketches, how many of the LEAST smallest hashes of both together are in both, how many those are, and how many hashes they share at all."""
    joined = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = joined != _NONE
    again = np.zeros(joined.shape, bool)
    again[:, 1:] = (joined[:, 1:] == joined[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    within = real & (rank <= LEAST)
    return (again & within).sum(axis=1), np.minimum(rank[:, -1], LEAST), again.sum(axis=1)


def _rare_pairs(rows: DataFrame, least_similarity: float) -> DataFrame:
    """a, b, sure: pairs that survive. Those whose sketches hold all of their shingles are decided: sure."""
    names = ("bucket", "node", "fp", "size", "pivots", "sketch", "keys")

    def sweep(batches):
        for own, _ in whole_buckets(batches, names):
            bucket, node, size = own["bucket"], own["node"], own["size"]
            sketch, keys = (own[x].view(np.int64) for x in ("sketch", "keys"))
            for i, j in surviving(bucket, own["fp"].view(np.uint64), own["pivots"], size, least_similarity):
                for c in range(0, len(i), 1 << 14):
                    x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                    both, of, shared = sketch_overlap(sketch[x], sketch[y])
                    whole = np.maximum(size[x], size[y]) <= LEAST
                    keep = np.where(whole, shared / (size[x] + size[y] - shared) >= least_similarity, both * LEAST >= SKETCHED * of)
                    x, y, whole = x[keep], y[keep], whole[keep]
                    met = np.where((keys[x][:, :, None] == keys[y][:, None, :]).any(axis=2), keys[x], _NONE).min(axis=1)
                    first = met == bucket[x]  # a pair is returned under the first of the keys that it shares
                    x, y = x[first], y[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y])), pa.array(whole[first])], ["a", "b", "sure"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "lead").mapInArrow(sweep, "a bigint, b bigint, sure boolean")


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles, lower-cased."""
    data = lowered(data)
    starts, ends, at = word_spans(data, bounds)
    sums = prefix_sums(word_hashes(data, starts, ends))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        here = np.arange(a, max(b - words + 1, a + (b > a)))
        out.append(np.unique(range_hash(sums, here, np.minimum(here + words, b))))
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; of two empty ones 1."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least_similarity: float) -> DataFrame:
    """Those of the pairs a, b whose whole texts are similar enough."""
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")

    def verify(batches):
        for rows, data, bounds in text_slices(batches):
            for other, own, at in text_slices([rows], "other", 1 << 62):
                s = [similarity(x, y) for x, y in zip(shingle_sets(data, bounds, words), shingle_sets(own, at, words), strict=True)]
                keep = pa.array(np.array(s) >= least_similarity)
                yield pa.RecordBatch.from_arrays([other.column("a").filter(keep), other.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(verify, "a bigint, b bigint")


# --------------------------------------------------------- blocks of common keys


class Block:
    """Texts that are verified against each other in memory."""

    def __init__(self, node: np.ndarray, fp: np.ndarray, component: np.ndarray, sets: list[np.ndarray]):
        self.table = pivot_table(fp)
        order = np.argsort(self.table[:, 0], kind="stable")
        self.node, self.fp, self.table, self.component = node[order], fp[order], self.table[order], component[order]
        self.sets = [sets[k] for k in order.tolist()]
        self.size = np.array([*map(len, self.sets)])


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share, by incidence matrices of the hashes that are in both lists of sets."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    (a, b) = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (rows, columns))
    names = np.intersect1d(a, b)
    places = []
    for flat, sets in ((a, rows), (b, columns)):
        at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
        here = np.flatnonzero(names[at] == flat) if len(names) else np.zeros(0, int)
        owner = np.repeat(np.arange(len(sets)), [*map(len, sets)])[here]
        order = np.argsort(at[here], kind="stable")
        places.append((at[here][order], owner[order]))
    for c in range(0, len(names), COLUMNS):
        pair = []
        for (at, owner), n in zip(places, out.shape, strict=True):
            lo, hi = np.searchsorted(at, (c, c + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(names) - c)), np.float32)
            m[owner[lo:hi], at[lo:hi] - c] = 1
            pair.append(m)
        out += pair[0] @ pair[1].T
    return out


def block_links(own: Block, others: Block | None, least_similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all that is linked within own, or between own and others; components given are connected already."""
    if others is None:
        every, shift = own, 0
    else:
        every, shift = Block(*(np.concatenate([getattr(own, x), getattr(others, x)]) for x in ("node", "fp", "component")), own.sets + others.sets), 1
    bucket = np.zeros(len(every.node), np.int64)
    found = [*surviving(bucket, every.fp, every.table, every.size, least_similarity)]
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    apart = every.component[i] != every.component[j]
    if shift:
        mine = np.isin(every.node, own.node)
        apart &= mine[i] != mine[j]
    i, j = i[apart], j[apart]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, columns = np.unique(i), np.unique(j)
    both = overlaps([every.sets[k] for k in rows.tolist()], [every.sets[k] for k in columns.tolist()])[np.searchsorted(rows, i), np.searchsorted(columns, j)].astype(np.float64)
    linked = both / (every.size[i] + every.size[j] - both) >= least_similarity
    i, j = i[linked], j[linked]
    root = {c: c for c in np.unique(every.component).tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for k, (x, y) in enumerate(zip(every.component[i].tolist(), every.component[j].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(k)
    return np.minimum(every.node[i[out]], every.node[j[out]]), np.maximum(every.node[i[out]], every.node[j[out]])


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node, hashes (8 bytes each, ascending) of every text."""

    def make(batches):
        for rows, data, bounds in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(data, bounds, words)], pa.binary())], ["node", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(make, "node bigint, hashes binary")


_MEMBER = ("bucket", "block", "visits", "node", "fp", "component", "hashes")


def _meet(dealt: DataFrame, block_rows: int, least_similarity: float, among: bool) -> DataFrame:
    """Links of each block: among its members, or between its members and those who visit it, so many at a time."""

    def run(batches):
        key, own, held = None, None, []

        def block(rows):
            node, fp, component, hashes = zip(*rows, strict=True)
            return Block(np.array(node, np.int64), np.array(fp, np.int64).view(np.uint64), np.array(component, np.int64), [np.frombuffer(h, np.uint64) for h in hashes])

        def links():
            """Of what is held, which is then let go."""
            nonlocal own
            visiting = held and held[0][0]
            rows = [x[1:] for x in held]
            held.clear()
            if rows and not visiting:
                own = block(rows)
                if not among:
                    return
                a, b = block_links(own, None, least_similarity)
            elif rows and own is not None:
                a, b = block_links(own, block(rows), least_similarity)
            else:
                return
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for bucket, part, visits, *rest in zip(*(b.column(x).to_pylist() for x in _MEMBER), strict=True):
                if (bucket, part) != key:
                    yield from links()
                    key, own = (bucket, part), None
                elif held and (visits != held[0][0] or visits and len(held) >= block_rows):
                    yield from links()
                held.append((visits, *rest))
        yield from links()

    return dealt.select(*_MEMBER).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "visits").mapInArrow(run, "a bigint, b bigint")


def _common_links(keyed: DataFrame, reps: DataFrame, texts: DataFrame, links: DataFrame, words: int, least_similarity: float, block_rows: int) -> DataFrame:
    """The links given and those that connect, with them, all texts that are linked under a common key."""
    hot = keyed.where("size(shared) > 0").select("node", F.explode("shared").alias("bucket"))
    sets = written(_sets(texts.join(hot.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), words).join(reps.select("node", "fp"), "node").distinct(), "sets")
    sized = hot.join(reps.select("node", "size"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("size") / BLOCK_HASHES)).cast("int")
    parts = sized.groupBy("bucket").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = written(hot.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")

    def met(members: DataFrame, among: bool, name: str) -> DataFrame:
        return written(_meet(members.join(sets, "node"), block_rows, least_similarity, among), name)

    links = links.select("a", "b").union(met(placed.withColumns({"visits": F.lit(False), "component": F.col("node")}), True, "common-links"))
    split = placed.where("blocks > 1")
    if not split.isEmpty():
        named = written(split.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "split")
        largest = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        others = named.join(largest, "bucket").where("component != largest").drop("largest")
        elsewhere = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
        visitors = others.withColumn("block", F.explode(elsewhere))
        links = links.union(met(named.withColumn("visits", F.lit(False)).unionByName(visitors.withColumn("visits", F.lit(True))), False, "visit-links"))
        discard(named)
    discard(placed, sets)
    return links


# ----------------------------------------------------------------------- classes


def _of(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """Rows of docs whose doc_id is among the ids, which are written and distinct: broadcast up to a checked number."""
    ids = ids.select(F.col("node").alias("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left_semi")


def near_copies(docs: DataFrame, words: int = 5, least_similarity: float = 0.8, common: int = COMMON, block_rows: int = BLOCK_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, class_id of every document.

    Documents with the same words (A-Z in lower case) are one class. Other texts are
    linked if their sets of shingles of so many words have that Jaccard similarity
    (0.8 or more) or a higher one, computed from the whole texts; fewer words make one
    shingle of all. class_id is the smallest doc_id reachable. Null and empty texts
    are copies of each other. Repeated rows are returned as often; rows that share a doc_id but
    not the text are one node, linked as either. Rows without doc_id and other columns are left out.
    Empty tables give none.

    common (at most SWEEP_ROWS), block_rows and broadcast_ids (see COMMON, BLOCK_ROWS, BROADCAST_IDS) set how the work is dealt out, not what is found.
    """
    if least_similarity < 0.8:
        raise ValueError("keys are chosen for a similarity of 0.8 or more")
    if not 0 <= common <= SWEEP_ROWS:
        raise ValueError(f"common must be from 0 to {SWEEP_ROWS}, the most rows of a rare key that are swept together")
    session_setup(docs.sparkSession)
    docs = documents_of(docs)
    prints = written(sketches(docs, words), "sketches")
    reps = written(prints.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("least").alias("least")), "reps")
    keyed = _keyed(reps, common)
    rare = keyed.where("size(rare) > 0").select("node", "rare").join(reps.select("node", "fp", "size", "least"), "node")
    pairs = written(_rare_pairs(_rare_rows(rare), least_similarity).distinct(), "pairs")
    unsure = pairs.where("not sure")
    asked = unsure.select(F.col("a").alias("node")).union(unsure.select("b")).union(keyed.where("size(shared) > 0").select("node")).distinct()
    asked = written(asked, "asked")
    texts = written(_of(docs, asked, broadcast_ids), "texts")
    links = written(pairs.where("sure").select("a", "b").union(_verified(unsure, texts, words, least_similarity)), "rare-links")
    links = _common_links(keyed, reps, texts, links, words, least_similarity, block_rows)
    found = components(links)
    named = written(reps.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id")), "named")
    discard(keyed, pairs, asked, texts, reps)
    return prints.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
