"""SimHash fingerprints, and links between near ones by pivot distance tables.

Every distinct fingerprint carries a table of its Hamming distances to many
reference fingerprints (pivots). Two fingerprints at distance r differ by r at
most in each entry, so a pair whose tables differ by more anywhere is discarded
without looking at the fingerprints; the survivors are verified. Pairs are looked
for within buckets: a sweep in order of the first entry meets only rows whose
first entries are near enough.

Linking at a small radius is exact: fingerprints with r differing bits agree on
at least two of r + 2 blocks, so every pair of blocks gives a bucket. A bucket with
more rows than SWEEP_ROWS is handled exactly by other means (see dense_links).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, session_setup, text_slices, written
from .components import components

BITS = 64
SEED = 42
#: Reference fingerprints; any spread-out set does.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 63, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows of a bucket that one sweep takes; of larger ones all rows go another exact way.
SWEEP_ROWS = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> tuple[np.ndarray, bytes]:
    """XXH64 of every shingle of the lower-cased text, and its words joined by spaces.

    Fewer words than a shingle make one of the whole sequence; no words, none.
    """
    parts = text.lower().split()
    joined = b" ".join(parts)
    if not parts:
        return np.zeros(0, np.uint64), joined
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64), joined
    length = np.array([*map(len, parts)]) + 1
    end = np.cumsum(length)
    first = (end - length)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(first, (end[words - 1 :] - 1).tolist(), strict=True)]), ">u8"), joined


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint a list of hashes: a bit is set if it is in over half of them; none: zero."""
    sizes = np.array([len(x) for x in hashes])
    ones = np.zeros((len(hashes), BITS), np.int64)
    if sizes.sum():
        flat = np.concatenate([x.astype(">u8", copy=False) for x in hashes]).astype(">u8", copy=False)
        ends = np.cumsum(sizes)
        for a in range(0, len(flat), BLOCK):
            b = min(a + BLOCK, len(flat))
            bits = np.unpackbits(flat[a:b].view(np.uint8).reshape(-1, 8), axis=1)
            docs = np.flatnonzero((ends > a) & (ends - sizes < b) & (sizes > 0))
            ones[docs] += np.add.reduceat(bits, np.maximum(ends[docs] - sizes[docs] - a, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp of every document."""

    def make(batches):
        for rows, data, bounds in text_slices(batches):
            raw, at = data.tobytes(), bounds.tolist()
            hashes = [shingle_hashes(raw[a:b], words)[0] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints_of(hashes).view(np.int64))], ["doc_id", "fp"])

    return documents_of(docs).mapInArrow(make, "doc_id bigint, fp bigint")


# --------------------------------------------------------------- pivot tables


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to every pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :])


def swept_pairs(bucket: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance) of a bucket within the radius; rows in order of bucket, then first entry."""
    lead = table[:, 0].astype(np.int16)
    live, lag = np.arange(len(fps) - 1), 1
    while len(live):
        live = live[live + lag < len(fps)]
        other = live + lag
        near = (bucket[live] == bucket[other]) & (lead[other] - lead[live] <= radius)
        live, other = live[near], other[near]
        a, b = live, other
        for k in range(1, table.shape[1], 5):  # a few entries discard most, so they go first
            apart = np.abs(table[a, k : k + 5].astype(np.int8) - table[b, k : k + 5].astype(np.int8)).max(axis=1, initial=0)
            a, b = a[apart <= radius], b[apart <= radius]
        distance = np.bitwise_count(fps[a] ^ fps[b])
        same = distance <= radius
        if same.any():
            yield a[same], b[same], distance[same]
        lag += 1


def whole_buckets(batches, names: tuple[str, ...], most: int = SWEEP_ROWS) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Rows of complete buckets, from batches in order of bucket, and whether they are of an over-full one, of more than most rows.

    Holds a batch and so many rows at most.
    """
    kept: dict[str, np.ndarray] | None = None
    over = None  # the over-full bucket that is being passed on

    def column(b, x):
        if pa.types.is_binary(b.column(x).type):
            return np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(len(b), -1)
        return b.column(x).to_numpy()

    for b in batches:
        if not len(b):
            continue
        rows = {x: column(b, x) for x in names}
        if kept is not None:
            rows = {x: np.concatenate([kept[x], rows[x]]) for x in names}
        key = rows["bucket"]
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.diff(edge)
        full = size > most
        full[0] |= over is not None and key[0] == over
        over = key[-1] if full[-1] else None
        done = np.repeat(full, size)
        if done.any():
            yield {x: v[done] for x, v in rows.items()}, True
        ready = ~done
        if not full[-1]:
            ready[edge[-2] :] = False
            kept = {x: v[edge[-2] :] for x, v in rows.items()}
        else:
            kept = None
        if ready.any():
            yield {x: v[ready] for x, v in rows.items()}, False
    if kept is not None:
        yield kept, False


# ------------------------------------------------------- links at a small radius


def _blocks(radius: int) -> list[np.uint64]:
    """Masks of radius + 2 blocks of bits."""
    edges = np.linspace(0, BITS, radius + 3).astype(int).tolist()
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _buckets(nodes: DataFrame, radius: int) -> DataFrame:
    masks = [a | b for a, b in combinations(_blocks(radius), 2)]

    def tables(batches):
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            table = pivot_table(fps)
            flat = pa.array([x.tobytes() for x in table], pa.binary())
            lead = pa.array(table[:, 0].astype(np.int32))
            for k, m in enumerate(masks):
                key = (fps & m) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fps), k, np.int32)), b.column("fp"), b.column("node"), lead, flat], ["bucket", "which", "fp", "node", "lead", "pivots"])

    return nodes.mapInArrow(tables, "bucket bigint, which int, fp bigint, node bigint, lead int, pivots binary")


def dense_links(dense: DataFrame, radius: int = 2) -> DataFrame:
    """Links between fingerprints of over-full buckets. Radius 2: two are linked if and only if some value
    is at distance 1 or 0 of both; a value has 65 such fingerprints at most. Radius 1: each is looked for
    among the others with a bit flipped. Distinct fingerprints have no links at radius 0."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(-(1 << 63) if k == 63 else 1 << k).cast("bigint") for k in range(BITS)])
    around = dense.select("node", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))
    if radius < 2:
        own = dense.select(F.col("node").alias("b"), F.col("fp").alias("value"))
        return around.withColumnRenamed("node", "a").join(own, "value").where("a < b").select("a", "b").where(F.lit(radius == 1))
    groups = around.groupBy("value").agg(F.min("node").alias("a"), F.collect_set("node").alias("nodes"))
    return groups.where("size(nodes) > 1").select("a", F.explode("nodes").alias("b")).where("a != b")


def near_links(nodes: DataFrame, radius: int = 2, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Links a, b between nodes whose distinct fingerprints differ in so many bits at most (2, or fewer)."""
    masks = [a | b for a, b in combinations(_blocks(radius), 2)]

    def sweep(batches):
        for rows, dense in whole_buckets(batches, ("bucket", "which", "fp", "node", "pivots"), sweep_rows):
            fps, node = rows["fp"].view(np.uint64), rows["node"]
            if dense:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rows["fp"]), pa.array(np.ones(len(node), bool))], ["a", "b", "dense"])
                continue
            for i, j, _ in swept_pairs(rows["bucket"], fps, rows["pivots"], radius):
                differ = fps[i] ^ fps[j]
                first = np.argmax(np.stack([differ & m == 0 for m in masks]), axis=0) == rows["which"][i]
                yield pa.RecordBatch.from_arrays([pa.array(node[i][first]), pa.array(node[j][first]), pa.array(np.zeros(int(first.sum()), bool))], ["a", "b", "dense"])

    dealt = _buckets(nodes, radius).repartition("bucket").sortWithinPartitions("bucket", "lead")
    found = written(dealt.mapInArrow(sweep, "a bigint, b bigint, dense boolean"), "swept")
    dense = found.where("dense").select(F.col("a").alias("node"), F.col("b").alias("fp")).distinct()
    links = found.where("not dense").select("a", "b")
    return links.union(dense_links(dense, radius))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Texts are lower-cased (A-Z) and cut into words [^ \\t-\\r]+. Documents whose
    fingerprints differ in at most radius (0 to 2) bits are linked; component_id is
    the smallest doc_id reachable. Null, empty and blank texts have fingerprint
    zero and are linked like any other. Repeated rows are returned as often.
    Equal fingerprints are folded first, so copies make no pairs. Rows without doc_id are left out.
    Buckets of more than sweep_rows fingerprints are linked by other means, to the same end.
    """
    if not 0 <= radius <= 2:
        raise ValueError("exact linking is for a radius of 0, 1 or 2")
    session_setup(docs.sparkSession)
    prints = written(fingerprints(docs, words), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(near_links(nodes, radius, sweep_rows))
    named = written(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
