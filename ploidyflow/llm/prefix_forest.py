"""Nearest neighbours by cosine with a forest of hash prefixes.

In each tree a vector's hash is a long string of signs against random
hyperplanes. The sorted strings of a tree are parted into leaves: prefixes of
variable length, split where a bounded sample is dense. A query descends to the
leaf of its longest prefix match, then ascends in all trees together: the length of the
prefix that is asked for falls a letter at a time, tree after tree, and the leaves below it are taken
until all together hold enough different rows. All rows in them
are compared by exact cosine; each task keeps a query's few best, and those of
all tasks are merged. A leaf's rows are dealt into parts that a task holds; queries stream past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session_setup, written

#: Letters of a hash string.
DEPTH = 32
#: Vectors in the sample that shapes the leaves; the index itself holds every row.
SAMPLE = 20_000
#: Leaves of a tree aimed at, and rows of a part of a leaf: a leaf that holds more (one value may fill it) is dealt into parts.
LEAVES = 256
PART_ROWS = 1 << 15
#: Candidates that a query meets at least, for each of its k nearest, unless their number is given: a small table is searched whole.
LEAST = 512
#: Queries whose leaves are put in order, and rows multiplied, at once.
ASKED, BLOCK = 256, 2048


def planes(dimension: int, trees: int, seed: int = 8) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, trees * DEPTH))


def projected(vectors: np.ndarray, trees: int) -> np.ndarray:
    """Distance of each vector to every letter's hyperplane, by tree."""
    return (vectors @ planes(vectors.shape[1], trees)).reshape(len(vectors), trees, DEPTH)


def hash_strings(letters: np.ndarray) -> np.ndarray:
    """A row for each vector: its string in every tree, as a number whose first letter is the top bit."""
    return np.packbits(letters > 0, axis=2).view(">u4").astype(np.int64)[:, :, 0]


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vec_id, vectors in double precision) of the usable rows, one dimension at a time.

    Null, empty and zero vectors and those with a null or non-finite component are left out.
    """
    lists = batch.column("embedding")
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == d)
        flat = pc.list_flatten(lists.take(pa.array(rows))).cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
        ok = np.isfinite(x).all(axis=1)
        ok[ok] = (x[ok] != 0).any(axis=1)
        if ok.any():
            yield ids[rows[ok]], x[ok]


class Leaves:
    """Leaves of each tree of one dimension, with the share of all rows in each, from a sample."""

    def __init__(self, strings: np.ndarray, rows: int, part_rows: int = PART_ROWS):
        self.rows, self.trees, self.part_rows = rows, strings.shape[1], part_rows
        want = max(8, math.ceil(len(strings) / LEAVES))
        self.starts, self.share, prefixes = [], [], []
        for t in range(self.trees):
            x = np.sort(strings[:, t])
            first, depth = self._split(x, want)
            self.starts.append(first)
            self.share.append(np.diff(np.append(np.searchsorted(x, first), len(x))) / max(len(x), 1))
            letters = np.unpackbits(first.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1).astype(np.int8)
            letters[np.arange(DEPTH)[None, :] >= depth[:, None]] = -1
            prefixes.append(letters)
        self.prefixes = prefixes

    @staticmethod
    def _split(x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """First strings of the leaves, ascending, and lengths of their prefixes: a prefix is split while its sample rows exceed want."""
        out, todo = [], [(0, 0)]
        while todo:
            first, depth = todo.pop()
            width = 1 << (DEPTH - depth)
            n = np.searchsorted(x, first + width) - np.searchsorted(x, first)
            if n > want and depth < DEPTH:
                todo += [(first + width // 2, depth + 1), (first, depth + 1)]
            else:
                out.append((first, depth))
        return tuple(np.array(c, np.int64) for c in zip(*sorted(out), strict=True))

    def leaf(self, tree: int, strings: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[tree], strings, "right") - 1

    def parts(self, tree: int) -> np.ndarray:
        """Into how many parts each leaf's rows are dealt."""
        return np.maximum(1, np.ceil(self.share[tree] * self.rows / self.part_rows)).astype(np.int64)

    def matched(self, letters: np.ndarray, tree: int) -> np.ndarray:
        """Letters that each leaf's prefix has in common with each query's string; DEPTH for the leaf that the query lies in."""
        prefixes = self.prefixes[tree]
        differs = (prefixes[None] != (letters[:, tree, None] > 0)) & (prefixes[None] >= 0)
        return np.where(differs.any(axis=2), differs.argmax(axis=2), DEPTH)

    def ascended(self, letters: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, tree, leaf) of all that queries search, some queries at a time.

        The frontier is a length of prefix in every tree. It falls in all trees by one letter, in one after another, before it falls
        by the next, and stops where what lies below it holds the share of all rows, each counted once: trees are
        independent, so a row is below it in none with the product of the chances.
        """
        for c in range(0, len(letters), ASKED):
            own = letters[c : c + ASKED]
            match = [self.matched(own, t) for t in range(self.trees)]
            below = np.zeros((self.trees, DEPTH + 2, len(own)))  # share of all rows by least match
            for t in range(self.trees):
                for x in range(DEPTH + 1):
                    below[t, x] = ((match[t] >= x) * self.share[t]).sum(axis=1)
            missed = np.log1p(-np.minimum(below, 1 - 1e-12))
            frontier = np.full((self.trees, len(own)), DEPTH)
            going = np.ones(len(own), bool)
            held = missed[:, DEPTH].sum(axis=0)
            for x in range(DEPTH - 1, -1, -1):
                for t in range(self.trees):
                    going &= held > np.log1p(-min(share, 1 - 1e-9))
                    frontier[t, going] = x
                    held = np.where(going, held + missed[t, x] - missed[t, x + 1], held)
            for t in range(self.trees):
                asked, leaf = np.nonzero(match[t] >= frontier[t][:, None])
                yield c + asked, np.full(len(asked), t), leaf


def _sampled_leaves(vectors: DataFrame, trees: int, part_rows: int) -> dict[int, Leaves]:
    """Leaves by dimension. The sample's size is bounded; the counts are of all rows."""
    counts = {d: n for d, n in vectors.groupBy(F.size("embedding")).count().collect() if d and d > 0}  # one row a dimension
    out = {}
    for d, n in counts.items():
        share = min(1.0, SAMPLE / n)
        chosen = vectors.where((F.size("embedding") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)).limit(2 * SAMPLE)
        rows = [x for b in chosen.select("vec_id", "embedding").toArrow().to_batches() for x in vectors_of(b)]
        if rows:
            out[d] = Leaves(np.concatenate([hash_strings(projected(x, trees)) for _, x in rows]), n, part_rows)
    return out


def nearest(vectors: DataFrame, query_every: int = 50, k: int = 5, trees: int = 8, share: float = 0.72, candidates: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query, nearest first.

    Queries are the rows whose vec_id is divisible by query_every; candidates are
    all rows but the query's own. Nearness is the largest cosine in double
    precision, ties go to the smaller vec_id. The leaves that a query searches
    hold so large a share of all rows, each counted once (a row may be compared in
    several trees), or, if given, so many candidates: a number that needn't grow with the table
    where near vectors are much nearer than others. A part of a leaf has about part_rows rows. Vectors that are null, empty or zero or hold null or non-finite
    components take no part; vectors of different dimensions never meet. Repeated
    rows count once. Fewer than k candidates give fewer rows; none give none.
    """
    session_setup(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    shared = vectors.sparkSession.sparkContext.broadcast(_sampled_leaves(vectors, trees, part_rows))  # some LEAVES prefixes a tree

    def deal(batches):
        for b in batches:
            for ids, x in vectors_of(b):
                forest = shared.value.get(x.shape[1])
                if forest is None:
                    continue
                letters = projected(x, trees)
                strings, asks = hash_strings(letters), np.flatnonzero(ids % query_every == 0)
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                base = (x.shape[1] * trees + np.arange(trees)) << 40
                parts = [forest.parts(t) for t in range(trees)]
                for t in range(trees):
                    leaf = forest.leaf(t, strings[:, t])
                    yield _dealt(base[t] + (leaf << 20) + ids % parts[t][leaf], np.zeros(len(ids), np.int8), ids, raw)
                for who, tree, leaf in forest.ascended(letters[asks], candidates / forest.rows if candidates else max(share, LEAST * k / forest.rows)):
                    n = np.concatenate(parts)[np.cumsum([0, *map(len, parts)])[tree] + leaf]
                    each = np.repeat(np.arange(len(who)), n)
                    part = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    for c in range(0, len(each), 1 << 12):
                        e = each[c : c + (1 << 12)]
                        w = asks[who[e]]
                        yield _dealt(base[tree[e]] + (leaf[e] << 20) + part[c : c + (1 << 12)], np.ones(len(w), np.int8), ids[w], raw.take(pa.array(w)))

    def meet(batches):
        for queries, asked, rows, ids in _met(batches):
            yield from _best(queries, asked, rows, ids, k)

    dealt = vectors.mapInArrow(deal, "leaf bigint, kind tinyint, vec_id bigint, vector binary")
    met = dealt.repartition("leaf").sortWithinPartitions("leaf", "kind").mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = written(met, "met").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(leaf: np.ndarray, kind: np.ndarray, ids: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
    """kind: 0 for rows, 1 for queries, which come after them."""
    return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(kind), pa.array(ids), raw], ["leaf", "kind", "vec_id", "vector"])


def _met(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, their ids, rows, their ids) of a leaf's part: a batch of its queries by some of its rows."""
    leaf, rows, ids = None, [], []
    for b in batches:
        key, kind, own = b.column("leaf").to_numpy(), b.column("kind").to_numpy(), b.column("vec_id").to_numpy()
        raw = b.column("vector")
        edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(key)]]).tolist()
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if a == z:
                continue
            if key[a] != leaf:
                leaf, rows, ids = key[a], [], []
            x = np.frombuffer(b"".join(raw.slice(a, z - a).to_pylist()), np.float64).reshape(z - a, -1)
            if kind[a] == 0:
                rows.append(x)
                ids.append(own[a:z])
            elif rows:
                rows, ids = [np.concatenate(rows)], [np.concatenate(ids)]
                for c in range(0, len(rows[0]), BLOCK):
                    yield x, own[a:z], rows[0][c : c + BLOCK], ids[0][c : c + BLOCK]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, the same for the same two vectors wherever they stand."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _best(queries: np.ndarray, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ unit.T
    near[asked[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
        i, j = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
    else:
        i, j = np.nonzero(np.isfinite(near))
    score = cosines(queries[i], rows[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    new = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    place = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(i) else i
    keep = place < k
    yield pa.RecordBatch.from_arrays([pa.array(asked[i[keep]]), pa.array(ids[j[keep]]), pa.array(score[keep])], ["query_id", "vec_id", "score"])
