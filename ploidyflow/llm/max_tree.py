"""Ranked lexical search: the documents of the highest scores for each item, found by branch and bound.

Documents are indexed in ranges (as many documents a row as stand together). A range holds, term by
term, the documents that have the term and how often, and above them a tree of maxima: for each term the highest
impact in each leaf of a few documents, in each node of some leaves, and in the whole range. What an item's terms weigh times the maxima of a node, summed,
bounds the score of every document under it. The search of a range begins at its root and opens the node of the highest bound first,
down to documents; it ends when the highest bound is below the item's least kept score. A node whose bound equals
it is opened, too, as a tie may have a smaller doc_id.

A worker's task keeps the best documents of each item as it goes from range to range, so most ranges are left at their root.
Items come in blocks of bounded size, each sent to all ranges; the index holds their terms alone, found by a bit
filter of bounded size. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, arrow_rows, discard, documents_of, list_array, session_setup, text_slices, written
from .tiling import Filter, key_filter, word_sequence

#: Documents of a leaf, leaves of a node (both powers of 2), and documents and postings of a range at most.
LEAF_DOCS, NODE_LEAVES = 16, 8
RANGE_DOCS, RANGE_POSTINGS = 1024, 1 << 19
#: Ranges read into a worker at once.
RANGES_AT_ONCE = 4
#: Leaves that are opened in one step, if their bounds ask for it.
LEAVES_AT_ONCE = 4
#: Terms of the items of a block, about, and the most terms that are broadcast (16 bytes each) to meet the items.
BLOCK_TERMS = BROADCAST_TERMS = 1 << 20


# ---------------------------------------------------------------------- items


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a number of each row), item_id, terms, times of the rows that have terms."""

    def make(batches):
        part, done = TaskContext.get().partitionId(), 0
        for rows, data, bounds in text_slices(batches):
            words, at = word_sequence(data, bounds)
            own = [np.unique(words[a:b], return_counts=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            sizes = np.array([len(k) for k, _ in own])
            terms, times = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            number = pa.array(np.arange(done, done + len(own)) + (part << 32))
            out = pa.RecordBatch.from_arrays([number, rows.column("item_id"), list_array(terms.view(np.int64), sizes, pa.int64()), list_array(times, sizes, pa.int64())], ["item", "item_id", "terms", "times"])
            yield out.filter(pa.array(sizes > 0))
            done += len(own)

    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return asked.mapInArrow(make, "item bigint, item_id bigint, terms array<bigint>, times array<bigint>")


# ---------------------------------------------------------------------- index


def _ranges(docs: DataFrame, keys: Filter, range_docs: int, range_postings: int) -> DataFrame:
    """n_docs, n_terms (documents with terms and all their terms), ids, sizes (terms) of the documents of each range that have a term of the filter; and its terms: keys, ascending, firsts (places in the postings), and the postings' documents (places in the range) and times, by term, then document."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    names = ["n_docs", "n_terms", "ids", "sizes", "keys", "firsts", "docs", "times"]

    class Range:
        def __init__(self):
            self.n_docs = self.n_terms = self.size = self.postings = 0
            self.parts = []

        def add(self, ids, sizes, doc, key, times):
            self.parts.append((ids, sizes, doc + self.size, key, times))
            self.size += len(ids)
            self.postings += len(key)

        def batch(self):
            ids, sizes, doc, key, times = (np.concatenate([np.zeros(0, kind), *(x[k] for x in self.parts)]) for k, kind in enumerate((np.int64, np.int64, np.int64, U64, np.int64)))
            by = np.lexsort((doc, key))
            keys, firsts = np.unique(key[by], return_index=True)
            packed = [ids.astype("<i8"), sizes.astype("<i8"), keys.astype("<u8"), np.append(firsts, len(key)).astype("<i4"), doc[by].astype("<i4"), times[by].astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([self.n_docs]), pa.array([self.n_terms]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names)

    def index(batches):
        own = Range()
        for rows, data, bounds in text_slices(batches):
            words, at = word_sequence(data, bounds)
            ids, sizes = rows.column("doc_id").to_numpy(), np.diff(at)
            own.n_docs += int((sizes > 0).sum())
            own.n_terms += len(words)
            place = np.flatnonzero(shared.value.has(words))
            doc, key = np.searchsorted(at, place, "right") - 1, words[place]
            by = np.lexsort((key, doc))
            doc, key = doc[by], key[by]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(key)))
            has, local = np.unique(doc[new], return_inverse=True)
            own.add(ids[has], sizes[has], local.astype(np.int64), key[new], times)
            if own.size >= range_docs or own.postings >= range_postings:
                yield own.batch()
                own = Range()
        if own.n_docs:
            yield own.batch()

    kinds = "n_docs bigint, n_terms bigint, " + ", ".join(f"{x} binary" for x in names[2:])
    return docs.mapInArrow(index, kinds)


def _in_documents(ranges: DataFrame) -> DataFrame:
    """key, df: in how many documents each indexed term is."""

    def count(batches):
        for b in batches:
            for keys, firsts in zip(b.column("keys").to_pylist(), b.column("firsts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.diff(np.frombuffer(firsts, "<i4").astype(np.int64)))], ["key", "n"])

    return ranges.select("keys", "firsts").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("df"))


# --------------------------------------------------------------------- search


class Maxima:
    """Of each term the highest impact in each part of a range that it occurs in, parts being 2**shift documents."""

    def __init__(self, firsts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, shift: int):
        part = docs >> shift
        new = np.ones(len(docs), bool)
        new[1:] = part[1:] != part[:-1]
        new[firsts[:-1]] = True
        #: First posting of each group of a term and a part, and one more place.
        self.postings = np.append(np.flatnonzero(new), len(docs))
        self.part, self.most = part[new], np.maximum.reduceat(impacts, self.postings[:-1])
        #: First group of each term, and one more place.
        self.firsts = np.searchsorted(self.postings, firsts)

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups of some terms, and which of those terms each is of."""
        return spread(self.firsts[terms], self.firsts[terms + 1])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from first to last of each, end to end, and which each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n), of


class Tree:
    """The postings of a range with the maxima above them."""

    def __init__(self, ids, sizes, keys, firsts, docs, times, n_docs: int, n_terms: int, leaf_docs: int = LEAF_DOCS, node_leaves: int = NODE_LEAVES):
        self.ids, self.keys, self.docs = ids, keys, docs
        length = 100 - 75 + 75 * sizes * n_docs // n_terms
        self.impacts = 1_000_000_000 * times // (1000 * times + 8 * length[docs])
        self.fan = node_leaves.bit_length() - 1
        self.leaves = Maxima(firsts, docs, self.impacts, leaf_docs.bit_length() - 1)
        self.nodes = Maxima(firsts, docs, self.impacts, leaf_docs.bit_length() - 1 + self.fan)
        self.most = np.maximum.reduceat(self.impacts, firsts[:-1])
        self.n_leaves = int(docs.max()) // leaf_docs + 1
        self.n_nodes = self.n_leaves + node_leaves - 1 >> self.fan

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the range's terms, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offers best every document that may be among its; returns how many leaves were opened."""
        group, of = self.nodes.groups(terms)
        bounds = np.zeros(self.n_nodes, np.int64)
        np.add.at(bounds, self.nodes.part[group], self.nodes.most[group] * weights[of])
        queue = [(-b, 0, k) for k, b in enumerate(bounds.tolist()) if b >= best.least]
        heapq.heapify(queue)
        below, opened = None, 0
        while queue and -queue[0][0] >= best.least:
            leaves = []
            while queue and -queue[0][0] >= best.least and len(leaves) < LEAVES_AT_ONCE:
                _, is_leaf, k = heapq.heappop(queue)
                if is_leaf:
                    leaves.append(k)
                    continue
                if below is None:
                    below = self._leaf_bounds(terms, weights)
                for j, b in enumerate(below[0][k << self.fan : k + 1 << self.fan].tolist(), k << self.fan):
                    if b >= best.least:
                        heapq.heappush(queue, (-b, 1, j))
            if leaves:
                opened += len(leaves)
                best.offer(*self._scores(leaves, weights, *below[1:]))
        return opened

    def _leaf_bounds(self, terms, weights):
        group, of = self.leaves.groups(terms)
        bounds = np.zeros(self.n_leaves, np.int64)
        np.add.at(bounds, self.leaves.part[group], self.leaves.most[group] * weights[of])
        return bounds, group, of

    def _scores(self, leaves, weights, group, of):
        """doc_id and score of the documents of some leaves that have a term."""
        asked = np.zeros(self.n_leaves, bool)
        asked[leaves] = True
        hit = asked[self.leaves.part[group]]
        group, of = group[hit], of[hit]
        posting, k = spread(self.leaves.postings[group], self.leaves.postings[group + 1])
        docs, back = np.unique(self.docs[posting], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, back, self.impacts[posting] * weights[of[k]])
        return self.ids[docs], scores


class Best:
    """The documents of the highest scores above 0, equal ones by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        may = scores >= self.least
        ids, scores = np.concatenate([self.ids, ids[may]]), np.concatenate([self.scores, scores[may]])
        by = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[by], scores[by]
        if len(by) == self.k:
            self.least = int(self.scores[-1])  # a bound that equals it may hide a smaller doc_id


def _found(ranges: DataFrame, items: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, item_id, doc_id, score: the best of each task for a block of items."""
    number, name = np.array([r["item"] for r in items], np.int64), [r["item_id"] for r in items]
    sizes = np.array([len(r["keys"]) for r in items])
    keys = np.concatenate([np.array(r["keys"], np.int64) for r in items]).view(U64)
    weights = np.concatenate([np.array(r["weights"], np.int64) for r in items])
    shared = ranges.sparkSession.sparkContext.broadcast((number, name, np.concatenate([[0], np.cumsum(sizes)]), keys, weights))

    def search(batches):
        number, name, bounds, keys, weights = shared.value
        best = [Best(k) for _ in number]
        distinct, back = np.unique(keys, return_inverse=True)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "keys", "firsts", "docs", "times")), strict=True):
                ids, sizes, own, firsts, docs, times = (np.frombuffer(x, t) for x, t in zip(row, ("<i8", "<i8", "<u8", "<i4", "<i4", "<i4"), strict=True))
                if not len(own):
                    continue
                tree = Tree(ids, sizes, own, firsts, docs, times.astype(np.int64), n_docs, n_terms)
                place = tree.find(distinct)[back]
                roots = np.add.reduceat(np.where(place >= 0, tree.most[place], 0) * weights, bounds[:-1])
                for i in np.flatnonzero(roots >= [x.least for x in best]).tolist():
                    at = place[bounds[i] : bounds[i + 1]]
                    met = at >= 0
                    tree.search(at[met], weights[bounds[i] : bounds[i + 1]][met], best[i])
        of = np.repeat(np.arange(len(best)), [len(x.ids) for x in best])
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([x.ids for x in best], [x.scores for x in best]))
        yield pa.RecordBatch.from_arrays([pa.array(number[of]), pa.array([name[i] for i in of.tolist()], pa.int64()), pa.array(ids), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return ranges.mapInArrow(search, "item bigint, item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 10, range_docs: int = RANGE_DOCS, range_postings: int = RANGE_POSTINGS, block_terms: int = BLOCK_TERMS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest scores above 0 (all, if fewer), equal scores by ascending doc_id.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case. Rows without doc_id are no documents; null and empty texts have no terms
    and don't count. Every row of benchmark is an item of its own, one without terms or of terms that no document has gets no rows;
    item_id may be null or repeat. Repeated documents are ranked each. Other columns are left out; empty tables give none.
    The further arguments set how the work is dealt out, not what is found.
    """
    spark = session_setup(docs.sparkSession)
    none = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    items = written(_items(benchmark), "items")
    terms = written(items.select(F.explode("terms").alias("key")).distinct(), "terms")
    ranges = written(_ranges(documents_of(docs), key_filter(terms), range_docs, range_postings), "ranges")
    totals = ranges.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    if not totals.docs:
        return none
    weight = F.floor(1000 * F.log((2.0 * totals.docs + 2) / (2.0 * F.col("df") + 1)))
    weighed = written(_in_documents(ranges).join(terms, "key").select("key", weight.cast("bigint").alias("weight")), "weights")
    own = items.select("item", "item_id", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("item", "item_id", F.col("x.terms").alias("key"), F.col("x.times").alias("times"))
    met = own.join(F.broadcast(weighed) if weighed.count() <= broadcast_terms else weighed, "key")
    pairs = F.collect_list(F.struct("key", (F.col("times") * F.col("weight")).alias("weight")))  # an item's distinct terms
    asked = met.groupBy("item", "item_id").agg(pairs.alias("x")).select("item", "item_id", F.col("x.key").alias("keys"), F.col("x.weight").alias("weights"))
    asked = written(asked.withColumn("deal", F.xxhash64("item")), "asked")
    blocks = -(-(asked.agg(F.sum(F.size("keys"))).first()[0] or 0) // block_terms)
    found = None
    with arrow_rows(spark, RANGES_AT_ONCE):
        for block in range(blocks):
            rows = asked.where(F.pmod("deal", F.lit(blocks)) == block).collect()  # about as many terms as a block has
            if rows:
                part = written(_found(ranges, rows, totals.docs, totals.terms, k), "found")
                found = part if found is None else found.unionByName(part)
    discard(ranges, terms, weighed)
    if found is None:
        return none
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")  # k rows a task
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
