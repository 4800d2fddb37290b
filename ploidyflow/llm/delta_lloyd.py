"""Codes of vectors by product quantization, whose codebooks Lloyd's rounds maintain by differences.

Vectors become integers and are written once, many to a row (a block), in a table bucketed by block. A
round's assignments are a table of the same buckets, so vectors meet their previous assignments without an exchange.
A round assigns every part to its codebook's nearest entry, and of the parts whose entry is another
than before, each task returns what they add to their new entry and take from their old one, summed up by entry.
Those sums alone are shuffled; added to the running integer sums, of which there are as many as the codebooks have components, they
give the next codebooks. A round that changes nothing is the last that needs to be run.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, session_setup, shared_path, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Steps of a component's unit.
STEPS = 4096
#: Bytes of vectors to a bucket, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
#: Blocks read into a worker at once.
BLOCKS_AT_ONCE = 16
#: A label of more than this share of all rows is met by broadcast (there are at most as many of them), any other by shuffle.
HOT_SHARE = 1024


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def largest_component(dim: int) -> int:
    """The largest whole component, for which squared distances of whole vectors stay within 64 bits."""
    return int((2.0**60 / max(dim, 1)) ** 0.5)


def _blocks(kept: DataFrame, dim: int, label: str) -> DataFrame:
    """block, ids, labels, x (whole components, 4 bytes each): an Arrow batch of vectors a row."""
    most = largest_component(dim)

    def make(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column("v")
            sizes = np.diff(vectors.offsets.to_numpy())
            if (sizes != dim).any():
                raise ValueError(f"vectors must all have {dim} components, one has {sizes[sizes != dim][0]}")
            x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
            if (np.abs(x) > most).any():
                raise ValueError(f"components must be within {most / STEPS:g}")
            offsets = pa.array([0, b.num_rows], pa.int32())
            whole = lambda name: pa.ListArray.from_arrays(offsets, b.column(name))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), whole("vec_id"), whole("label"), pa.array([x.astype("<i4").tobytes()], pa.binary())], ["block", "ids", "labels", "x"])
            k += 1

    return kept.mapInArrow(make, f"block bigint, ids array<bigint>, labels array<{label}>, x binary")


def _smallest(vectors: DataFrame, dim: int, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids, ascending, ids that are null last; of rows with one id the smallest vector. A task returns as many as there are entries at most."""

    def pick(batches):
        have: dict[int | None, tuple[int, ...]] = {}
        for b in batches:
            for ids, raw in zip(b.column("ids").to_pylist(), b.column("x").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<i4").reshape(len(ids), dim)
                last = max(have, key=_null_last) if len(have) == entries else None
                for k, i in enumerate(ids):
                    if len(have) == entries and i not in have and not _null_last(i) < _null_last(last):
                        continue
                    v = tuple(x[k].tolist())
                    have[i] = min(v, have.get(i, v))
                    if len(have) > entries:
                        del have[last]
                        last = max(have, key=_null_last)
                    elif len(have) == entries:
                        last = max(have, key=_null_last)
        yield pa.RecordBatch.from_arrays([pa.array([*have], pa.int64()), pa.array([*have.values()], pa.list_(pa.int32()))], ["id", "v"])

    rows = vectors.select("ids", "x").mapInArrow(pick, "id bigint, v array<int>").groupBy("id").agg(F.min("v").alias("v"))
    return [r.v for r in rows.orderBy(F.asc_nulls_last("id")).limit(entries).collect()]


def _null_last(i: int | None) -> tuple[bool, int]:
    return i is None, i or 0


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, ties to the lower, and its squared distance. x: vectors by parts by components; books: parts by entries by components."""
    far = np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(books.shape[0])], axis=1)
    code = far.argmin(axis=2)
    return code.astype(np.uint8), np.take_along_axis(far, code[:, :, None], axis=2)[:, :, 0]


def contributions(x: np.ndarray, new: np.ndarray, old: np.ndarray | None, entries: int) -> np.ndarray:
    """parts by entries by (components and a count): what parts of another entry than before add and take."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    row, part = np.nonzero(new != old) if old is not None else np.nonzero(np.ones(new.shape, bool))
    moved = np.concatenate([x[row, part], np.ones((len(row), 1), np.int64)], axis=1)
    np.add.at(out, (part, new[row, part]), moved)
    if old is not None:
        np.subtract.at(out, (part, old[row, part]), moved)
    return out


class _Bucketed:
    """Tables bucketed by block in the shared folder, under names of their own."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names, self.own = spark, buckets, [], uuid.uuid4().hex

    def write(self, df: DataFrame, name: str) -> DataFrame:
        name = f"{name}_{self.own}"
        df.write.bucketBy(self.buckets, "block").option("path", shared_path(self.spark, name)).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}_{self.own}")
        self.names.remove(f"{name}_{self.own}")


def _round(vectors: DataFrame, before: DataFrame | None, books: np.ndarray) -> DataFrame:
    """block and codes of a round; and rows of a part, entry, place and value: a task's contributions, under a block of its own so they stay in its bucket."""
    parts, entries, width = books.shape
    first = before is None
    met = vectors.select("block", "x") if first else vectors.select("block", "x").join(before, "block")

    def assign(batches):
        total, at = np.zeros((parts, entries, width + 1), np.int64), None
        for b in batches:
            olds = [None] * b.num_rows if first else b.column("codes").to_pylist()
            out = []
            for raw, old in zip(b.column("x").to_pylist(), olds, strict=True):
                x = np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, parts, width)
                new, _ = nearest(x, books)
                total += contributions(x, new, None if old is None else np.frombuffer(old, np.uint8).reshape(-1, parts), entries)
                out.append(new.tobytes())
            if b.num_rows:
                at = b.column("block")[0].as_py()
                none = pa.nulls(b.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary()), none, none, none, pa.nulls(b.num_rows, pa.int64())], ["block", "codes", "part", "entry", "place", "value"])
        part, entry, place = (k.astype(np.int32) for k in np.nonzero(total))
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(entry), pa.array(place), pa.array(total[part, entry, place])], ["block", "codes", "part", "entry", "place", "value"])

    return met.mapInArrow(assign, "block bigint, codes binary, part int, entry int, place int, value bigint")


def _coded(vectors: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts, _, width = books.shape

    def encode(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = (b.column(c).slice(k, 1).flatten() for c in ("ids", "labels"))
                x = np.frombuffer(b.column("x")[k].as_py(), "<i4").astype(np.int64).reshape(-1, parts, width)
                code, far = nearest(x, books)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code]), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return vectors.select("ids", "labels", "x").mapInArrow(encode, f"vec_id bigint, label {label}, code string, error bigint")


def with_label_error(coded: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """Adds label_error, the error summed over equal labels, nulls together. coded is a written table."""
    label = coded.schema["label"].dataType.simpleString()
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-sums")
    least = coded.count() / share
    hot, rest = sums.where(F.col("n") > least).select(F.col("label").alias("own"), "label_error"), sums.where(F.col("n") <= least).select(F.col("label").alias("own"), "label_error")
    same = F.col("label").cast(label).eqNullSafe(F.col("own"))
    out = coded.join(F.broadcast(hot), same).drop("own")  # at most so many labels as share names
    if rest.isEmpty():
        return out
    others = coded.join(F.broadcast(hot), same, "left_anti").join(rest, same).drop("own")
    return out.unionByName(others)


def vector_codes(table: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is neither null nor holds a null or non-finite component.

    A component x counts as floor(4096 * x). Codebooks begin as the parts of the smallest vec_ids (fewer rows: fewer entries; of rows that share a vec_id the
    smallest vector; a null vec_id comes last), and are replaced by floor(sum / count) of their parts in each round; an entry without parts stays.
    Of entries equally near the lower is taken. code has two hexadecimal digits a part. Repeated rows count, and are
    returned, as often; other columns are left out; an empty table gives none. Vectors of different lengths, or of one that the parts
    don't divide, are an error, as are components so large that distances don't fit 64 bits.
    """
    spark = session_setup(table.sparkSession)
    label = table.schema["label"].dataType.simpleString()
    kept = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col(vector).alias("v")).where(_finite(F.col("v")))
    first = kept.select(F.size("v").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = first.n
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    blocks = written(_blocks(kept, dim, label), "blocks")
    size = blocks.agg(F.sum(F.length("x"))).first()[0]
    tables = _Bucketed(spark, max(spark.sparkContext.defaultParallelism, min(MOST_BUCKETS, -(-size // BUCKET_BYTES))))
    vectors = tables.write(blocks.repartition(tables.buckets, "block"), "vectors")
    discard(blocks)
    with arrow_rows(spark, BLOCKS_AT_ONCE):
        seeds = _smallest(vectors, dim, entries)
        books = np.array(seeds, np.int64).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()
        sums = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        before = None
        for k in range(rounds):
            made = tables.write(_round(vectors, before, books), f"codes{k}")
            moved = made.where("part is not null").groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()  # as many rows as the codebooks have components, and counts
            if k:
                tables.drop(f"codes{k - 1}")
            for r in moved:
                sums[r.part, r.entry, r.place] += r.value
            if not moved:
                tables.drop(f"codes{k}")
                break
            used = sums[:, :, -1] > 0
            books[used] = sums[used][:, :-1] // sums[used][:, -1:]
            before = made.where("codes is not null").select("block", "codes")
            if k == rounds - 1:
                tables.drop(f"codes{k}")
        coded = written(_coded(vectors, books, label), "codes")
    tables.drop("vectors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
