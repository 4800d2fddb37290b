"""Removal of passages that also occur in an earlier document, by level-wise doubling.

A passage is a window of so many consecutive words. The first level has windows of a
quarter of that length, the next of half, the last of all. Of the first level only
those are candidates that hold the smallest hash among all in some full window: equal
full windows pick the same one, so no repeat is missed, and about one word in
twenty begins one. What is found in one document alone at a level is gone; what
repeats is extended to twice the length, to the window of the next level with the
smallest hash among those around it in the full window; and so on until no candidate survives or the
full length is reached. There the text around a survivor is taken as one stretch of all the full
windows that picked it; a stretch that an earlier
document has too is settled. What remains, where repeated text begins, ends or
was edited, is extended to each full window by itself, and then no candidate
survives. Hashes have 64 bits and are nested, so a false repeat needs three
collisions at the same place.

Repeated keys are met by aggregates of fixed size, never by lists of a key's rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, documents_of, mixed, prefix_sums, range_hash, session_setup, text_slices, word_hashes, word_spans, written

#: Base of the hashes of word sequences, other than that of the words.
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
#: Keys of a run: its windows of the first and of the second level.
LEVELS = ("quarter", "half")
RUN = "quarter bigint, half bigint, stretch bigint, doc_id bigint, first int, n int"


def _sequence(data: np.ndarray, bounds: np.ndarray):
    starts, ends, at = word_spans(data, bounds)
    return starts, ends, at, prefix_sums(word_hashes(data, starts, ends), _BASE, _INV)


def _hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(sums, first, end, _BASE, _INV)


def _lengths(window: int) -> tuple[int, int]:
    """Words of a window of the first and of the second level."""
    return max(1, window // 4), max(1, window // 2)


def least_place(value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the first smallest value between first and last, each included."""
    width = int((last - first).max(initial=0)) + 1
    place = [np.arange(len(value))]
    while 2 << len(place) - 1 <= width:
        have, step = place[-1], 1 << len(place) - 1
        a, b = have[: len(have) - step], have[step:]
        place.append(np.where(value[a] <= value[b], a, b))
    level = np.frexp((last - first + 1).astype(float))[1] - 1  # the largest power of 2 that fits
    out = np.empty(len(first), np.int64)
    for k, have in enumerate(place):
        own = np.flatnonzero(level == k)
        a, b = have[first[own]], have[last[own] + 1 - (1 << k)]
        out[own] = np.where(value[a] <= value[b], a, b)
    return out


def picked_runs(sums: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of full windows that pick the same windows at both lower levels.

    Returns each run's document, first window (word of the slice), number of
    windows, hashes of the windows it picks and hash of the whole stretch.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 3
    words, (quarter, half) = int(at[-1]), _lengths(window)
    end = np.repeat(at[1:], np.diff(at))
    begin = np.flatnonzero(np.arange(words) + window <= end)
    if not len(begin):
        return none
    by_quarter, by_half = (_hash(sums, here, here + n) for n in (quarter, half) for here in [np.arange(words - n + 1)])
    low = least_place(by_quarter, begin, begin + window - quarter)
    mid = least_place(by_half, np.maximum(begin, low + quarter - half), np.minimum(begin + window - half, low))
    new = np.flatnonzero((low[1:] != low[:-1]) | (mid[1:] != mid[:-1]) | (begin[1:] != begin[:-1] + 1)) + 1
    new = np.concatenate([[0], new])
    first, low, mid = begin[new], low[new], mid[new]
    n = np.diff(np.concatenate([new, [len(begin)]]))
    shape = mixed((n.astype(U64) << U64(32)) | (low - first).astype(U64))
    stretch = mixed(_hash(sums, first, first + n - 1 + window) ^ shape)
    return np.searchsorted(at, first, "right") - 1, first, n, by_quarter[low], by_half[mid], stretch


def _runs(docs: DataFrame, window: int) -> DataFrame:
    def find(batches):
        for rows, data, bounds in text_slices(batches):
            _, _, at, sums = _sequence(data, bounds)
            doc, first, n, *keys = picked_runs(sums, at, window)
            ids = rows.column("doc_id").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), pa.array(ids), pa.array((first - at[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], [*LEVELS, "stretch", "doc_id", "first", "n"])

    return docs.mapInArrow(find, RUN)


def _windows(docs: DataFrame, open_runs: DataFrame, window: int) -> DataFrame:
    """hash, doc_id, first, asked of every full window in the open runs; runs: first << 32 | n << 1 | asked."""

    def find(batches):
        for rows, data, bounds in text_slices(batches):
            _, _, at, sums = _sequence(data, bounds)
            runs = rows.column("runs")
            doc = np.repeat(np.arange(len(rows)), np.diff(runs.offsets.to_numpy()))
            packed = runs.flatten().to_numpy()
            first, n, asked = packed >> 32, (packed >> 1) & 0x7FFFFFFF, packed & 1
            fits = at[doc] + first + n - 1 + window <= at[doc + 1]  # not so only if a doc_id is repeated
            doc, first, n, asked = doc[fits], first[fits], n[fits], asked[fits]
            k = np.repeat(np.arange(len(n)), n)
            here = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            begin = at[doc[k]] + here
            yield pa.RecordBatch.from_arrays([pa.array(_hash(sums, begin, begin + window).view(np.int64)), pa.array(rows.column("doc_id").to_numpy()[doc[k]]), pa.array(here.astype(np.int32)), pa.array(asked[k].astype(bool))], ["hash", "doc_id", "first", "asked"])

    packed = open_runs.select("doc_id", (F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("n") * 2 + F.col("asked").cast("int")).alias("run"))
    by_doc = packed.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    return docs.join(by_doc, "doc_id").select("doc_id", "text", "runs").mapInArrow(find, "hash bigint, doc_id bigint, first int, asked boolean")


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, first, n: n windows from word first on, each of which also starts in a smaller doc_id."""
    live = written(_runs(docs, window), "runs")
    for key in LEVELS:  # what repeats at one level goes on to the next
        ends = live.groupBy(key).agg(F.min("doc_id").alias("least"), (F.min("stretch") != F.max("stretch")).alias("varied"), F.max("doc_id").alias("most"))
        repeated = written(ends.where("least < most").drop("most"), f"repeated-{key}")
        before, live = live, written(live.drop("least", "varied").join(repeated, key), key)
        discard(before, repeated)
        if live.isEmpty():
            break
    left = live
    settled = left.where("not varied and least < doc_id").select("doc_id", "first", "n")
    varied = left.where("varied")
    stretches = written(varied.groupBy("half", "stretch").agg(F.min("doc_id").alias("owner")), "stretches")
    owned = written(varied.join(stretches, ["half", "stretch"]), "owned")
    settled = settled.union(owned.where("owner < doc_id").select("doc_id", "first", "n"))
    unsettled = owned.where("owner = doc_id").select("doc_id", "first", "n", (F.col("least") < F.col("doc_id")).alias("asked"))
    windows = written(_windows(docs, unsettled, window), "windows")
    owners = written(windows.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").drop("most"), "owners")
    single = windows.where("asked").join(owners, "hash").where("owner < doc_id").select("doc_id", "first", F.lit(1).alias("n"))
    return settled.union(single)


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word that a window of so many words covers whose words also start in a smaller doc_id.

    Words are [^ \\t-\\r]+, unchanged. All windows are judged on the input. Returns
    doc_id, n_words, n_removed, kept_sha256 (the kept words joined by a space) and,
    if asked for, text: the input without the bytes from each removed run's first
    word up to the next kept word; untouched where nothing is removed.

    Null text is an empty one; documents of fewer words than a window keep all.
    Of equal documents the smallest doc_id keeps its words. Rows that repeat a
    doc_id count as one document for what is smaller, and the runs found in any of them
    are removed from each as far as they fit. Other columns are left out
    but for those to carry.
    """
    session_setup(docs.sparkSession)
    whole = documents_of(docs, carry)
    docs = whole.select("doc_id", "text")
    runs = repeated_runs(docs, window).select("doc_id", (F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("n")).alias("run"))
    by_doc = runs.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))

    def cut(batches):
        for rows, data, bounds in text_slices(batches):
            starts, _, at = word_spans(data, bounds)
            runs, raw = rows.column("runs"), data.tobytes()
            lists = runs.offsets.to_numpy().tolist()
            packed = runs.values.to_numpy()
            out: list[tuple] = []
            for i in range(len(rows)):
                text = raw[bounds[i] : bounds[i + 1]]
                words = text.split()
                n, kept, left = len(words), words, text
                if lists[i] < lists[i + 1] and n:
                    mine = packed[lists[i] : lists[i + 1]]
                    first, end = mine >> 32, (mine >> 32) + (mine & 0xFFFFFFFF) - 1 + window
                    fits = end <= n
                    turn = np.bincount(first[fits], minlength=n + 1)[: n + 1] - np.bincount(end[fits], minlength=n + 1)[: n + 1]
                    keep = np.cumsum(turn[:n]) == 0
                    kept = [words[k] for k in np.flatnonzero(keep).tolist()]
                    if with_text:
                        begin = np.append(starts[at[i] : at[i + 1]] - bounds[i], len(text))
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                        lead = text[: begin[0]] if keep[0] else b""
                        left = lead + b"".join([text[begin[a] : begin[b]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), left.decode() if with_text else None))
            n, removed, sha, texts = zip(*out, strict=True)
            columns = [rows.column(x) for x in ("doc_id", *carry)] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", *carry, "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names + ["text"] * with_text)

    joined = whole.join(by_doc, "doc_id", "left").select("doc_id", *carry, "text", F.coalesce("runs", F.array().cast("array<bigint>")).alias("runs"))
    carried = "".join(f"{x} {joined.schema[x].dataType.simpleString()}, " for x in carry)
    return joined.mapInArrow(cut, f"doc_id bigint, {carried}n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text)
