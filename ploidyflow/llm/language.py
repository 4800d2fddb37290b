"""Language of a text, from bit-sliced Bloom filters of byte n-grams.

Every slot of the filter is one number whose bits are the languages, so a few
look-ups of an n-gram return all languages that have it at once. Of more languages
than a number has bits, each so many have slots of their own. A language has
the n-grams that are about as frequent in it as in any other. For each text the
bits are counted by language, and each count is corrected for the false positives
that the filter gives at the language's load; the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, session_setup, text_slices

#: Training texts a language, read whole; the sample is drawn by a hash of doc_id.
SAMPLE_TEXTS = 1500
#: Bytes of an n-gram, slots (as a power of 2) and look-ups of an n-gram.
GRAM = 4
SLOT_BITS = 18
LOOKUPS = 3
#: An n-gram belongs to a language if it was seen so often in it and its rate is at least so large a part of the largest rate.
LEAST_SEEN = 3
LEAST_RATE = 0.25
#: Languages in one array of slots: bits of a number.
MOST_LANGUAGES = 63
UNKNOWN = "und"
#: Text of the languages learned has at least so many of their n-grams, if it isn't of another kind altogether.
LEAST_SHARE = 0.2

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: Letters in lower case; other ASCII as a space.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_LETTERS[65:91] += 32
_BLANK = int.from_bytes(b"    ", "little")


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a slice with a space around every text, as numbers, and each text's first.

    Three spaces between texts keep n-grams from holding letters of two.
    """
    gap = GRAM - 1
    sizes = np.diff(bounds)
    at = bounds + gap * np.arange(1, len(bounds) + 1)
    padded = np.full(len(data) + gap * (len(sizes) + 1), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(gap * np.arange(1, len(sizes) + 1), sizes)] = _LETTERS[data]
    values = padded[: len(padded) - gap].astype(np.uint32)
    for k in range(1, GRAM):
        values |= padded[k : len(padded) - gap + k].astype(np.uint32) << np.uint32(8 * k)
    return values, at[:-1] - gap


def _slots(values: np.ndarray) -> list[np.ndarray]:
    wide = values.astype(np.uint64)
    return [(wide * f >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for f in _FACTORS[:LOOKUPS]]


@dataclass
class LanguageFilter:
    """languages in order of bit, the slots of the first MOST_LANGUAGES, each language's rate of false positives, and the slots of each further MOST_LANGUAGES."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray
    usual: int
    more: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageFilter:
        """counts: distinct n-grams of each language and how often each was seen."""
        slots = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(0, len(languages), MOST_LANGUAGES)]
        grams_all = np.unique(np.concatenate([counts[x][0] for x in languages]))
        rates = [counts[x][1] / max(1, counts[x][1].sum()) for x in languages]
        largest = np.zeros(len(grams_all))
        for x, rate in zip(languages, rates, strict=True):
            at = np.searchsorted(grams_all, counts[x][0])
            largest[at] = np.maximum(largest[at], rate)
        false = np.zeros(len(languages))
        for i, (x, rate) in enumerate(zip(languages, rates, strict=True)):
            own, n = counts[x]
            has = (n >= LEAST_SEEN) & (rate >= LEAST_RATE * largest[np.searchsorted(grams_all, own)])
            part, bit = slots[i // MOST_LANGUAGES], np.uint64(i % MOST_LANGUAGES)
            for s in _slots(own[has]):
                part[s] |= np.uint64(1) << bit
            false[i] = np.mean((part >> bit) & np.uint64(1)) ** LOOKUPS
        return cls(languages, slots[0], false, int(np.argmax([counts[x][1].sum() for x in languages])), slots[1:])

    def masks(self, values: np.ndarray, part: int = 0) -> np.ndarray:
        """Each n-gram's languages, as bits; part: of which MOST_LANGUAGES languages."""
        slots = self.more[part - 1] if part else self.slots
        first, *rest = _slots(values)
        mask = slots[first]
        for s in rest:
            mask &= slots[s]
        return mask

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For every text and language the share of the text's n-grams that the language has, without false positives."""
        values, first = grams(data, bounds)
        shown = values != _BLANK
        n = np.maximum(np.add.reduceat(shown, first, dtype=np.int64), 1)
        out = np.zeros((len(first), len(self.languages)))
        for i in range(len(self.languages)):
            if i % MOST_LANGUAGES == 0:
                mask = self.masks(values, i // MOST_LANGUAGES)
                mask[~shown] = 0
            hits = np.add.reduceat((mask >> np.uint64(i % MOST_LANGUAGES)) & np.uint64(1), first, dtype=np.uint64).astype(float)
            out[:, i] = np.clip((hits - n * self.false[i]) / (n * (1 - self.false[i])), 0, 1)
        return out


    def answers(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and share of every text of a slice."""
        got = self.scores(data, bounds)
        best = got.argmax(axis=1)
        share, total = got[np.arange(len(best)), best], got.sum(axis=1)
        score = np.divide(share, total, out=np.zeros(len(best)), where=total > 0)
        lang = np.array(self.languages, object)[np.where(total > 0, best, self.usual)]
        ascii_letters = np.concatenate([[0], np.cumsum((_LETTERS[data] != 32) & (data < 128))])[bounds]
        for i in np.flatnonzero(np.diff(ascii_letters) == 0).tolist():
            if not has_letter(data[bounds[i] : bounds[i + 1]].tobytes()):
                lang[i], score[i], share[i] = UNKNOWN, 0.0, 0.0
        return lang, score, share


def train(labelled: DataFrame) -> LanguageFilter | None:
    """A filter from doc_id, text and lang of rows; none of them used but those with a text and lang.

    Every lang value is learned, however many there are; at most about SAMPLE_TEXTS texts a language
    are counted. None if there are none.
    """
    rows = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    totals = rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    share = (F.least(F.lit(1.0), F.lit(SAMPLE_TEXTS) / F.col("n")) * F.lit(1 << 30)).cast("bigint")
    sample = rows.join(F.broadcast(totals), F.col("lang") == F.col("of")).where(part < share).select("doc_id", "text", "lang")

    def count(batches):
        for rows_, data, bounds in text_slices(batches):
            langs = np.array(rows_.column("lang").to_pylist(), object)
            values, first = grams(data, bounds)
            sizes = np.diff(np.append(first, len(values)))
            for lang in sorted(set(langs)):
                own = values[np.repeat(langs == lang, sizes)]
                gram, n = np.unique(own[own != _BLANK], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN).toArrow()
    langs = counted["lang"].to_pylist()
    gram, n = counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy()
    by = np.array(langs, object)
    counts = {x: (gram[by == x][o], n[by == x][o]) for x in sorted(set(langs)) for o in [np.argsort(gram[by == x])]}
    return LanguageFilter.of(sorted(counts), counts) if counts else None


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: LanguageFilter | None) -> DataFrame:
    """doc_id, lang_pred, score, share of every document, from the whole text alone. Rows without doc_id are left out.

    lang_pred is "und" with score 0 if the text is null or has no letter, or if
    nothing was learned. score is the winner's part of all languages' corrected
    counts; share is the part of the text's n-grams that the winner has. A text of
    letters unlike any language gets the commonest one with score 0. Ties go to
    the language that sorts first. Repeated rows are answered each.
    """
    session_setup(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** SLOT_BITS numbers

    def answer(batches):
        own = shared.value
        for rows, data, bounds in text_slices(batches):
            n = len(rows)
            lang, score, share = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            if own is not None:
                lang, score, share = own.answers(data, bounds)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(share)], ["doc_id", "lang_pred", "score", "share"])

    return documents_of(docs).mapInArrow(answer, "doc_id bigint, lang_pred string, score double, share double")


def keep_known(docs: DataFrame, model: LanguageFilter | None, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents, with all their columns, whose language is known.

    Rejected are texts that are null or have no letter, and those of whose n-grams
    the best language has less than least_share. Without a model nothing is known
    and all that has a letter stays.
    """
    session_setup(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        own = shared.value
        for rows, data, bounds in text_slices(batches):
            if own is None:
                known = np.array([has_letter(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], bool)
            else:
                lang, _, share = own.answers(data, bounds)
                known = (lang != UNKNOWN) & (share >= least_share)
            yield rows.filter(pa.array(known))

    return docs.mapInArrow(keep, docs.schema)
