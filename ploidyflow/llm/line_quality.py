"""Quality of documents from a linear-chain conditional random field over their lines.

Each line is labelled good or bad. Its features are shares of kinds of bytes and
words, and those of the line before and after; a transition weight ties the labels
of neighbours. Forward-backward gives each line's probability of good, and their
mean weighted by length is the document's raw score, which a logistic curve
fitted on the training documents turns into a probability. Labels are known for
documents only, so in training every line has its document's label.

Lines are worked on side by side: features by sums over the buffer, and the
chains of all documents of a slice one step at a time together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, session_setup, text_slices, word_hashes, word_spans, written

#: Labelled documents that a model is fitted on, at most about; chosen by a hash of doc_id.
SAMPLE_DOCS = 3000
#: Bytes of the sample at most, about; of more, fewer rows are drawn, each whole.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3

_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!", b" \t\x0b\x0c\r\n"), start=1):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 7
#: Kind 0 is any other ASCII: signs and controls.
N_KINDS = 8
N_OWN = N_KINDS + 6


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all lines of a slice (line breaks stay at their ends) and each document's first line.

    Every document has a line at least, if an empty one.
    """
    breaks = np.flatnonzero(data == 10) + 1
    inner = breaks[~np.isin(breaks, bounds)]
    starts = np.sort(np.concatenate([bounds[:-1], inner]))
    first = np.searchsorted(starts, bounds[:-1], "left") + _repeats(bounds[:-1])
    return np.append(starts, bounds[-1]), np.append(first, len(starts))


def _repeats(x: np.ndarray) -> np.ndarray:
    """How many equal entries stand directly before each entry of a sorted array."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]


def line_features(data: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A row for each line: shares of kinds of bytes, word length, repeats of words, and length."""
    n, size = len(lines) - 1, np.maximum(np.diff(lines), 1).astype(float)
    out = np.zeros((n, N_OWN), np.float32)
    kinds = _KINDS[data]
    for k in range(N_KINDS):
        out[:, k] = np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[lines]) / size
    starts, ends, at = word_spans(data, lines)
    words = np.diff(at)
    some = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    line = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    length = ends - starts
    total = lambda v: np.bincount(line, weights=v, minlength=n)
    out[:, N_KINDS] = np.minimum(total(length) / some / 10, 3)
    out[:, N_KINDS + 1] = total(same) / some
    out[:, N_KINDS + 2] = total(again[np.argsort(order)] if len(order) else again) / some
    out[:, N_KINDS + 3] = np.log1p(size) / 8
    out[:, N_KINDS + 4] = total(length == 1) / some
    out[:, N_KINDS + 5] = words == 0
    return out


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and the one after (zero at a document's edge), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    head, tail = first[:-1], first[1:] - 1
    before[head] = 0
    after[tail] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1), np.float32)])


def marginals(lead: np.ndarray, first: np.ndarray, tie: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good of every line, and of equal labels of it and the next, by forward-backward.

    lead: each line's log odds of good by itself. tie: what equal neighbours gain.
    The state is kept as log odds, which two labels allow, so no chain underflows.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(most), "left")  # documents that have a line at each step
    push = lambda x: np.logaddexp(x + tie, 0) - np.logaddexp(x, tie)  # noqa: E731  log odds after a transition
    forward = lead.astype(float).copy()
    for t in range(1, most):
        here = begin[: live[t]] + t
        forward[here] += push(forward[here - 1])
    backward = np.zeros(len(lead))
    for t in range(most - 2, -1, -1):
        here = begin[: live[t + 1]] + t
        backward[here] = push(backward[here + 1] + lead[here + 1])
    good = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    last = np.zeros(len(lead), bool)
    last[first[1:] - 1] = True
    a = forward
    b = np.append((backward + lead)[1:], 0.0)
    equal = np.logaddexp(a + b + tie, tie)
    equal = np.exp(equal - np.logaddexp(equal, np.logaddexp(a, b)))
    equal[last] = 0
    return good, equal


@dataclass
class LineModel:
    """Weights of the features, the tie of neighbours, and the curve from raw score to probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: float
    slope: float
    offset: float

    def lead(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def raw(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good of each document's lines."""
        lines, first = line_bounds(data, bounds)
        good, _ = marginals(self.lead(with_neighbours(line_features(data, lines), first)), first, self.tie)
        weight = np.diff(lines) + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(data, bounds) + self.offset, -500, 500)))


def fit(texts: list[bytes], quality: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> LineModel:
    """Maximum likelihood by gradient ascent with momentum, then the logistic curve.

    Classes count alike in the curve's fit only as often as they occur; without
    both classes the score is the share of label 1.
    """
    share = float(np.clip(quality.mean() if len(quality) else 0.5, 1e-3, 1 - 1e-3))
    if not len(texts) or quality.min() == quality.max():
        width = 3 * N_OWN + 1
        return LineModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, float(np.log(share / (1 - share))))
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    lines, first = line_bounds(data, bounds)
    features = with_neighbours(line_features(data, lines), first)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (features - mean) / scale
    sizes = np.diff(first)
    label = np.repeat(quality, sizes).astype(float)
    weight = np.repeat(1.0 / sizes, sizes)  # a long document doesn't count for more
    pairs = np.ones(len(label))
    pairs[first[1:] - 1] = 0
    theta, tie = np.zeros(x.shape[1]), 0.0
    speed, tie_speed = np.zeros_like(theta), 0.0
    for _ in range(rounds):
        good, equal = marginals(x @ theta, first, tie)
        slope = x.T @ ((label - good) * weight) / len(texts) - decay * theta
        tie_slope = float(((pairs - equal) * weight).sum() / len(texts)) - 0.05 * tie
        speed, tie_speed = 0.9 * speed + slope, 0.9 * tie_speed + tie_slope
        theta, tie = theta + 0.3 * speed, max(0.0, tie + 0.3 * tie_speed)
    model = LineModel(mean, scale, theta, tie, 1.0, 0.0)
    raw = model.raw(data, bounds)
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton's method on two numbers, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -500, 500)))
        v = p * (1 - p) + 1e-9
        g = np.array([((quality - p) * raw).sum() - 1e-2 * a, (quality - p).sum()])
        h = np.array([[(v * raw * raw).sum() + 1e-2, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
    model.slope, model.offset = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame) -> LineModel:
    """A model of labels.quality from at most about SAMPLE_DOCS documents that have a label of 0 or 1.

    Texts are learned from whole; if the sample is of more than SAMPLE_BYTES bytes, fewer documents are drawn.
    A document labelled more than once counts once for each label; null texts are empty ones.
    """
    session_setup(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    total = marks.count()
    part = int(min(1.0, SAMPLE_DOCS / max(total, 1)) * (1 << 30))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < part)
    sample = written(documents_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality"), "quality-sample")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(part * SAMPLE_BYTES / size))
    rows = sample.select("text", "quality").orderBy(F.xxhash64("text"), "quality").toArrow()  # the sample alone
    texts = [x.encode() for x in rows["text"].to_pylist()]
    return fit(texts, rows["quality"].to_numpy().astype(int))


def score(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, score, predicted of every document, from the whole text alone.

    score is the probability of label 1; predicted is 1 from THRESHOLD on. Null
    and empty texts have one empty line and a score like others. Repeated rows are
    answered each. Rows without doc_id are left out.
    """
    session_setup(docs.sparkSession)

    def run(batches):
        for rows, data, bounds in text_slices(batches):
            got = model.scores(data, bounds)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents_of(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")
