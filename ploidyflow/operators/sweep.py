"""Columns, candidates, features and windows of a bin of the genome in one pass.

Reads are dealt into coordinate bins, a read into each bin that it reaches, and folded there, an
Arrow batch at a time, to counts by position, strand and token (read_tokens). A bin that holds a large share of
all reads is split between tasks, as counts of its parts add up. Observations that are a table
already are counted by Spark (strand_tokens of encode.py). So no exchange has a row for each base of each read.

Those counts, the reference, and regions if any, meet in one exchange by bin (swept). Bin by bin
all columns are made with arrays by position: depth, the commonest alleles, the test of candidates,
and the 30 features, which are made only for columns that a window around a candidate holds,
and for those at the bin's edges. Windows that lie within the bin are put together at once; those across an edge by windows_of().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.cigars import ref_span
from ..functions.tokens import strand
from .encode import FEATURES
from .scan import before_in_parts

#: Positions of a bin.
BIN = 1 << 14
#: Covered columns of a bin in which windows across edges are put together.
EDGE_BIN = 1 << 12
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_ACGT = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 4)
_CODE[_ACGT] = range(4)
#: Codes of tokens of several letters begin here.
_LONG = 256

TOKENS = "chrom string, pos bigint, strand int, token string, n bigint, mq bigint"


# -------------------------------------------------------------- reads to tokens


def operations(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """read, letter (its byte) and length of every operation of every CIGAR text."""
    _, offsets, data = cigars.buffers()
    bounds = np.frombuffer(offsets, np.int32)[cigars.offset : cigars.offset + len(cigars) + 1]
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    digit = (text >= 48) & (text <= 57)
    at = np.flatnonzero(~digit)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    place = np.flatnonzero(digit)
    op = np.searchsorted(at, place)
    length = np.zeros(len(at), np.int64)
    np.add.at(length, op, (text[place] - 48).astype(np.int64) * 10 ** (at[op] - place - 1))
    return np.searchsorted(bounds - bounds[0], at, "right") - 1, text[at], length


def _is(ops: np.ndarray, letters: bytes) -> np.ndarray:
    return np.isin(ops, np.frombuffer(letters, np.uint8))


def folded(chrom: pa.Array, bins: np.ndarray, pos: np.ndarray, reverse: np.ndarray, mapq: np.ndarray, cigars: pa.Array, seqs: pa.Array, size: int) -> pa.RecordBatch:
    """TOKENS of reads within their bins: what each shows at each position from 2 on, counted. The rules are those of observations()."""
    read, op, n = operations(cigars)
    on_ref, on_read = _is(op, b"MDN=X"), _is(op, b"MIS=X")
    head = np.searchsorted(read, read)  # first operation of the read
    along = lambda takes: (s := np.cumsum(n * takes)) - n * takes - (s - n * takes)[head]
    r_at, q_at = along(on_ref), along(on_read)
    _, offsets, data = seqs.buffers()
    bounds = np.frombuffer(offsets, np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    text = np.concatenate([np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), [0]]).astype(np.uint8)
    shown = np.flatnonzero(on_ref & (n > 0))
    of = np.repeat(shown, n[shown])
    i = np.arange(len(of)) - np.repeat(np.cumsum(n[shown]) - n[shown], n[shown])
    own = read[of]
    place = pos[own] + r_at[of] + i
    inside = (place // size == bins[own]) & (place >= 2)
    of, i, own, place = of[inside], i[inside], own[inside], place[inside]
    at = bounds[own] + q_at[of] + i
    code = _UPPER[text[np.where(at < bounds[own + 1], at, len(text) - 1)]].astype(np.int64)
    code[op[of] == ord("D")] = ord("*")
    skip = op[of] == ord("N")
    code[skip] = np.where(reverse[own[skip]], ord("<"), ord(">"))
    names: list[str] = []
    following = np.append(op[1:], 0) * (np.append(read[1:], -1) == read)
    carries = np.flatnonzero((i == n[of] - 1) & ~skip & _is(following[of], b"ID"))
    if len(carries):
        known: dict[str, int] = {}
        letters = data.to_pybytes() if data is not None else b""
        for k in carries.tolist():
            nxt = int(of[k]) + 1
            if op[nxt] == ord("I"):
                a = int(bounds[own[k]] + q_at[nxt])
                suffix = f"+{n[nxt]}{letters[a : min(a + int(n[nxt]), int(bounds[own[k] + 1]))].decode()}"
            else:
                suffix = f"-{n[nxt]}{'N' * int(n[nxt])}"
            token = ((chr(code[k]) if code[k] else "") + suffix).upper()
            code[k] = known.setdefault(token, _LONG + len(known))
        names = [*known]
    codes = _LONG + len(names)
    lines = np.concatenate([[0], np.cumsum((bins[1:] != bins[:-1]) | np.array(pc.not_equal(chrom[1:], chrom[:-1])).astype(bool))]) if len(bins) else np.zeros(0, np.int64)
    run = lines[own]
    key = ((run * size + place % size) * 2 + reverse[own]) * codes + code
    keys, first, back = np.unique(key, return_index=True, return_inverse=True)
    counts = np.bincount(back, minlength=len(keys))
    quality = np.zeros(len(keys), np.int64)
    np.add.at(quality, back, mapq[own])
    words = pa.array(["" if c == 0 else chr(c) for c in range(_LONG)] + names)
    arrays = [chrom.take(pa.array(own[first])), pa.array(place[first]), pa.array(reverse[own[first]].astype(np.int32)), words.take(pa.array(keys % codes)), pa.array(counts.astype(np.int64)), pa.array(quality)]
    return pa.RecordBatch.from_arrays(arrays, ["chrom", "pos", "strand", "token", "n", "mq"])


def read_tokens(reads: DataFrame, size: int = BIN) -> DataFrame:
    """TOKENS of reads; a position's tokens may come in parts, which add up.

    The exchange has a row a read and bin; of a bin that many reads reach Spark makes several tasks.
    """
    aligned = reads.where("cigar is not null and cigar <> '*' and chrom is not null and pos is not null")
    last = F.col("pos") + F.greatest(ref_span(F.col("cigar")), F.lit(1)) - 1
    reached = F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor(last / size)))
    dealt = aligned.select("chrom", reached.alias("bin"), "pos", strand(F.col("flag")).alias("strand"), F.col("mapq").cast("bigint").alias("mapq"), "cigar", F.coalesce("seq", F.lit("")).alias("seq"))
    dealt = dealt.hint("rebalance", "chrom", "bin").sortWithinPartitions("chrom", "bin")

    def fold(batches):
        for b in batches:
            if b.num_rows:
                plain = lambda x: b.column(x).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                yield folded(b.column("chrom"), plain("bin"), plain("pos"), plain("strand").astype(bool), plain("mapq"), b.column("cigar"), b.column("seq"), size)

    return dealt.mapInArrow(fold, TOKENS)


# ----------------------------------------------------------------- tokens to sites


class Words:
    """What each of some distinct tokens shows."""

    def __init__(self, words: list[str]):
        self.words = words
        self.first = np.array([ord(w[0]) if w else 0 for w in words], np.int64)
        self.single = np.array([len(w) == 1 for w in words], bool)
        self.bare_star = np.array([w == "*" for w in words], bool)
        self.star = np.array(["*" in w for w in words], bool)
        self.real = ~self.star & np.isin(self.first, _ACGT)
        self.alleles, self.rank = {}, {}
        for mark in "+-":
            after = [w.split(mark)[1] if mark in w else None for w in words]
            names = sorted({x for x in after if x is not None})
            number = {x: k for k, x in enumerate(names)}
            self.alleles[mark], self.rank[mark] = names, np.array([-1 if x is None else number[x] for x in after], np.int64)


def digits(allele: str) -> str:
    end = 0
    while end < len(allele) and allele[end].isdigit():
        end += 1
    return allele[:end]


def tops(group: np.ndarray, rank: np.ndarray, n: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the commonest allele's rank (-1: none), of equal counts the smallest, and its count."""
    best, count = np.full(groups, -1, np.int64), np.zeros(groups, np.int64)
    if len(group):
        width = int(rank.max()) + 1
        keys, back = np.unique(group * width + rank, return_inverse=True)
        total = np.bincount(back, n).astype(np.int64)
        own = keys // width
        order = np.lexsort((keys, -total, own))
        lead = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]
        best[own[lead]], count[own[lead]] = keys[lead] % width, total[lead]
    return best, count


class BinColumns:
    """The covered columns of a bin that the reference has, in order.

    pos, strand, code (of words), n, mq: counted tokens. base: the reference's bytes from the bin's begin on, 0 where it has none.
    """

    def __init__(self, low: int, base: np.ndarray, pos: np.ndarray, side: np.ndarray, code: np.ndarray, n: np.ndarray, mq: np.ndarray, words: Words, uppercase: bool):
        seen = _UPPER[base] if uppercase else base
        self.low, self.words, self.present = low, words, base > 0
        self.masked = np.where(np.isin(seen, _ACGT), seen, ord("*")).astype(np.uint8)
        place = pos - low
        have = self.present[place]
        self.at, self.column = np.unique(place[have], return_inverse=True)
        self.side, self.code, self.n, self.mq = side[have], code[have], n[have], mq[have]
        self.ref, self.base = self.masked[self.at].astype(np.int64), base[self.at]
        self.depth = np.bincount(self.column, self.n, len(self.at)).astype(np.int64)

    def _allele(self, mark: str, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        rank = self.words.rank[mark][self.code]
        has = rank >= 0
        return tops(group[has], rank[has], self.n[has], groups)

    def candidates(self, least: int, min_af: float, max_indel: int, acgt_only: bool, within: np.ndarray | None) -> list[tuple]:
        """(column, ref, alt, kind, ref_num, alt_num) of sites whose commonest alternative allele is frequent enough; the rules are those of candidate_sites()."""
        w, size = self.words, len(self.at)
        first = w.first[self.code]
        same = w.single[self.code] & (first == self.ref[self.column])
        ref_num = np.bincount(self.column[same], self.n[same], size).astype(np.int64)
        other = ~w.bare_star[self.code] & (first != self.ref[self.column])
        snp, snp_n = tops(self.column[other], first[other], self.n[other], size)
        (ins, ins_n), (dele, del_n) = self._allele("+", self.column, size), self._allele("-", self.column, size)
        alt_num = np.maximum(snp_n, np.maximum(ins_n, del_n))
        ok = (self.ref != ord("*")) & (self.depth >= least) & (alt_num > 0) & (alt_num / np.maximum(self.depth, 1) >= min_af)
        if within is not None:
            ok &= within[self.at]
        out = []
        for k in np.flatnonzero(ok).tolist():
            ref = chr(self.ref[k])
            if snp_n[k] >= ins_n[k] and snp_n[k] >= del_n[k]:
                kind, alt = "SNP", chr(snp[k]) if snp[k] else ""
                if acgt_only and alt not in ("A", "C", "G", "T"):
                    continue
            elif ins_n[k] >= snp_n[k] and ins_n[k] >= del_n[k]:
                name = w.alleles["+"][ins[k]]
                kind, alt = "INS", name[len(digits(name)) :]
                if len(alt) > max_indel:
                    continue
                alt = ref + alt
            else:
                many = digits(w.alleles["-"][dele[k]])
                if not many or int(many) > max_indel:
                    continue
                kind, alt, end = "DEL", ref, self.at[k] + int(many) + 1
                ref = self.masked[self.at[k] : end][self.present[self.at[k] : end]].tobytes().decode()
            out.append((k, ref, alt, kind, int(ref_num[k]), int(alt_num[k])))
        return out

    def features(self, asked: np.ndarray, depth: int) -> np.ndarray:
        """The 30 numbers of the columns asked for (a mask)."""
        rows = np.flatnonzero(asked[self.column])
        number = np.cumsum(asked) - 1
        w, code, n, mq = self.words, self.code[rows], self.n[rows], self.mq[rows]
        group = number[self.column[rows]] * 2 + (self.side[rows] == 0)  # the reverse strand first
        groups = 2 * int(asked.sum())
        out = np.zeros((groups, 14), np.int64)

        def put(k: int, mask: np.ndarray, value: np.ndarray) -> None:
            np.add.at(out[:, k], group[mask], value[mask])

        first, real, star = w.first[code], w.real[code], w.star[code]
        for k, b in enumerate(_ACGT):
            put(k, first == b, n)
            put(7 + k, real & (first == b), mq)
        put(6, w.bare_star[code], n)
        put(13, star, mq)
        for k, mark in ((0, "+"), (1, "-")):
            rank = w.rank[mark][code]
            best, count = tops(group[rank >= 0], rank[rank >= 0], n[rank >= 0], groups)
            out[:, 4 + k] = count
            for j in np.flatnonzero(real & (rank >= 0) & (best[group] >= 0)).tolist():
                many = digits(w.alleles[mark][best[group[j]]])
                if many and f"{mark}{int(many)}" in w.words[code[j]]:
                    out[group[j], 11 + k] += mq[j]
        return np.concatenate([np.full((groups // 2, 1), depth), _CODE[self.ref[asked]][:, None], out.reshape(-1, 28)], axis=1)


SWEPT = "chrom string, bin bigint, pos bigint, k int, n_cols bigint, base string, rd int, ref string, alt string, kind string, ref_num int, alt_num int, f array<bigint>, x array<float>"


def _rows(chrom: str, number: int, own: BinColumns, sites: list[tuple], window: int | None, every: bool, featured: bool, depth: int) -> Iterator[pa.RecordBatch]:
    size = len(own.at)
    is_site = np.zeros(size, bool)
    is_site[[s[0] for s in sites]] = True
    kept, asked, inner, edge = is_site | every, np.full(size, featured and every), np.zeros(size, bool), np.zeros(size, bool)
    if window is not None:
        order = np.arange(size)
        edge = (order < 2 * window + 1) | (order >= size - 2 * window - 1)
        inner = is_site & (order >= window + 1) & (order < size - window)
        reach = np.zeros(size + 1, np.int64)
        centre = np.flatnonzero(inner)
        np.add.at(reach, centre - window, 1)
        np.add.at(reach, centre + window + 1, -1)
        kept, asked = kept | edge, asked | edge | (np.cumsum(reach[:-1]) > 0)
    numbers = own.features(asked, depth) if asked.any() else np.zeros((0, 30), np.int64)
    where = np.cumsum(asked) - 1
    out = np.flatnonzero(kept)
    named = dict.fromkeys(("ref", "alt", "kind", "ref_num", "alt_num"))
    by_column = {s[0]: s[1:] for s in sites}
    values = [by_column.get(k, (None,) * 5) for k in out.tolist()]
    f, x = [], []
    for k in out.tolist():
        f.append(numbers[where[k]] if asked[k] and (every or edge[k]) else None)
        x.append(numbers[where[k] - window : where[k] + window + 1].astype(np.float32).ravel() if inner[k] else None)
    none = lambda t: pa.nulls(1, t)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([chrom] * (len(out) + 1)), pa.array([number] * (len(out) + 1), pa.int64()), pa.array([*(own.at[out] + own.low).tolist(), None], pa.int64()), pa.array([*(out + 1).tolist(), None], pa.int32()),
            pa.array([None] * len(out) + [size], pa.int64()), pa.array([*(chr(b) for b in own.base[out]), None], pa.string()), pa.array([*own.depth[out].tolist(), None], pa.int32()),
            *(pa.array([*(v[j] for v in values), None], pa.string() if j < 3 else pa.int32()) for j in range(len(named))),
            pa.concat_arrays([pa.array(f, pa.list_(pa.int64())), none(pa.list_(pa.int64()))]), pa.concat_arrays([pa.array(x, pa.list_(pa.float32())), none(pa.list_(pa.float32()))]),
        ],
        [c.split(" ")[0] for c in SWEPT.split(", ")],
    )


def swept(
    tokens: DataFrame, reference: DataFrame, depth: int = 0, least: int = 1, min_af: float = 0.1, max_indel: int = 20, uppercase: bool = False, acgt_only: bool = False,
    window: int | None = None, regions: DataFrame | None = None, every: bool = False, featured: bool = True, size: int = BIN,
) -> DataFrame:
    """SWEPT: rows of candidates (kind is not null), of every column if asked for, and a row a bin with n_cols, its covered columns.

    tokens: TOKENS, which add up. reference: as bases_at() takes it; positions that it doesn't have are no columns. regions: candidates outside are none.
    k numbers a bin's columns from 1. With a window, x is that of a candidate whose window lies within its bin, and columns at the bin's edges have rows with f,
    their 30 features, of which windows_of() makes the others. With every and featured all rows have f. A contig or region without tokens gives no rows.
    """
    kinds = "chrom string, bin bigint, kind int, pos bigint, strand int, text string, n bigint, mq bigint"
    null = lambda t: F.lit(None).cast(t)
    own = tokens.where("pos >= 2").select("chrom", F.floor(F.col("pos") / size).alias("bin"), F.lit(2).alias("kind"), "pos", "strand", F.col("token").alias("text"), "n", "mq")
    if "base" in reference.columns:
        pieces = reference.select("chrom", F.col("pos").alias("start"), F.col("base").alias("seq"))
    else:
        pieces = reference.select("chrom", "start", "seq")
    # a bin has bases beyond its end, as far as a deletion reaches
    first, last = F.floor((F.col("start") - max_indel) / size), F.floor((F.col("start") + F.length("seq") - 1) / size)
    begin = lambda b: F.greatest(b * size, F.col("start"))
    cut = lambda b: F.struct(b.alias("bin"), begin(b).alias("pos"), F.substr("seq", (begin(b) - F.col("start") + 1).cast("int"), ((b + 1) * size + max_indel - begin(b)).cast("int")).alias("text"))
    bases = pieces.where("seq <> ''").select("chrom", F.inline(F.transform(F.sequence(first, last), cut))).select("chrom", "bin", F.lit(0).alias("kind"), "pos", null("int").alias("strand"), "text", null("bigint").alias("n"), null("bigint").alias("mq"))
    dealt = bases.unionByName(own)
    if regions is not None:
        spans = regions.select("chrom", F.explode(F.sequence(F.floor(F.col("start1") / size), F.floor((F.col("end1") - 1) / size))).alias("bin"), F.lit(1).alias("kind"), F.col("start1").alias("pos"), null("int").alias("strand"), null("string").alias("text"), F.col("end1").alias("n"), null("bigint").alias("mq"))
        dealt = dealt.unionByName(spans)
    dealt = dealt.select(*(c.split(" ")[0] for c in kinds.split(", "))).repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "kind")
    bounded = regions is not None

    class Bin:
        def __init__(self, chrom: str, number: int):
            self.chrom, self.number, self.low = chrom, number, number * size
            self.base, self.within, self.parts = np.zeros(size + max_indel, np.uint8), np.zeros(size, bool), []

        def add(self, b: pa.RecordBatch) -> None:
            kind = b.column("kind").to_numpy()
            cuts = np.searchsorted(kind, [0, 1, 2, 3])
            for at, text in zip(*(b.column(c).slice(0, cuts[1]).to_pylist() for c in ("pos", "text")), strict=True):
                self.base[at - self.low : at - self.low + len(text)] = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
            for at, end in zip(*(b.column(c).slice(cuts[1], cuts[2] - cuts[1]).to_pylist() for c in ("pos", "n")), strict=True):
                self.within[max(at - self.low, 0) : end - self.low] = True
            if cuts[3] > cuts[2]:
                self.parts.append(b.slice(cuts[2]))

        def rows(self) -> Iterator[pa.RecordBatch]:
            if not self.parts:
                return
            rest = pa.Table.from_batches(self.parts)
            text = rest.column("text").combine_chunks().dictionary_encode()
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            pos, side, n, mq = (rest.column(c).to_numpy() for c in ("pos", "strand", "n", "mq"))
            columns = BinColumns(self.low, self.base, pos, side, text.indices.to_numpy().astype(np.int64), n, mq, Words(text.dictionary.to_pylist()), uppercase)
            if len(columns.at):
                sites = columns.candidates(least, min_af, max_indel, acgt_only, self.within if bounded else None)
                yield from _rows(self.chrom, self.number, columns, sites, window, every, featured, depth)

    def sweep(batches):
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            chrom, number = b.column("chrom"), b.column("bin").to_numpy()
            new = (number[1:] != number[:-1]) | np.array(pc.not_equal(chrom[1:], chrom[:-1])).astype(bool) if b.num_rows > 1 else np.zeros(0, bool)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [b.num_rows]]).tolist()
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                key = chrom[a].as_py(), int(number[a])
                if now is None or (now.chrom, now.number) != key:
                    if now is not None:
                        yield from now.rows()
                    now = Bin(*key)
                now.add(b.slice(a, z - a))
        if now is not None:
            yield from now.rows()

    return dealt.mapInArrow(sweep, SWEPT)


SITE = ("chrom", "pos", "ref", "alt", "kind", "rd", "ref_num", "alt_num")


def sites_of(table: DataFrame) -> DataFrame:
    """The candidates of a swept table."""
    return table.where("kind is not null").select(*SITE)


def featured_columns(table: DataFrame) -> DataFrame:
    """A swept table with a column for each of the 30 features in place of f."""
    own = [F.col("f")[k].alias(name) for k, name in enumerate(FEATURES)]
    return table.where("f is not null").select("*", *own).drop("f")


def numbered(table: DataFrame) -> DataFrame:
    """The columns of a swept table with ord, the number of each among its contig's, and n_cols, how many those are."""
    totals = before_in_parts(table.where("n_cols is not null").select("chrom", "bin", "n_cols"), "chrom", "bin", "n_cols")
    return table.where("pos is not null").drop("n_cols").join(totals, ["chrom", "bin"]).withColumn("ord", F.col("before") + F.col("k")).withColumnRenamed("total", "n_cols").drop("before")


def _dealt(numbered: DataFrame, window: int, bin_columns: int) -> DataFrame:
    """Rows in bins of their ordinals (own), each also in those that a window around it reaches; home is a row's own bin."""
    near, far = F.floor(F.greatest(F.col("ord") - window, F.lit(0)) / bin_columns), F.floor((F.col("ord") + window) / bin_columns)
    return numbered.withColumn("home", F.floor(F.col("ord") / bin_columns)).withColumn("own", F.explode(F.sequence(near, far)))


def _around(window: int) -> WindowSpec:
    return Window.partitionBy("chrom", "own").orderBy("ord").rangeBetween(-window, window)


def framed(numbered: DataFrame, window: int, name: str, aggregate: Column, bin_columns: int = EDGE_BIN) -> DataFrame:
    """Columns with ord, and an aggregate over those up to a window before and after each; at a contig's ends over fewer. No contig is one task."""
    return _dealt(numbered, window, bin_columns).withColumn(name, aggregate.over(_around(window))).where("home = own").drop("home", "own")


def windows_of(table: DataFrame, window: int, edge_bin: int = EDGE_BIN) -> DataFrame:
    """SITE and x, the features of 2 * window + 1 covered columns around, of the candidates of a table that was swept with that window and written.

    Sites without a full window are left out. Only candidates at the edges of bins, and the columns around them, go through a further exchange.
    """
    inner = table.where("x is not null").select(*SITE, "x")
    edges = numbered(table).where("f is not null")
    centre = F.col("kind").isNotNull() & F.col("x").isNull() & (F.col("ord") >= window + 2) & (F.col("ord") <= F.col("n_cols") - window)
    dealt = _dealt(edges.select(*SITE, "ord", "f", centre.alias("centre")), window, edge_bin).withColumn("centre", F.col("centre") & (F.col("home") == F.col("own")))
    met = dealt.withColumn("all", F.when(F.col("centre"), F.flatten(F.collect_list("f").over(_around(window)))))
    return inner.unionByName(met.where("centre").select(*SITE, F.transform("all", lambda v: v.cast("float")).alias("x")))
