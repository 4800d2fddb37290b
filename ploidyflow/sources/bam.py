"""Alignments as BAM, as a Python data source: spark.read.format("bam").load(path).

With an index (.bai or .csi) beside the file, its chunk begins part the reads into ranges of
compressed bytes, each a task; filters on chrom and pos leave the ranges of other contigs and bins out, and with the option
regions only reads that overlap one are read, from the blocks that the index names.
Without an index the file is parted by bytes, and each task looks for the first block
and read of its part. A task finds the records of some megabytes of text first, and decodes their fields, names, operations and bases
as arrays, so there is no Python object a read. Files are opened through Arrow's file
systems, so a URI of any store that Arrow knows works. write_bam() is the sink, which leaves an index.
"""

from __future__ import annotations

import json
import re
import shutil
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.cigars import ref_span
from ..schema import READS
from .blocks import BLOCK_HEAD, Index, depth_for, joined, packed, unpacked, write_parts

#: Compressed bytes to a task, about.
RANGE_BYTES = 64 << 20
# Fixed values of the format: letters of operations and of packed bases.
OPERATIONS = "MIDNSHP=X"
PACKED_BASES = "=ACMGRSVTWYHKDBN"
#: Reads of a batch that goes to Spark, and bytes of text that a task holds.
BATCH, RUN_BYTES = 1 << 14, 4 << 20
#: Reads that must follow each other for a place to count as a read's begin.
SURE = 4
#: Most reads to a part that is written, about.
PART_READS = 1 << 21


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters on chrom reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(name)


class _Blocks:
    """Bytes of a block-compressed file from a virtual offset on."""

    def __init__(self, file, offset: int = 0):
        self.file, self.next = file, offset >> 16
        self.text, self.at, self.begin = b"", 0, self.next
        self._more()
        self.at = offset & 0xFFFF

    def _more(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            return False
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = self.file.read(size - 18)
        self.begin, self.next = self.next, self.next + size
        self.text, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        while self.at >= len(self.text):
            if not self._more():
                return 1 << 62
        return (self.begin << 16) | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.text) and not self._more():
                return out
            take = self.text[self.at : self.at + n - len(out)]
            out += take
            self.at += len(take)
        return out


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs with their lengths, and the virtual offset of the first read."""
    with _open(path) as f:
        blocks = _Blocks(f)
        if blocks.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        (n,) = struct.unpack("<i", blocks.read(4))
        text = blocks.read(n).rstrip(b"\0").decode()
        (n,) = struct.unpack("<i", blocks.read(4))
        contigs = []
        for _ in range(n):
            (size,) = struct.unpack("<i", blocks.read(4))
            name = blocks.read(size)[:-1].decode()
            contigs.append((name, struct.unpack("<i", blocks.read(4))[0]))
        return text, contigs, blocks.tell()


def sort_order(path: str) -> str:
    """SO of the header, or "unspecified"."""
    for line in read_header(path)[0].split("\n"):
        if line.startswith("@HD"):
            return dict(x.split(":", 1) for x in line.split("\t")[1:]).get("SO", "unspecified")
    return "unspecified"


def bin_span(number: int) -> tuple[int, int]:
    """First position and end (0-based) of a bin of a .bai index, whose bins are an eighth of those a level above."""
    level, first = 0, 0
    while number >= first + (1 << 3 * level):
        first += 1 << 3 * level
        level += 1
    size = 1 << 29 - 3 * level
    return (number - first) * size, (number - first + 1) * size


def read_bam_index(path: str, names: list[str]) -> Index | None:
    """The index beside a file of those contigs, or None."""
    for ending in (".bai", ".csi"):
        try:
            with _open(path + ending) as f:
                data = f.read()
        except FileNotFoundError:
            continue
        return Index.from_bytes(unpacked(data) if data[:4] == BLOCK_HEAD else data, names)
    return None


@dataclass
class _Range(InputPartition):
    """Virtual offsets, or offsets in the file that aren't known to begin a read."""

    begin: int
    end: int
    known: bool = True


def _sane(data: bytes, at: int, contigs: int) -> int:
    """End of what may be a read at that place of a block's text, or -1."""
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0 and least <= size < 1 << 24):
        return -1
    end_of_name = at + 36 + l_name - 1
    if end_of_name < len(data) and data[end_of_name] != 0:
        return -1
    return at + 4 + size


def first_read(path: str, offset: int, contigs: int) -> int:
    """Virtual offset of the first read in a block that begins at a file offset or after it; the same for whoever asks."""
    with _open(path) as f:
        total, at = f.size(), offset
        while at < total:
            f.seek(at)
            window = f.read(1 << 17)
            hit = window.find(BLOCK_HEAD)
            if hit < 0:
                at += max(1, len(window) - 3)
                continue
            at += hit
            blocks = _text_from(f, at, total)
            if blocks is None:
                at += 1
                continue
            head, text = blocks
            for k in range(head):
                end, sure = k, 0
                while sure < SURE and end + 36 <= len(text):
                    end = _sane(text, end, contigs)
                    if end < 0:
                        break
                    sure += 1
                if end >= 0 and sure and (sure == SURE or end >= len(text)):
                    return (at << 16) | k
            f.seek(at + 16)
            at += struct.unpack("<H", f.read(2))[0] + 1
    return 1 << 62


def _text_from(f, at: int, total: int, blocks: int = 4) -> tuple[int, bytes] | None:
    """Text of the blocks from an offset on, and the length of the first one's; None if none begins there."""
    text, head = b"", 0
    for k in range(blocks):
        if at >= total:
            break
        f.seek(at)
        data = f.read(18)
        if len(data) < 18 or data[:4] != BLOCK_HEAD or data[12:16] != b"BC\x02\x00":
            return None if k == 0 else (head, text)
        size = struct.unpack_from("<H", data, 16)[0] + 1
        try:
            text += zlib.decompress(f.read(size - 18)[:-8], -15)
        except zlib.error:
            return None if k == 0 else (head, text)
        head = head or len(text)
        at += size
    return head, text


_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("span", "<i4")])
_LETTERS = np.frombuffer(OPERATIONS.encode().ljust(16, b"?"), np.uint8)
_BASES = np.frombuffer(PACKED_BASES.encode(), np.uint8)
_ON_REF = np.isin(_LETTERS, np.frombuffer(b"MDN=X", np.uint8))


def _places(first: np.ndarray, n: np.ndarray, step: int = 1) -> np.ndarray:
    """first, first + step, ... n times of each, end to end."""
    return np.repeat(first - step * (np.cumsum(n) - n), n) + step * np.arange(int(n.sum()))


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _starred(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings, empty ones as `*`."""
    own = _strings(data, sizes)
    return pc.if_else(pa.array(sizes > 0), own, pa.scalar("*")) if (sizes == 0).any() else own


def decoded(text: np.ndarray, at: np.ndarray, names: list[str], wanted=None) -> pa.RecordBatch:
    """Rows of READS from the records that begin at some places of the text. wanted tells from contig, begin and end (0-based, half open) which are kept."""
    fixed = text[at[:, None] + np.arange(36)].reshape(-1).view(_FIXED) if len(at) else np.zeros(0, _FIXED)
    name_at = at + 36
    ops_at = name_at + fixed["l_name"]
    n_ops = fixed["n_ops"].astype(np.int64)
    words = text[(_places(ops_at, n_ops, 4)[:, None] + np.arange(4))].reshape(-1).view("<u4") if n_ops.sum() else np.zeros(0, "<u4")
    if wanted is not None and len(at):
        own = np.concatenate([[0], np.cumsum(np.where(_ON_REF[words & 15], words >> 4, 0).astype(np.int64))])
        upto = np.cumsum(n_ops)
        begin = fixed["pos"].astype(np.int64)
        keep = wanted(fixed["ref"], begin, begin + np.maximum(own[upto] - own[upto - n_ops], 1))
        words, fixed, name_at, ops_at, n_ops = words[np.repeat(keep, n_ops)], fixed[keep], name_at[keep], ops_at[keep], n_ops[keep]
    l_name = fixed["l_name"].astype(np.int64) - 1
    qname = _strings(text[_places(name_at, l_name)], l_name)
    length = (words >> 4).astype(np.int64)
    digits = np.ones(len(words), np.int64)
    for power in 10 ** np.arange(1, 9):
        digits += length >= power
    ends = np.cumsum(digits + 1)
    cigar = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    cigar[ends - 1] = _LETTERS[words & 15]
    for k in range(int(digits.max()) if len(digits) else 0):
        has = digits > k
        cigar[ends[has] - 2 - k] = 48 + length[has] // 10**k % 10
    chars = np.concatenate([[0], ends])
    upto = np.cumsum(n_ops)
    l_seq = fixed["l_seq"].astype(np.int64)
    base = _places(np.zeros(len(l_seq), np.int64), l_seq)
    packed_at = np.repeat(ops_at + 4 * n_ops, l_seq) + (base >> 1)
    seq = _BASES[text[packed_at] >> np.where(base & 1, 0, 4).astype(np.uint8) & 15]
    ref = fixed["ref"]
    chrom = pa.array([*names, "*"]).take(pa.array(np.where(ref >= 0, ref, len(names)).astype(np.int32)))
    columns = [qname, pa.array(fixed["flag"].astype(np.int32)), chrom, pa.array(fixed["pos"].astype(np.int64) + 1), pa.array(fixed["mapq"].astype(np.int32)), _starred(cigar, chars[upto] - chars[upto - n_ops]), _starred(seq, l_seq)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


ARROW = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string())])


def _record_runs(path: str, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text of some megabytes, and where the records in it begin, of all records that begin from one virtual offset up to another."""
    with _open(path) as f:
        total, at = f.size(), begin >> 16
        text, place, limit = bytearray(), begin & 0xFFFF, None  # limit: where the end lies in the text, once its block is read

        def more() -> None:
            nonlocal at, limit
            if limit is None and at >= end >> 16:
                limit = len(text) + (end & 0xFFFF if at == end >> 16 else 0)
            f.seek(at)
            head = f.read(18)
            if len(head) < 18:
                at = total
                return
            size = struct.unpack_from("<H", head, 16)[0] + 1
            text.extend(zlib.decompress(f.read(size - 18)[:-8], -15))
            at += size

        while True:
            while len(text) < RUN_BYTES and limit is None and at < total:
                more()
            found = []
            while (limit is None or place < limit) and place + 4 <= len(text):
                size = int.from_bytes(text[place : place + 4], "little") + 4
                if place + size > len(text):
                    break
                found.append(place)
                place += size
            if found:
                yield np.frombuffer(bytes(text), np.uint8), np.array(found)
            if limit is not None and place >= limit or at >= total:
                return
            del text[:place]
            limit = None if limit is None else limit - place
            place = 0
            more()  # even beyond the end, for a record that begins before it


class BamReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int = RANGE_BYTES, regions: list[tuple[str, int, int]] | None = None):
        self.path, self.range_bytes = path, range_bytes
        _, contigs, self.first = read_header(path)
        self.names = [x for x, _ in contigs]
        self.chroms: set[str] | None = None
        self.low, self.high = 0, 1 << 62
        self.regions: dict[str, list[tuple[int, int]]] | None = None
        if regions is not None:
            self.regions = {}
            for chrom, start1, end1 in sorted(regions):
                own = self.regions.setdefault(chrom, [])
                if own and start1 - 1 <= own[-1][1]:
                    own[-1] = (own[-1][0], max(own[-1][1], end1 - 1))
                else:
                    own.append((start1 - 1, end1 - 1))

    def pushFilters(self, filters):
        for x in filters:
            if x.__class__ in (EqualTo, In) and x.attribute == ("chrom",):
                asked = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.chroms = asked if self.chroms is None else self.chroms & asked
            elif getattr(x, "attribute", None) == ("pos",) and isinstance(getattr(x, "value", None), int):
                if isinstance(x, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, x.value)
                if isinstance(x, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, x.value)
            yield x  # Spark tests every row again

    def _asked(self) -> list[tuple[str, int, int]] | None:
        """Contigs and positions (0-based, half open) asked for; None for all reads."""
        if self.regions is None and self.chroms is None and self.low <= 0 and self.high >= 1 << 62:  # reads without a place are in no bin
            return None
        low, high = max(self.low - 1, 0), min(self.high, 1 << 44)
        chosen = [n for n in self.names if (self.chroms is None or n in self.chroms) and (self.regions is None or n in self.regions)]
        return [(n, max(a, low), min(z, high)) for n in chosen for a, z in (self.regions[n] if self.regions is not None else [(0, 1 << 44)]) if max(a, low) < min(z, high)]

    def partitions(self) -> list[_Range]:
        index = read_bam_index(self.path, self.names)
        if index is None:
            with _open(self.path) as f:
                cuts = [*range(self.first >> 16, f.size(), self.range_bytes)]
            return [_Range(self.first if k == 0 else a, b, k == 0) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], 1 << 62], strict=True))]
        asked = self._asked()
        marks = sorted({self.first, *(a for own in index.bins.values() for chunks in own.values() for a, _ in chunks)})
        spans = [(self.first, 1 << 62)] if asked is None else []
        for chunk in sorted(c for name, a, z in asked or () for c in index.chunks(name, a, z)):
            if spans and chunk[0] <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], chunk[1]))
            else:
                spans.append(chunk)
        out = []
        for begin, end in spans:
            cuts = [begin]
            for x in marks[bisect_right(marks, begin) : bisect_left(marks, end)]:
                if (x >> 16) - (cuts[-1] >> 16) >= self.range_bytes:
                    cuts.append(x)
            out += [_Range(a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]
        return out

    def _wanted(self):
        """Which reads are asked for, from contig, begin and end; None for all."""
        asked = self._asked()
        if asked is None:
            return None
        spans = {self.names.index(n): ([a for m, a, _ in asked if m == n], [z for m, _, z in asked if m == n]) for n in {n for n, _, _ in asked}}
        low, high = self.low - 1, self.high - 1

        def wanted(ref, begin, end):
            keep = np.zeros(len(ref), bool)
            for number, (first, last) in spans.items():
                own = np.flatnonzero(ref == number)
                k = np.searchsorted(first, end[own], "left") - 1
                keep[own] = (k >= 0) & (np.array(last)[k] > begin[own])
            return keep & (begin >= low) & (begin <= high)

        return wanted

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives if there are no ranges
            return
        begin, end = partition.begin, partition.end
        if not partition.known:
            begin = first_read(self.path, begin, len(self.names))
        if end < 1 << 62 and read_bam_index(self.path, self.names) is None:
            end = first_read(self.path, end, len(self.names))
        if begin >= end:
            return
        wanted = self._wanted()
        for text, at in _record_runs(self.path, begin, end):
            for k in range(0, len(at), BATCH):
                out = decoded(text, at[k : k + BATCH], self.names, wanted)
                if out.num_rows:
                    yield out


class BamSource(DataSource):
    """Reads of a BAM file with the columns of schema.READS.

    Options: range_bytes, compressed bytes to a task; regions, a JSON list of [chrom, start1, end1], of which reads that overlap one are read.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        regions = self.options.get("regions")
        return BamReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), None if regions is None else [tuple(x) for x in json.loads(regions)])


# --------------------------------------------------------------------- the sink


def packed_read(qname: str, flag: int, ref: int, pos: int, mapq: int, cigar: str, seq: str) -> bytes:
    """A record, without mate, qualities and tags."""
    ops = [int(n) << 4 | OPERATIONS.index(o) for n, o in re.findall(r"(\d+)(.)", cigar)]
    bases = "" if seq == "*" else seq
    codes = [PACKED_BASES.index(c) if c in PACKED_BASES else 15 for c in bases.upper()] + [0] * (len(bases) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name), mapq, 0, len(ops), flag, len(bases), -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(bases)
    return struct.pack("<i", len(body)) + body


def write_bam(reads: DataFrame, contigs: list[tuple[str, int]], path: str) -> None:
    """Writes reads (schema.READS), in order of contig and position, as one file with its index (.bai, or .csi if a contig is longer than that holds).

    Tasks write parts and copy them to their places; the file is in a mounted file system that all executors share.
    The contigs, which the file's header holds and so the driver, are broadcast; reads are dealt by their order, so that there are no more than PART_READS to a part.
    """
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    none = len(contigs)

    def pack(batches):
        for b in batches:
            c = b.to_pydict()
            records = [packed_read(q, flag, -1 if ref == none else ref, *rest) for q, flag, ref, *rest in zip(c["qname"], c["flag"], c["ref"], c["pos"], c["mapq"], c["cigar"], c["seq"], strict=True)]
            begin = np.array(c["pos"], np.int64) - 1
            chrom = [None if ref == none else n for ref, n in zip(c["ref"], c["chrom"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(chrom, pa.string()), pa.array(begin), pa.array(begin + np.maximum(np.array(c["span"], np.int64), 1))], ["record", "chrom", "begin", "end"])

    spark = reads.sparkSession
    order = spark.createDataFrame([(n, k) for k, (n, _) in enumerate(contigs)], "chrom string, ref int")
    placed = reads.join(F.broadcast(order), "chrom", "left").fillna({"ref": none})  # no contig is one task; what has none comes last
    parts = -(-reads.count() // PART_READS)
    dealt = placed.repartitionByRange(parts, "ref", "pos", "qname").sortWithinPartitions("ref", "pos", "qname") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else placed.orderBy("ref", "pos", "qname")
    ordered = dealt.select("qname", "flag", "ref", "pos", "mapq", "cigar", "seq", "chrom", F.coalesce(ref_span(F.col("cigar")), F.lit(0)).alias("span"))
    depth, folder = depth_for(max((size for _, size in contigs), default=0)), f"{path}.{uuid.uuid4().hex}"
    try:
        write_parts(ordered.mapInArrow(pack, "record binary, chrom string, begin bigint, end bigint"), folder, depth)
        joined(spark, folder, path, depth, b"".join(packed([head])), [n for n, _ in contigs])
    finally:
        shutil.rmtree(folder, ignore_errors=True)
