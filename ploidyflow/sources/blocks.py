"""Block-compressed text, as a Python data source: spark.read.format("bgzf") and df.write.format("bgzf").

Writing gives a folder of parts, each a block-compressed file with an index of its own beside it. A task packs its
lines under a name of its attempt; only the commit, which moves what succeeded, makes parts of
those, so a task that is lost or runs twice leaves nothing. joined() makes one file of the parts: where each begins is a prefix sum of their
sizes, tasks copy them there, and the parts' indexes are merged with that shift. No line and no block passes the driver.

Reading deals files by bytes; each task looks for its first block and line. With a contig and positions, an index
beside the file names the blocks to read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..store import mounted

#: Most bytes of text in a block, and the empty block that ends a file (fixed value of the format).
BLOCK_TEXT = 65_280
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes that begin a block. Fixed value of the format.
BLOCK_HEAD = b"\x1f\x8b\x08\x04"
#: Compressed bytes to a task that reads, and bytes copied at once.
RANGE_BYTES, COPY_BYTES = 32 << 20, 8 << 20
#: Lines of a batch that goes to Spark.
BATCH = 8192
#: Bits of a smallest bin, and the levels that .tbi files have above it; their positions end at 2**29.
SHIFT, TBI_DEPTH = 14, 5
WRITTEN = "line string, chrom string, begin bigint, end bigint"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockSource)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), mounted(path))


def block(text: bytes, level: int = 6) -> bytes:
    """One gzip member of up to BLOCK_TEXT bytes with its size in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def packed(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Blocks of a stream of text, without the end mark."""
    held = b""
    for x in chunks:
        held += x
        for k in range(0, len(held) - BLOCK_TEXT + 1, BLOCK_TEXT):
            yield block(held[k : k + BLOCK_TEXT])
        held = held[len(held) // BLOCK_TEXT * BLOCK_TEXT :]
    if held:
        yield block(held)


# ------------------------------------------------------------------------- index


def depth_for(last: int) -> int:
    """Levels above the smallest bins, so that positions up to last have a bin; at least those of .tbi files."""
    depth = TBI_DEPTH
    while last > 1 << SHIFT + 3 * depth:
        depth += 1
    return depth


def bin_numbers(begin: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The smallest bin that holds each interval (0-based, half open)."""
    out = np.zeros(len(begin), np.int64)
    done = np.zeros(len(begin), bool)
    for level in range(depth, 0, -1):
        shift = SHIFT + 3 * (depth - level)
        same = ~done & (begin >> shift == end - 1 >> shift)
        out[same] = ((1 << 3 * level) - 1) // 7 + (begin[same] >> shift)
        done |= same
    return out


def bins_over(begin: int, end: int, depth: int) -> list[tuple[int, int]]:
    """(first, last) bins of each level that meet an interval."""
    return [(((1 << 3 * level) - 1) // 7 + (begin >> SHIFT + 3 * (depth - level)), ((1 << 3 * level) - 1) // 7 + (end - 1 >> SHIFT + 3 * (depth - level))) for level in range(depth + 1)]


@dataclass
class Index:
    """Of each contig, in order: bin to chunks of virtual offsets, and window of 2**SHIFT positions to the first offset."""

    depth: int = TBI_DEPTH
    names: list[str] = field(default_factory=list)
    bins: dict[str, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    linear: dict[str, dict[int, int]] = field(default_factory=dict)

    def contig(self, name: str) -> None:
        if name not in self.bins:
            self.names.append(name)
            self.bins[name], self.linear[name] = {}, {}

    def add(self, name: str, number: int, begin: int, end: int) -> None:
        self.contig(name)
        chunks = self.bins[name].setdefault(number, [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1] = (chunks[-1][0], end)
        else:
            chunks.append((begin, end))

    def window(self, name: str, number: int, begin: int) -> None:
        self.contig(name)
        self.linear[name][number] = min(begin, self.linear[name].get(number, begin))

    def merge(self, other: Index, shift: int) -> None:
        """Adds an index of text that follows, shift bytes on."""
        up = shift << 16
        for name in other.names:
            self.contig(name)
            for number, chunks in other.bins[name].items():
                for begin, end in chunks:
                    self.add(name, number, begin + up, end + up)
            for number, begin in other.linear[name].items():
                self.window(name, number, begin + up)

    def _filled(self, name: str) -> list[int]:
        own, out, at = self.linear[name], [], 0
        for w in range(max(own) + 1 if own else 0):
            at = own.get(w, at)
            out.append(at)
        return out

    def to_bytes(self) -> bytes:
        """A .tbi file's text, or a .csi file's if positions go beyond what that can hold."""
        joined = b"".join(x.encode() + b"\0" for x in self.names)
        columns = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(joined)) + joined
        csi = self.depth > TBI_DEPTH
        out = [b"CSI\1", struct.pack("<3i", SHIFT, self.depth, len(columns)), columns, struct.pack("<i", len(self.names))] if csi else [b"TBI\1", struct.pack("<i", len(self.names)), columns]
        out += self._contigs(csi)
        return b"".join(out)

    def bam_bytes(self) -> bytes:
        """The same as a .bai file's text, or, beyond what that can hold, a .csi file's without names."""
        csi = self.depth > TBI_DEPTH
        out = [b"CSI\1", struct.pack("<4i", SHIFT, self.depth, 0, len(self.names))] if csi else [b"BAI\1", struct.pack("<i", len(self.names))]
        return b"".join([*out, *self._contigs(csi)])

    def _contigs(self, csi: bool) -> Iterator[bytes]:
        for name in self.names:
            filled = self._filled(name)
            yield struct.pack("<i", len(self.bins[name]))
            for number, chunks in sorted(self.bins[name].items()):
                yield struct.pack("<IQi", number, self._least(filled, number), len(chunks)) if csi else struct.pack("<Ii", number, len(chunks))
                yield from (struct.pack("<QQ", *c) for c in chunks)
            if not csi:
                yield struct.pack("<i", len(filled)) + struct.pack(f"<{len(filled)}Q", *filled)

    def _least(self, filled: list[int], number: int) -> int:
        level = max(k for k in range(self.depth + 1) if number >= ((1 << 3 * k) - 1) // 7)
        window = number - ((1 << 3 * level) - 1) // 7 << 3 * (self.depth - level)
        return filled[min(window, len(filled) - 1)]

    @classmethod
    def from_bytes(cls, data: bytes, names: list[str] | None = None) -> Index:
        """An index of a .tbi, .csi or .bai file's text; names are the contigs of a BAM file, whose indexes have none."""
        kind, depth, at = data[:4], TBI_DEPTH, 8
        if kind == b"CSI\1":
            shift, depth, size = struct.unpack_from("<3i", data, 4)
            if shift != SHIFT:
                raise ValueError(f"smallest bins of 2**{shift} positions are not read")
            head, at = 16, 20 + size
        elif kind == b"TBI\1":
            head, at = 8, 36 + struct.unpack_from("<i", data, 32)[0]
        elif kind != b"BAI\1":
            raise ValueError("no index of a kind that is read")
        if names is None:
            names = [x.decode() for x in data[head + 28 : head + 28 + struct.unpack_from("<i", data, head + 24)[0]].split(b"\0")[:-1]]
        (n,) = struct.unpack_from("<i", data, at - 4 if kind == b"CSI\1" else 4)
        out, statistics = cls(depth), ((1 << 3 * (depth + 1)) - 1) // 7 + 1
        for name in names[:n]:
            out.contig(name)
            (bins,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(bins):
                (number,) = struct.unpack_from("<I", data, at)
                if kind == b"CSI\1":
                    if number != statistics:
                        out.linear[name][cls._first_window(number, depth)] = struct.unpack_from("<Q", data, at + 4)[0]
                    at += 8
                (k,) = struct.unpack_from("<i", data, at + 4)
                if number != statistics:
                    out.bins[name][number] = [struct.unpack_from("<QQ", data, at + 8 + 16 * j) for j in range(k)]
                at += 8 + 16 * k
            if kind != b"CSI\1":
                (k,) = struct.unpack_from("<i", data, at)
                out.linear[name] = dict(enumerate(struct.unpack_from(f"<{k}Q", data, at + 4)))
                at += 4 + 8 * k
        return out

    @staticmethod
    def _first_window(number: int, depth: int) -> int:
        level = max(k for k in range(depth + 1) if number >= ((1 << 3 * k) - 1) // 7)
        return number - ((1 << 3 * level) - 1) // 7 << 3 * (depth - level)

    def chunks(self, name: str, begin: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks that may hold lines of a contig's interval (0-based, half open)."""
        if name not in self.bins or end <= begin:
            return []
        end = min(end, 1 << SHIFT + 3 * self.depth)
        below = [v for w, v in self.linear[name].items() if w <= begin >> SHIFT]
        least = max(below, default=0) if self.depth == TBI_DEPTH else 0  # of a .csi only bins that hold a window's begin tell
        spans = bins_over(begin, end, self.depth)
        found = sorted(c for number, own in self.bins[name].items() if any(a <= number <= z for a, z in spans) for c in own if c[1] > least)
        out: list[tuple[int, int]] = []
        for a, z in found:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], z))
            else:
                out.append((a, z))
        return out


def read_index(path: str) -> Index | None:
    """The index beside a file, or None."""
    store, name = _store(path)
    for ending in (".tbi", ".csi"):
        try:
            with store.open_input_file(name + ending) as f:
                return Index.from_bytes(unpacked(f.read()))
        except FileNotFoundError:
            continue
    return None


def write_index(path: str, index: Index) -> str:
    store, name = _store(path)
    ending = ".csi" if index.depth > TBI_DEPTH else ".tbi"
    with store.open_output_stream(name + ending) as f:
        for x in packed([index.to_bytes()]):
            f.write(x)
        f.write(END_OF_FILE)
    return path + ending


def unpacked(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        out.append(zlib.decompress(data[at + 18 : at + size - 8], -15))
        at += size
    return b"".join(out)


class Runs:
    """The index of lines that come one batch after another, by places in the unpacked text."""

    def __init__(self, depth: int):
        self.depth, self.bins, self.windows = depth, [], {}

    def add(self, chrom: pa.Array, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Lines of contigs (null: no line of one), with their intervals and places."""
        has = np.flatnonzero(np.asarray(chrom.is_valid()))
        if not len(has):
            return
        names = chrom.take(pa.array(has)).dictionary_encode()
        key, labels = names.indices.to_numpy().astype(np.int64), names.dictionary.to_pylist()
        begin, end, first, last = begin[has].astype(np.int64), end[has].astype(np.int64), first[has], last[has]
        if end.max() > 1 << SHIFT + 3 * self.depth:
            raise ValueError(f"position {end.max()} is beyond the {1 << SHIFT + 3 * self.depth} that an index of {self.depth} levels holds")
        number = bin_numbers(begin, end, self.depth)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (first[1:] != last[:-1])])
        lead = np.flatnonzero(new)
        tail = np.append(lead[1:], len(key)) - 1
        self.bins += [(labels[k], b, a, z) for k, b, a, z in zip(key[lead].tolist(), number[lead].tolist(), first[lead].tolist(), last[tail].tolist(), strict=True)]
        low, high = begin >> SHIFT, end - 1 >> SHIFT
        for k, w, place in zip(*(x[(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1])]))].tolist() for x in (key, low, first)), strict=True):
            self._window((labels[k], w), place)
        for j in np.flatnonzero(high > low).tolist():
            for w in range(int(low[j]), int(high[j]) + 1):
                self._window((labels[key[j]], w), int(first[j]))

    def _window(self, key: tuple[str, int], place: int) -> None:
        self.windows[key] = min(place, self.windows.get(key, place))

    def index(self, virtual) -> Index:
        """virtual gives the virtual offset of a place."""
        out = Index(self.depth)
        for name, number, a, z in self.bins:
            out.add(name, number, virtual(a), virtual(z))
        for (name, w), place in self.windows.items():
            out.window(name, w, virtual(place))
        return out


# ------------------------------------------------------------------------ writing


@dataclass
class _Part(WriterCommitMessage):
    part: int
    name: str
    size: int
    index: bytes


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, path: str, depth: int, overwrite: bool):
        self.path, self.depth, self.overwrite = path.rstrip("/"), depth, overwrite
        self.attempts = f"{self.path}/_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        context = TaskContext.get()
        name = f"{self.attempts}/{context.partitionId()}-{context.taskAttemptId()}"
        store, own = _store(name)
        store.create_dir(_store(self.attempts)[1], recursive=True)
        runs, places, at = Runs(self.depth), [0], 0
        with store.open_output_stream(own) as f:

            def texts():
                nonlocal at
                for b in iterator:
                    text = b.schema.get_field_index("line") >= 0
                    lines = b.column("line").cast(pa.large_string()) if text else b.column("record")
                    ends = at + np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + text)
                    starts = np.concatenate([[at], ends[:-1]])
                    begin, end = (b.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "end"))
                    runs.add(b.column("chrom"), begin, end, starts, ends)
                    at = int(ends[-1]) if len(ends) else at
                    yield "".join(f"{x}\n" for x in lines.to_pylist()).encode() if text else b"".join(lines.to_pylist())

            for x in packed(texts()):
                f.write(x)
                places.append(places[-1] + len(x))
            f.write(END_OF_FILE)
        index = runs.index(lambda p: places[p // BLOCK_TEXT] << 16 | p % BLOCK_TEXT)
        return _Part(context.partitionId(), name, places[-1], index.to_bytes() if index.names else b"")

    def commit(self, messages: list[_Part]) -> None:
        store, folder = _store(self.path)
        if self.overwrite:
            from pyarrow import fs

            for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.base_name.startswith(("part-", "_parts.json")):
                    store.delete_file(x.path)
        parts = []
        for k, m in enumerate(sorted((m for m in messages if m is not None and m.size), key=lambda m: m.part)):
            name = f"part-{k:05d}.gz"
            store.move(_store(m.name)[1], f"{folder}/{name}")
            if m.index:
                write_index(f"{self.path}/{name}", Index.from_bytes(m.index))
            parts.append({"name": name, "size": m.size})
        with store.open_output_stream(f"{folder}/_parts.json") as f:
            f.write(json.dumps(parts).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        store, attempts = _store(self.attempts)
        store.create_dir(attempts, recursive=True)
        store.delete_dir(attempts)


def joined(spark: SparkSession, folder: str, path: str, depth: int = TBI_DEPTH, head: bytes = b"", contigs: list[str] | None = None) -> None:
    """One block-compressed file, with its index, of the parts of a folder. Both are in a mounted file system that all executors share.

    head are blocks to stand before the parts. With contigs, those of a BAM file, the index is one of such a file.

    Tasks copy parts to their places in a file of another name, which is given its own at the end.
    """
    import os

    store, source = _store(folder)
    target_store, target = _store(path)
    if target_store.type_name != "local" or store.type_name != "local":
        raise ValueError("parts are joined in a mounted file system; elsewhere the folder of parts is the target")
    with store.open_input_file(f"{source}/_parts.json") as f:
        parts = json.loads(f.read())
    places = (len(head) + np.concatenate([[0], np.cumsum([p["size"] for p in parts])])).astype(int).tolist()
    unfinished = f"{target}.{uuid.uuid4().hex}"
    with open(unfinished, "wb") as f:
        f.write(head)
        f.truncate(places[-1] + len(END_OF_FILE))
        f.seek(places[-1])
        f.write(END_OF_FILE)

    def copy(batches):
        for b in batches:
            for name, size, place in zip(*(b.column(c).to_pylist() for c in ("name", "size", "place")), strict=True):
                with open(f"{source}/{name}", "rb") as f, open(unfinished, "r+b") as out:
                    out.seek(place)
                    left = size
                    while left:
                        data = f.read(min(left, COPY_BYTES))
                        if not data:
                            raise EOFError(f"{name} is shorter than it was")
                        out.write(data)
                        left -= len(data)
        yield from ()

    if parts:
        rows = spark.createDataFrame([(p["name"], p["size"], at) for p, at in zip(parts, places, strict=False)], "name string, size bigint, place bigint")
        rows.repartition(len(parts), "name").mapInArrow(copy, "name string").count()
    index = Index(depth)
    for name in contigs or ():
        index.contig(name)
    for p, at in zip(parts, places, strict=False):
        if (own := read_index(f"{folder}/{p['name']}")) is not None:
            index.merge(own, at)
    os.replace(unfinished, target)
    if contigs is None:
        write_index(path, index)
    else:
        data, csi = index.bam_bytes(), depth > TBI_DEPTH
        with open(f"{target}{'.csi' if csi else '.bai'}", "wb") as f:
            f.write(b"".join(packed([data])) + END_OF_FILE if csi else data)


# ------------------------------------------------------------------------ reading


@dataclass
class _Span(InputPartition):
    """From one place to another: virtual offsets of lines, or offsets in the file that aren't known to begin a block."""

    path: str
    begin: int
    end: int
    known: bool


def first_block(f, offset: int, total: int) -> int:
    """Where the first block at an offset or after it begins."""
    at = offset
    while at < total:
        f.seek(at)
        window = f.read(1 << 17)
        hit = window.find(BLOCK_HEAD)
        if hit < 0:
            at += max(1, len(window) - 3)
            continue
        at += hit
        if _block_at(f, at, total) is not None:
            return at
        at += 1
    return total


def _block_at(f, at: int, total: int) -> tuple[int, bytes] | None:
    """Size and text of the block at a place; None if there is none."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18 or head[:4] != BLOCK_HEAD or head[12:16] != b"BC\x02\x00":
        return None
    size = struct.unpack_from("<H", head, 16)[0] + 1
    try:
        return size, zlib.decompress(f.read(size - 18)[:-8], -15)
    except zlib.error:
        return None


def lines_from(f, place: int, total: int) -> Iterator[tuple[int, int, bytes]]:
    """(virtual offset of its begin, of its end, line) of every line from a virtual offset on."""
    at, skip = place >> 16, place & 0xFFFF
    held, begin = b"", place
    while at < total and (got := _block_at(f, at, total)) is not None:
        size, text = got
        done, skip = skip, 0
        while (cut := text.find(b"\n", done)) >= 0:
            end = at << 16 | cut + 1 if cut + 1 < len(text) else at + size << 16
            yield begin, end, held + text[done:cut]
            held, begin, done = b"", end, cut + 1
        held += text[done:]
        at += size
    if held:
        yield begin, at << 16, held


ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("line", pa.string())])


class BlockReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, region: tuple[str, int, int] | None):
        self.path, self.range_bytes, self.region = path, range_bytes, region

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, name = _store(self.path)
        info = store.get_file_info(name)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        found = [x for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name.endswith(".gz") and not x.base_name.startswith(("_", "."))]
        return sorted((f"{self.path.rstrip('/')}/{x.base_name}", x.size) for x in found)

    def partitions(self) -> list[_Span]:
        out = []
        for path, size in self._files():
            index = read_index(path) if self.region else None
            if index is not None:
                chrom, first, last = self.region
                out += [_Span(path, a, z, True) for a, z in index.chunks(chrom, max(first - 1, 0), last)]
            else:
                cuts = [*range(0, size, self.range_bytes)]
                out += [_Span(path, a, z, False) for a, z in zip(cuts, [*cuts[1:], size], strict=True)]
        return out

    def read(self, partition: _Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives if there are no spans
            return
        rows: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            rows.clear()
            return out

        store, name = _store(partition.path)
        with store.open_input_file(name) as f:
            total = f.size()
            if partition.known:
                begin, end, skip = partition.begin, partition.end, False
            else:  # lines that begin after this part's begin, up to the next part's: the first line is the part before's
                begin, end = (first_block(f, x, total) << 16 for x in (partition.begin, partition.end))
                end, skip = end + 1 if partition.end < total else 1 << 62, partition.begin > 0
            if begin >= end:
                return
            for a, z, line in lines_from(f, begin, total):
                if a >= end:
                    break
                if skip:
                    skip = False
                    continue
                rows.append((partition.path, a, z, line.decode()))
                if len(rows) >= BATCH:
                    yield batch()
        if rows:
            yield batch()


class BlockSource(DataSource):
    """file, offset and end (virtual offsets), line of block-compressed text.

    Options to read: range_bytes (compressed bytes to a task); chrom, first, last (1-based): only blocks that may hold lines of those positions, by the index.
    Option to write: depth, the index's levels (see depth_for). What is written has the columns line, chrom, begin, end (0-based, half open; null: a line of no contig), in file order.
    """

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "file string, offset bigint, end bigint, line string"

    def reader(self, schema) -> BlockReader:
        chrom = self.options.get("chrom")
        region = (chrom, int(self.options.get("first", 1)), int(self.options.get("last", 1 << 44))) if chrom else None
        return BlockReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), region)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], int(self.options.get("depth", TBI_DEPTH)), overwrite)


def index_of(spark: SparkSession, path: str, depth: int | None = None) -> str:
    """Writes the index of a block-compressed VCF file beside it, made by tasks that read parts of it; returns its path."""
    register(spark)
    lines = spark.read.format("bgzf").load(path)
    from pyspark.sql import functions as F

    part = F.split("line", "\t", 5)
    begin = F.get(part, 1).cast("bigint") - 1
    rows = lines.where(~F.startswith("line", F.lit("#")) & (F.col("line") != "")).select(F.get(part, 0).alias("chrom"), begin.alias("begin"), (begin + F.greatest(F.length(F.get(part, 3)), F.lit(1))).alias("stop"), "offset", "end")
    if depth is None:
        depth = depth_for(rows.agg(F.max("stop")).first()[0] or 0)

    def run(batches):
        runs = Runs(depth)
        for b in batches:
            if b.num_rows:
                runs.add(b.column("chrom"), *(b.column(c).to_numpy() for c in ("begin", "stop", "offset", "end")))
        index = runs.index(int)
        if index.names:
            first = min(a for bins in index.bins.values() for chunks in bins.values() for a, _ in chunks)
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([index.to_bytes()], pa.binary())], ["first", "index"])

    whole = Index(depth)
    for r in sorted(rows.mapInArrow(run, "first bigint, index binary").collect()):  # bins of parts, no lines
        whole.merge(Index.from_bytes(bytes(r["index"])), 0)
    return write_index(path, whole)


def write_parts(lines: DataFrame, folder: str, depth: int = TBI_DEPTH) -> None:
    """Lines (columns of WRITTEN, or with record, its bytes, in place of line; in file order by partition) as parts in a folder."""
    register(lines.sparkSession)
    lines.select("line" if "line" in lines.columns else "record", "chrom", "begin", "end").write.format("bgzf").option("path", folder).option("depth", depth).mode("overwrite").save()
