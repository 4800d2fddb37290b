"""Arrays of small HDF5 files: what a statistics file needs, without a library.

Files as they are written by default are read: a superblock of version 0 or 1, groups by symbol tables, object headers of version 1,
and numbers stored compact, in one piece or in chunks, also deflated and shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from ..config import ConfigError

# Fixed values of the format: signature, numbers of messages and of filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, TYPE, LAYOUT, FILTERS, CONTINUED, TABLE = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE = 1, 2
NOWHERE = (1 << 64) - 1


class Hdf5Error(ConfigError):
    """A file that is no HDF5 file, or of a kind that isn't read."""


class File:
    """The root group's arrays by name."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != SIGNATURE:
            raise Hdf5Error("no HDF5 file")
        if data[8] > 1 or data[13:15] != b"\x08\x08":
            raise Hdf5Error("only files of the default version are read")
        entry = 24 + 4 * (data[8] == 1) + 32  # addresses of base, free space, end and driver come first
        self.root = struct.unpack_from("<Q", data, entry + 8)[0]
        self.names = dict(self._links(self._messages(self.root)))

    def _messages(self, at: int) -> list[tuple[int, bytes]]:
        """Kind and body of every message of an object header."""
        version, _, _, _, size = struct.unpack_from("<BBHII", self.data, at)
        if version != 1:
            raise Hdf5Error("only object headers of version 1 are read")
        todo, out = [(at + 16, size)], []
        while todo:
            place, size = todo.pop(0)
            end = place + size
            while place + 8 <= end:
                kind, length = struct.unpack_from("<HH", self.data, place)
                body = self.data[place + 8 : place + 8 + length]
                if kind == CONTINUED:
                    todo.append(struct.unpack_from("<QQ", body))
                out.append((kind, body))
                place += 8 + length
        return out

    def _links(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        for kind, body in messages:
            if kind == TABLE:
                tree, heap = struct.unpack_from("<QQ", body)
                names = struct.unpack_from("<Q", self.data, heap + 24)[0]
                yield from self._group(tree, names)

    def _group(self, at: int, names: int) -> Iterator[tuple[str, int]]:
        if self.data[at : at + 4] == b"SNOD":
            for k in range(struct.unpack_from("<H", self.data, at + 6)[0]):
                name, header = struct.unpack_from("<QQ", self.data, at + 8 + 40 * k)
                begin = names + name
                yield self.data[begin : self.data.index(b"\0", begin)].decode(), header
            return
        used = struct.unpack_from("<H", self.data, at + 6)[0]
        for k in range(used):
            yield from self._group(struct.unpack_from("<Q", self.data, at + 32 + 16 * k)[0], names)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.names:
            raise Hdf5Error(f"the file has no {name}")
        parts = dict(reversed(self._messages(self.names[name])))
        if not {SPACE, TYPE, LAYOUT} <= set(parts):
            raise Hdf5Error(f"{name} is no array")
        space = parts[SPACE]
        shape = struct.unpack_from(f"<{space[1]}Q", space, 8 if space[0] == 1 else 4)
        kind, layout = self._number(parts[TYPE]), parts[LAYOUT]
        if layout[0] != 3:
            raise Hdf5Error(f"{name} has a layout that isn't read")
        if layout[1] == 0:
            return np.frombuffer(layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]], kind).reshape(shape)
        if layout[1] == 1:
            at, size = struct.unpack_from("<QQ", layout, 2)
            return np.zeros(shape, kind) if at == NOWHERE else np.frombuffer(self.data[at : at + size], kind).reshape(shape)
        return self._chunked(shape, kind, layout, parts.get(FILTERS))

    @staticmethod
    def _number(body: bytes) -> np.dtype:
        size = struct.unpack_from("<I", body, 4)[0]
        order = ">" if body[1] & 1 else "<"
        if body[0] & 15 == 1:
            return np.dtype(f"{order}f{size}")
        if body[0] & 15 == 0:
            return np.dtype(f"{order}{'i' if body[1] & 8 else 'u'}{size}")
        raise Hdf5Error("only numbers are read")

    def _chunked(self, shape: tuple[int, ...], kind: np.dtype, layout: bytes, filters: bytes | None) -> np.ndarray:
        rank = layout[2] - 1
        tree = struct.unpack_from("<Q", layout, 3)[0]
        size = struct.unpack_from(f"<{rank}I", layout, 11)
        steps, out = self._filters(filters), np.zeros(shape, kind)
        for begin, left_out, raw in self._chunks(tree, rank):
            for k, step in reversed([*enumerate(steps)]):
                if not left_out >> k & 1:
                    raw = zlib.decompress(raw) if step == DEFLATE else np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.tobytes()
            piece = np.frombuffer(raw, kind).reshape(size)
            inside = tuple(slice(a, min(a + n, whole)) for a, n, whole in zip(begin, size, shape, strict=True))
            out[inside] = piece[tuple(slice(0, x.stop - x.start) for x in inside)]
        return out

    def _chunks(self, at: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, bytes]]:
        """Begin, filters left out, and bytes of each chunk."""
        if at == NOWHERE:
            return
        level, used = self.data[at + 5], struct.unpack_from("<H", self.data, at + 6)[0]
        step = 8 + 8 * (rank + 1)
        for k in range(used):
            key = at + 24 + k * (step + 8)
            length, left_out = struct.unpack_from("<II", self.data, key)
            begin = struct.unpack_from(f"<{rank}Q", self.data, key + 8)
            child = struct.unpack_from("<Q", self.data, key + step)[0]
            if level:
                yield from self._chunks(child, rank)
            else:
                yield begin, left_out, self.data[child : child + length]

    @staticmethod
    def _filters(body: bytes | None) -> list[int]:
        out: list[int] = []
        if body is None:
            return out
        at = 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            number, name, _, values = struct.unpack_from("<HHHH", body, at) if body[0] == 1 or struct.unpack_from("<H", body, at)[0] >= 256 else (*struct.unpack_from("<H", body, at), 0, *struct.unpack_from("<HH", body, at + 2))
            at += (8 if body[0] == 1 or number >= 256 else 6) + name + 4 * values + 4 * (values % 2 and body[0] == 1)
            if number not in (DEFLATE, SHUFFLE):
                raise Hdf5Error(f"filter {number} is not read")
            out.append(number)
        return out


def read_arrays(path: str, names: tuple[str, ...]) -> list[np.ndarray]:
    with open(path, "rb") as f:
        own = File(f.read())
    return [own[x] for x in names]
