"""Sorted hash arrays in the shared folder, mapped into memory by whoever reads them.

Keys of a table are distinct numbers of so many bits, spread by a bijection. Sorted, their
upper bits follow from their place, so four bytes of each are kept beside a directory
of the first place of each upper part. Counts take a byte; the few larger ones stand
in a list of their own.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections import OrderedDict

import numpy as np

from .common import U64, local_of

#: Arrays that a reader keeps mapped (a process may map 65,530), and bytes of those that it had to fetch, as the folder isn't mounted.
MOST_MAPPED = 1 << 15
FETCHED_BYTES = 256 << 20
#: Keys to an entry of the directory, as a power of 2.
STEP = 4
_MIX, _UNMIX = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOW = U64(0xFFFFFFFF)


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits; unspread() is its inverse."""
    mask, half = U64((1 << bits) - 1), U64((bits + 1) // 2)
    x = x * U64(_MIX) & mask
    return (x ^ (x >> half)) * U64(_MIX) & mask


def unspread(x: np.ndarray, bits: int) -> np.ndarray:
    mask, half = U64((1 << bits) - 1), U64((bits + 1) // 2)
    x = x * U64(_UNMIX) & mask
    return (x ^ (x >> half)) * U64(_UNMIX) & mask


def packed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower four bytes of ascending distinct keys, and the first place of each upper part."""
    upper = min(bits, max(bits - 32, len(keys).bit_length() - STEP, 0))
    start = np.zeros((1 << upper) + 1, np.uint32)
    np.cumsum(np.bincount((keys >> U64(bits - upper)).astype(np.int64), minlength=1 << upper), out=start[1:])
    return (keys & _LOW).astype(np.uint32), start


def find(low: np.ndarray, start: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Places of the keys, -1 where there is none."""
    if not len(low):
        return np.full(len(keys), -1, np.int64)
    upper = (len(start) - 1).bit_length() - 1
    part = (keys >> U64(bits - upper)).astype(np.int64)
    lo, end = start[part].astype(np.int64), start[part + 1].astype(np.int64)
    hi, want = end.copy(), (keys & _LOW).astype(np.uint32)
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = low[np.minimum(mid, len(low) - 1)] < want
        open_ = lo < hi
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return np.where((lo < end) & (low[np.minimum(lo, len(low) - 1)] == want), lo, -1)


def keys_at(low: np.ndarray, start: np.ndarray, bits: int, places: np.ndarray) -> np.ndarray:
    """The keys at the places."""
    upper = (len(start) - 1).bit_length() - 1
    part = np.searchsorted(start, places, "right").astype(U64) - U64(1)
    return ((part << U64(bits - upper)) & ~_LOW) | low[places].astype(U64)


class Folder:
    """Named arrays of a folder. Keeps a bounded number of them open."""

    def __init__(self, uri: str, most: int = MOST_MAPPED):
        self.uri, self.local, self.most = uri, local_of(uri), most
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def put(self, name: str, array: np.ndarray) -> None:
        """Writes an array so that a repeated or lost attempt leaves no half file."""
        own = f".{name}-{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(os.path.join(self.local, own), "wb") as f:
                np.save(f, array)
            os.replace(os.path.join(self.local, own), os.path.join(self.local, f"{name}.npy"))
            return
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{own}") as f:
            np.save(f, array)
        store.move(f"{path}/{own}", f"{path}/{name}.npy")

    def _read(self, name: str) -> np.ndarray:
        if self.local is not None:
            with open(os.path.join(self.local, f"{name}.npy"), "rb") as f:
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)  # no descriptor stays open
                return np.frombuffer(data, dtype, int(np.prod(shape)), f.tell()).reshape(shape)
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(f"{path}/{name}.npy") as f:
            return np.load(f)

    def get(self, name: str) -> np.ndarray | None:
        """The array, or None where there is none yet."""
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        try:
            found = self._read(name)
        except FileNotFoundError:
            return None
        self.open[name] = found
        while len(self.open) > self.most or self.local is None and len(self.open) > 1 and sum(x.nbytes for x in self.open.values()) > FETCHED_BYTES:
            self.open.popitem(last=False)
        return found

    def put_keys(self, name: str, keys: np.ndarray, bits: int) -> None:
        low, start = packed(keys, bits)
        self.put(f"{name}-start", start)
        self.put(name, low)

    def find(self, name: str, bits: int, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in a table, -1 where there is none."""
        low = self.get(name)
        return np.full(len(keys), -1, np.int64) if low is None else find(low, self.get(f"{name}-start"), bits, keys)

    def keys(self, name: str, bits: int, places: np.ndarray | None = None) -> np.ndarray | None:
        """The keys at the places, or all; None where there is no table."""
        low = self.get(name)
        return None if low is None else keys_at(low, self.get(f"{name}-start"), bits, np.arange(len(low)) if places is None else places)

    def put_counts(self, name: str, counts: np.ndarray) -> None:
        """Counts of any shape."""
        flat = counts.ravel()
        over = np.flatnonzero(flat >= 255)
        if len(over):
            self.put(f"{name}-over", np.stack([over, flat[over].astype(np.int64)]))
        self.put(name, np.minimum(counts, 255).astype(np.uint8))

    def counts(self, name: str, places: np.ndarray | slice = slice(None)) -> np.ndarray | None:
        """The counts at the places, or all; None where there is no table."""
        have = self.get(name)
        if have is None:
            return None
        out = have[places].astype(np.int64)
        if len(large := np.flatnonzero(out.ravel() == 255)):
            wide = out.size // len(out)
            row = large // wide if isinstance(places, slice) else places[large // wide]
            over, values = self.get(f"{name}-over")
            out.ravel()[large] = values[np.searchsorted(over, row * wide + large % wide)]
        return out
