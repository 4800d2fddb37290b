"""Pieces' ids by table: encoding of a slice of texts without a Python object a word.

The buffer's bytes are cut into pieces (see pieces.py), each piece is hashed, and a
table with open addressing, in numpy arrays, gives where its ids stand in a pool.
Probes of all pieces go side by side, so the memory's delays overlap. Only pieces
that the table lacks become strings and go to the library. A piece is known by two
independent hashes of its bytes, of 64 and of 32 bits.
"""

from __future__ import annotations

import numpy as np

from .common import U64, word_hashes
from .pieces import PieceEncoder

#: Slots of the table (a power of 2) and the part of them that is filled at most.
SLOT_BITS = 22
FULL = 0.6
#: ids in the pool (4 bytes each) from which on the table begins anew: long pieces, of texts without spaces, fill it before the slots.
POOL_IDS = 1 << 23

_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
#: Controls, and bytes that begin a white space of several: texts with them take the slower path.
_ODD = np.zeros(256, np.uint8)
_ODD[[*range(10), *range(11, 32)]] = 1
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_WIDE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def odd_documents(data: np.ndarray, bounds: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Documents with white space other than spaces and line breaks, other controls, or an added token."""
    odd = np.zeros(len(bounds) - 1, bool)
    kinds = _ODD[data]
    at = np.flatnonzero(kinds)
    raw = data.tobytes()
    for p in at[kinds[at] == 2].tolist():
        if raw[p : p + 3].startswith(_WIDE):
            kinds[p] = 1
    at = at[kinds[at] == 1]
    odd[np.searchsorted(bounds, at, "right") - 1] = True
    for token in added:
        p = raw.find(token)
        while p >= 0:
            odd[np.searchsorted(bounds, p, "right") - 1] = True
            p = raw.find(token, p + 1)
    return odd


class PieceTable:
    """ids of whole texts as the tokenizers library gives them with add_special_tokens=False."""

    def __init__(self, encoder: PieceEncoder, bits: int = SLOT_BITS, pool_ids: int = POOL_IDS):
        self.encoder, self.bits, self.pool_ids = encoder, bits, pool_ids
        self.added = [x.encode() for x in encoder.added]
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.key, self.check = np.zeros(n, U64), np.zeros(n, np.uint32)
        self.at, self.size = np.zeros(n, np.int64), np.zeros(n, np.uint16)
        self.filled, self.used = 0, 0
        self.pool = np.zeros(1 << 16, "<u4")

    def _probe(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each piece, or -1."""
        mask = (1 << self.bits) - 1
        out = np.full(len(key), -1)
        live = np.arange(len(key))
        slot = (key & U64(mask)).astype(np.int64)
        while len(live):
            have = self.key[slot]
            hit = (have == key[live]) & (self.check[slot] == check[live])
            out[live[hit]] = slot[hit]
            go = ~hit & (have != 0)
            live, slot = live[go], (slot[go] + 1) & mask
        return out

    def _insert(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct new pieces with their ids, end to end."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.filled += len(key)
        mask = (1 << self.bits) - 1
        live, slot = np.arange(len(key)), (key & U64(mask)).astype(np.int64)
        while len(live):
            free = self.key[slot] == 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            win = first[free[first]]
            s, w = slot[win], live[win]
            self.key[s], self.check[s], self.at[s], self.size[s] = key[w], check[w], at[w], counts[w]
            rest = np.ones(len(live), bool)
            rest[win] = False
            live, slot = live[rest], slot[rest]
            slot = np.where(self.key[slot] == 0, slot, (slot + 1) & mask)

    def _encode_plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents, none of them odd, end to end, and how many each has."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        gap = _BREAK[data]
        cut = gap.copy()
        cut[1:] &= ~gap[:-1]
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        key = word_hashes(data, starts, ends) | U64(1)  # zero marks a free slot
        check = (word_hashes(data, starts, ends, seed=1) >> U64(32)).astype(np.uint32)
        if self.filled > FULL * (1 << self.bits) or self.used > self.pool_ids:
            self._clear()
        slot = self._probe(key, check)
        missing = np.flatnonzero(slot < 0)
        long = ends - starts > 1 << 15  # a count of ids has 16 bits
        if len(missing):
            own = missing[self._distinct(key[missing], check[missing])]
            if self.filled + len(own) > 0.9 * (1 << self.bits) or long.any():
                return self._by_strings(data, bounds)
            raw = data.tobytes()
            words = [str(raw[a:b], "utf-8") for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            tail = gap[ends[own] - 1]
            order = np.argsort(tail, kind="stable")  # pieces that end in white space can't stand before another
            own, words = own[order], [words[k] for k in order.tolist()]
            split = int((~tail).sum())
            for a, b in ((0, split), (split, len(own))):
                if a < b:
                    self._insert(key[own[a:b]], check[own[a:b]], *self.encoder.library_ids(words[a:b]))
            slot[missing] = self._probe(key[missing], check[missing])
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        before = np.cumsum(size) - size
        ids = self.pool[np.repeat(at - before, size) + np.arange(int(size.sum()))]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[np.searchsorted(starts, bounds)])

    @staticmethod
    def _distinct(key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """First place of each distinct pair."""
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        return order[np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])]

    def _by_strings(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = self.encoder.encode([str(raw[a:b], "utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        return np.frombuffer(b"".join(texts), "<u4"), np.array([len(x) // 4 for x in texts], np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents of a slice end to end, and how many each has."""
        odd = odd_documents(data, bounds, self.added) if self.encoder.cuts else np.ones(len(bounds) - 1, bool)
        edge = np.concatenate([[0], np.flatnonzero(odd[1:] != odd[:-1]) + 1, [len(odd)]]).tolist()
        ids, counts = [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            i, n = self._by_strings(part, own) if odd[a] else self._encode_plain(part, own)
            ids.append(i)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


_tables: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """The worker's table for a vocabulary file; tasks that share the worker share it."""
    from .pieces import encoder

    if path not in _tables:
        _tables[path] = PieceTable(encoder(path))
    return _tables[path]
