"""Encoding by the tokenizers library, one call for every distinct piece of text.

A byte-level BPE first cuts a text by a fixed pattern in which no token holds
white space after another character. So the place between a character that is
not white space and one that is, always is a cut, and the pieces between such
places can be encoded one by one. Each distinct piece goes to the library once
and its ids are kept in a bounded cache.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Pieces that a worker keeps, and the longest piece kept.
CACHE_PIECES = 600_000
CACHE_CHARS = 48
#: Pieces encoded in one call.
RUN = 2000

_TIGHT = re.compile(r"\s[ \n]|\0")
_CUT = re.compile(r"(?<=\S)(?=\s)")


class PieceEncoder:
    """ids of texts as the tokenizers library gives them with add_special_tokens=False."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        form = json.loads(self.tokenizer.to_str())
        cut = form.get("pre_tokenizer") or {}
        #: Otherwise every text is one piece.
        self.cuts = form.get("normalizer") is None and form["model"].get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.added = [x["content"] for x in form.get("added_tokens", [])]
        self.most = most
        self.lengths = np.array([len(x) for x in token_bytes(self.tokenizer)]) if self.cuts else None
        self.ids: dict[str, bytes] = {"": b""}

    def pieces(self, text: str) -> list[str]:
        """Pieces that can be encoded alone. A text that spells an added token is left whole."""
        if not self.cuts or any(x in text for x in self.added):
            return [text]
        if _TIGHT.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def learn(self, lists: list[list[str]]) -> list[str]:
        """Makes self.ids hold every piece of the lists; returns those to forget() afterwards."""
        wanted = set(chain.from_iterable(lists))
        self.make_room(wanted)
        return self._learn_missing(list(wanted.difference(self.ids)))

    def make_room(self, wanted: set[str]) -> None:
        """Once the cache is full, only what is wanted again stays."""
        if len(self.ids) > self.most:
            self.ids = {x: self.ids[x] for x in wanted.intersection(self.ids)} | {"": b""}

    def _learn_missing(self, missing: list[str]) -> list[str]:
        plain = [x for x in missing if x and not x[-1].isspace()]
        for own in (plain, [x for x in missing if not x or x[-1].isspace()]):
            ids, counts = self.library_ids(own)
            raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            self.ids.update(zip(own, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if own else [], strict=True))
        return [x for x in missing if len(x) > CACHE_CHARS]

    def library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all pieces, end to end, and how many each has."""
        ids, counts = zip(*[self._run_ids(pieces[at : at + RUN]) for at in range(0, len(pieces), RUN)], strict=True) if pieces else ([], [])
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([*chain.from_iterable(found)], "<u4"), np.array([*map(len, found)], np.int64)

    def _run_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces end to end in one text, as each begins at a sure cut, and parts the ids by their bytes.

        The library has a fixed cost a call, which is more than that of a word.
        """
        # a line break before anything that isn't white space is a token of its own
        bare = [not x[:1].isspace() for x in pieces]
        text = "".join(["\n" + x if b else x for x, b in zip(pieces, bare, strict=True)])
        if not self.cuts or any(x[-1:].isspace() or not x for x in pieces) or any(t in text for t in self.added):
            return self._alone(pieces)
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids, skip = np.array(found.ids, "<u4"), np.array(bare)
        sizes = np.array([*map(len, pieces)] if text.isascii() else [len(x.encode()) for x in pieces])
        ends, upto = np.cumsum(sizes + skip), np.cumsum(self.lengths[ids])
        last = np.searchsorted(upto, ends) + 1
        if not np.array_equal(upto[last - 1], ends):
            raise ValueError("a token spans two pieces: the vocabulary isn't cut as supposed")
        first = np.concatenate([[0], last[:-1]])
        keep = np.ones(len(ids), bool)
        keep[first[skip]] = False
        return ids[keep], last - first - skip

    def forget(self, pieces: list[str]) -> None:
        for x in pieces:
            self.ids.pop(x, None)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        lists = [self.pieces(x) for x in texts]
        long = self.learn(lists)
        get = self.ids.__getitem__
        out = [b"".join(map(get, x)) for x in lists]
        self.forget(long)
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; tasks that share the worker share its cache."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary decodes to."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if all(c in byte_of for c in token):
            out[i] = bytes(byte_of[c] for c in token)
        else:
            out[i] = token.encode()
    return out
