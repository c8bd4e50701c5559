"""Ids of a byte-level BPE vocabulary for whole batches of texts, inside tasks.

A text is cut around the vocabulary's added tokens, and before spaces that follow a visible character, where the tokenizer's
pattern never has a match across; each distinct piece is then encoded once.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import slabs, span_hashes

#: Bytes after which a following space starts a new piece: visible ASCII. (A letter À-ÿ ends with 0x80-0xBF after 0xC3.)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: A task remembers the results of so many distinct pieces, then starts anew.
SEEN_PIECES = 1_000_000
#: Bytes of text that a task works on at once.
SLAB = 1 << 20

_encoders: dict = {}


def _byte_of_char() -> dict[str, int]:
    """The public table by which byte-level vocabularies write bytes as visible characters."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of all pieces, and the ids of added tokens, of a vocabulary file: a .json file of the tokenizers library, or a base64
    piece and its rank on each line."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        byte = _byte_of_char()
        return {bytes(map(byte.__getitem__, piece)): i for piece, i in content["model"]["vocab"].items() if piece not in added}, added
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}, {}


def encoder(path: str, pattern: str):
    """(ids of a piece, the added tokens) of a vocabulary; made once in each process."""
    import tiktoken

    if (path, pattern) not in _encoders:
        ranks, added = read_vocabulary(path)
        ordinary = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _encoders[path, pattern] = (lambda piece: [added[piece]] if piece in added else ordinary(piece)), tuple(added)
    return _encoders[path, pattern]


def _cuts(raw: bytes, data: np.ndarray, at: np.ndarray, added: tuple[str, ...]) -> np.ndarray:
    """Where pieces start: at each document, at each space that follows a visible character, and around added tokens."""
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before, here = data[:-1], data[1:]
        ok = _VISIBLE[before]
        ok[1:] |= (before[1:] >= 0x80) & (before[1:] < 0xC0) & (data[:-2] == 0xC3)
        start[1:-1] = ok & (here == 0x20)
    if added:
        longest = sorted((a.encode() for a in added), key=len, reverse=True)
        found = [m.span() for m in re.finditer(b"|".join(map(re.escape, longest)), raw)]
        for a, b in found:
            if np.searchsorted(at, a, "right") == np.searchsorted(at, b, "left"):  # both ends in one document
                start[a + 1 : b] = False
                start[[a, b]] = True
    start[at[:-1]] = True
    return np.flatnonzero(start[: len(data)])


class SeenPieces:
    """What the pieces that a task met so far were encoded to, by their hashes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def places(self, hashes: np.ndarray, encoded) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size in ``ids`` of each piece; ``hashes`` are distinct and ascending, ``encoded`` gives the ids of piece i."""
        if len(self.hashes) > SEEN_PIECES:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        old = at < len(self.hashes)
        new[old] = self.hashes[at[old]] != hashes[old]
        found = [array("I", encoded(i)).tobytes() for i in np.flatnonzero(new).tolist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        for name, value in (("hashes", hashes[new]), ("begin", begin), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at[new], value))
        at = np.searchsorted(self.hashes, hashes)
        return self.begin[at], self.size[at]


def encoded_slabs(column: pa.Array, encode, added: tuple[str, ...] = (), seen: SeenPieces | None = None, limit: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, ids, offsets of the rows' ids) for consecutive rows of a text column; null counts as empty.
    ``encode``: the ids of one piece; ``seen``: earlier pieces, kept by the caller."""
    seen = SeenPieces() if seen is None else seen
    for row, data, at in slabs(column, limit):
        n = len(at) - 1
        if not len(data):
            yield row, np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
            continue
        raw = data.tobytes()
        start = _cuts(raw, data, at, added)
        hashes, first, piece = np.unique(span_hashes(data, start, np.append(start[1:], len(data))), return_index=True, return_inverse=True)
        a, b = start[first].tolist(), np.append(start[1:], len(data))[first].tolist()
        begin, size = seen.places(hashes, lambda i: encode(raw[a[i] : b[i]].decode()))
        count = size[piece]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = seen.ids[np.repeat(begin[piece] - total[:-1], count) + np.arange(total[-1])]
        yield row, ids, total[np.searchsorted(start, at)]
