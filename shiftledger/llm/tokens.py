"""Token ids of many texts by a public tokenizer file.

The tokenizer lower-cases, drops white space and never joins across it, nor across the border of an ASCII letter and
ASCII punctuation. So texts are cut there, each distinct piece is encoded once per worker, and ids are put together
with array operations. The piece table is dropped when it is full, which bounds its memory.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers

from shiftledger.llm import text as T

TOKENIZER = "word_bpe_49k.json"
MOST_PIECES = 400_000
BATCH = 5000

_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[[ord("'"), *range(ord("0"), ord("9") + 1)]] = _OTHER
for _first in "Aa":
    _KIND[ord(_first):ord(_first) + 26] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Encoder:
    """`encode` gives the ids of all texts of a segment, and how many each text has."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True  # control strings inside a text are ordinary text
        self._empty()

    def _empty(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.known) + len(hashes) > MOST_PIECES and len(self.known):
            self._empty()
        counts, flat = [], []
        for k in range(0, len(pieces), BATCH):
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k:k + BATCH], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            flat.append(np.fromiter((i for ids in encoded for i in ids), np.uint32, int(counts[-1].sum())))
        counts, flat = np.concatenate(counts), np.concatenate(flat)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, flat])
        order = np.argsort(all_known := np.concatenate([self.known, hashes]), kind="stable")
        self.known = all_known[order]
        self.start = np.concatenate([self.start, starts])[order]
        self.count = np.concatenate([self.count, counts])[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return at

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by `end_id` if given, and the count of each text."""
        kind = _KIND[data]
        inside = kind != _SPACE
        first = inside.copy()
        if len(data):
            a, b = kind[:-1], kind[1:]
            first[1:] &= (a == _SPACE) | (a + b == _LETTER + _MARK) & (a != _SPACE) & (b != _SPACE)
            cuts = at[1:-1][at[1:-1] < len(data)]
            first[cuts] = inside[cuts]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(starts):  # a piece ends where white space begins or the text ends
            spaces = np.flatnonzero(~inside)
            after = np.append(spaces, len(data))[np.searchsorted(spaces, starts)]
            texts_end = at[np.searchsorted(at, starts, "right")]
            ends = np.minimum(np.minimum(ends, after), texts_end)
        hashes, where, back = np.unique(T.byte_hashes(_LOWER[data], starts, ends), return_index=True, return_inverse=True)
        found = self._find(hashes) if len(self.known) else np.zeros(len(hashes), np.int64)
        new = self.known[found] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            if len(self.known) + new.sum() > MOST_PIECES:
                self._empty()
                new[:] = True
            raw = data.tobytes()
            self._learn(hashes[new], [raw[starts[i]:ends[i]].decode() for i in where[new]])
            found = self._find(hashes)
        start, count = self.start[found][back], self.count[found][back]
        before = np.searchsorted(starts, at)  # pieces before each text
        ids = self.ids
        if end_id is not None:
            ids = np.append(ids, np.uint32(end_id))
            start = np.insert(start, before[1:], len(ids) - 1)
            count = np.insert(count, before[1:], 1)
            before = before + np.arange(len(before))
        total = np.concatenate([[0], np.cumsum(count)])
        flat = ids[np.repeat(start - total[:-1], count) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        return flat, np.diff(total[before])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """The encoder of this worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
