"""Byte-level BPE from a tokenizer file: merges by a queue of ranks over a linked list of symbols, decoding by concatenation."""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import regex

#: Fixed value: the pattern that splits a text into the pieces within which merges happen.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters only, in the faster standard engine: its character classes up to U+024F, written out.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
#: Characters beyond those, and four that only the standard engine counts as white space.
NOT_LATIN = re.compile("[^\x00-\x1b\x20-ɏ]")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class BytePairCodec:
    """Encodes and decodes as the tokenizer file says.  Pieces seen lately are kept, at most ``keep`` of them."""

    def __init__(self, path: str, keep: int = 700_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [vocab[c] for c in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        size = 1 + max(*vocab.values(), *self.special.values())
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimals = [str(i) for i in range(size)]
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.keep = keep
        self.known = _Pieces(self)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the lowest ranked pair merges first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        if not queue:
            return tuple(ids)
        heapify(queue)
        while queue:
            _, i, left, right, made = heappop(queue)
            j = after[i]
            # An entry is stale if a neighbour has merged since: the symbols or the link differ.
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((made, ids[k]))
                if m:
                    heappush(queue, (m[0], i, made, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], made))
                if m:
                    heappush(queue, (m[0], h, ids[h], made, m[1]))
        return tuple([x for x in ids if x >= 0])

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if NOT_LATIN.search(text) else LATIN).findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens become their ids."""
        if self.split_special and any(s in text for s in self.special):
            out: list[int] = []
            for k, part in enumerate(self.split_special.split(text)):
                if k % 2:
                    out.append(self.special[part])
                else:
                    out.extend(chain.from_iterable(map(self.known.__getitem__, self.pieces(part))))
        else:
            out = list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))
        if len(self.known) > self.keep:
            self.known.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.codec.merge(piece.encode("utf-8", "surrogatepass"))
        # A long piece will hardly come again.
        if len(ids) <= 24:
            self[piece] = ids
        return ids
