"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is what BPE merges a text into exactly if each two neighbours are compatible: merging the bytes of the
pair on their own gives the pair back. So the encoder tries the longest token at each position (found for all positions by one
pass of an Aho-Corasick automaton over the reversed text), checks it against the token before, falls back to the next shorter
prefix token, and steps back if none fits; positions from which no continuation exists are remembered, so the whole is linear
in the text. The ids are ranks: a lower id is merged earlier."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np

#: Fixed value: the split of a text into pieces that byte_bpe_50k is defined with.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 400_000


class ByteBpe:
    """The vocabulary in a .tiktoken file (base64 token, rank per line), with its pair-compatibility table."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = [line.split() for line in f if line.strip()]
        self.tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in ranks))
        for token, rank in ranks:
            self.tokens[int(rank)] = base64.b64decode(token)
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.lengths = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self._prefixes()
        self._pairs()
        self.cache: dict[str, array] = {}
        # decoding: token i is blob[offsets[i]:offsets[i + 1]]
        self.blob = b"".join(self.tokens)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def _prefixes(self) -> None:
        """The longest token that is a proper prefix of each token, or -1."""
        self.prefix = [-1] * len(self.tokens)
        for t, i in self.ids.items():
            for k in range(len(t) - 1, 0, -1):
                if (shorter := self.ids.get(t[:k])) is not None:
                    self.prefix[i] = shorter
                    break

    def _pairs(self) -> None:
        """parts[i]: the two tokens that are merged into i (i twice for a single byte); merged: the same turned round."""
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            if len(t) < 2:
                continue
            left = self.prefix[i]
            while left >= 0:
                right = self.ids.get(t[self.lengths[left] :])
                if right is not None and left < i and right < i and self.compatible(left, right):
                    self.merged[left, right] = i
                    self.parts[i] = (left, right)
                    break
                left = self.prefix[left]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when the bytes of both are merged together.

        The merges are undone from the latest on, on the side of the greater id; at each border between the parts left, a merge
        that would have come before the last one undone means that the border would not have lasted. Of equal merges the
        leftmost comes first: the border's, if the last one undone was on the right."""
        before = 1 << 60
        merged, parts = self.merged, self.parts
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint < before:
                return False
            from_left = a > b
            if from_left and parts[a][1] == a:  # a single byte: only the other side can still be taken apart
                from_left = False
            elif not from_left and parts[b][0] == b:
                from_left = True
            if from_left:
                before, (_, inner) = a, parts[a]
                if inner == a:
                    return True
                a = inner
            else:
                before, (inner, _) = b + 1, parts[b]
                if inner == b:
                    return True
                b = inner

    def _longest(self, data: bytes) -> list[int]:
        """The longest token that starts at each position."""
        n = len(data)
        found = [-1] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            start = n - 1 - end
            if found[start] < 0:  # the first hit at a position is the longest
                found[start] = token
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, longest, lengths, prefix = len(data), self._longest(data), self.lengths, self.prefix
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + lengths[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos = end
                if pos < n:
                    token = longest[pos]
                continue
            token = prefix[token]
            if token < 0:  # nothing fits here
                dead[pos] = 1
                token = out.pop()
                pos -= lengths[token]
        return out

    def encode(self, text: str | None) -> array:
        """The ids of text; none for a null or an empty text. Strings of special tokens are ordinary text."""
        out = array("i")
        if not text:
            return out
        cache = self.cache
        for piece in self.pieces.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = array("i", self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> str:
        """The text of ids, by the offset table: one gather over the bytes of all tokens."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.frombuffer(self.blob, np.uint8)[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One copy per process and vocabulary."""
    return ByteBpe(path)
