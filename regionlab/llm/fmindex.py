"""A compressed full-text index over words (FM-index) that counts and lists the texts holding a run of words.

The Burrows-Wheeler transform of a set of texts is kept as a *wavelet matrix*: one bit vector for each binary digit of a word's number,
with the ones counted before every 64 bits. That answers "how often does this word precede one of the first r suffixes", which is all
that backward search needs, and gives the texts back, so they are not kept. Besides there is only the number of the text every suffix
begins in. With some 15 bits for a word's number an index takes about 5 bytes a word, less than half of the words' own UTF-8.

Everything works on arrays of positions at once.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np


@dataclass
class WaveletMatrix:
    """A sequence of numbers, by one bit vector for each of their binary digits, the highest first."""

    bits: np.ndarray  # digits x words of 64 bits
    ones: np.ndarray  # ones before each of these words
    zeros: np.ndarray  # of every digit
    base: np.ndarray  # of every number, where its block begins below the last digit

    @classmethod
    def of(cls, sequence: np.ndarray, numbers: int) -> WaveletMatrix:
        digits = max(1, int(numbers - 1).bit_length())
        words = len(sequence) // 64 + 1
        bits = np.zeros((digits, words), np.uint64)
        zeros = np.zeros(digits, np.int64)
        for d in range(digits):
            one = (sequence >> (digits - 1 - d)) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            bits[d].view(np.uint8)[: len(packed)] = packed
            zeros[d] = len(one) - one.sum()
            sequence = np.concatenate([sequence[~one], sequence[one]])
        ones = np.zeros((digits, words), np.uint32)
        np.cumsum(np.bitwise_count(bits[:, :-1]), axis=1, dtype=np.uint32, out=ones[:, 1:])
        base = np.zeros(numbers, np.int64)
        held, first = np.unique(sequence, return_index=True)
        base[held] = first
        return cls(bits, ones, zeros, base)

    def _ones(self, digit: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = self.bits[digit][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.ones[digit][word].astype(np.int64) + np.bitwise_count(below)

    def count(self, number: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``number`` occurs before the place ``end``."""
        at = end.astype(np.int64)
        for d in range(len(self.bits)):
            ones = self._ones(d, at)
            at = np.where((number >> (len(self.bits) - 1 - d)) & 1 == 1, self.zeros[d] + ones, at - ones)
        return at - self.base[number]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at ``place``, and how often each occurs before it."""
        at, number = place.astype(np.int64), np.zeros(len(place), np.int64)
        for d in range(len(self.bits)):
            one = (self.bits[d][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(d, at)
            at = np.where(one, self.zeros[d] + ones, at - ones)
            number = number * 2 + one
        return number, at - self.base[number]


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of what follows there, by ranks of 1, 2, 4, ... numbers until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)  # what follows the end comes first
        if width < n:
            ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, (key[1:] != key[:-1]).astype(np.int64)])
        width *= 2
        if width >= n or rank[order[-1]] == n - 1:
            return order


@dataclass
class Index:
    """The texts of one shard. Number 0 ends every text; words have numbers from 1."""

    run: int  # words of the runs by which texts are looked for
    keys: list[str]
    vocabulary: dict[str, int]
    sizes: np.ndarray  # words of every text
    transform: WaveletMatrix
    first: np.ndarray  # suffixes that begin with a smaller number
    owner: np.ndarray  # the text every suffix begins in
    ends: np.ndarray  # the suffix that begins with every text's end
    signs: np.ndarray  # a bit for every word of a text, by its number

    @classmethod
    def build(cls, keys: list[str], texts: list[str], run: int) -> Index:
        vocabulary: dict[str, int] = {}
        parts = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in t.split(" ")] for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        text = np.array([s for p in parts for s in (*p, 0)], np.int64)
        numbers = len(vocabulary) + 1
        order = sorted_suffixes(text)
        of = np.repeat(np.arange(len(texts)), sizes + 1)
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text))
        first = np.r_[0, np.cumsum(np.bincount(text, minlength=numbers))].astype(np.int64)
        words = of[text > 0], text[text > 0]
        width = 64 * int(np.clip(np.ceil(6 * sizes.max(initial=1) / 64), 1, 64))
        owner = of[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.uint32)
        ends = rank[np.cumsum(sizes + 1) - 1].astype(np.int32)
        return cls(run, keys, vocabulary, sizes, WaveletMatrix.of(text[order - 1], numbers), first, owner, ends, signatures(len(texts), *words, width))

    def dump(self) -> bytes:
        return zlib.compress(pickle.dumps(self, protocol=5), 1)

    @staticmethod
    def load(blob: bytes) -> Index:
        return pickle.loads(zlib.decompress(blob))

    def numbered(self, words: list[str]) -> list[int]:
        """Numbers of the words, 0 for those no text holds."""
        get = self.vocabulary.get
        return [get(w, 0) for w in words]

    def search(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): the suffixes that begin with each row of ``runs``, word numbers above 0, by backward search from its last word."""
        last = runs[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(runs.shape[1] - 2, -1, -1):
            w = runs[:, k]
            both = self.transform.count(np.r_[w, w], np.r_[low, high])
            low, high = self.first[w] + both[: len(w)], self.first[w] + both[len(w) :]
        return low, high

    def texts(self, which: np.ndarray) -> list[list[int]]:
        """The word numbers of texts, read off the transform from their ends back, all at once."""
        out = np.zeros((int(self.sizes[which].sum())), np.int64)
        stop = np.cumsum(self.sizes[which])
        at, left, place = self.ends[which].astype(np.int64), self.sizes[which].copy(), stop - 1
        while (going := np.flatnonzero(left > 0)).size:
            number, before = self.transform.at(at[going])
            out[place[going]] = number
            at[going] = self.first[number] + before
            place[going] -= 1
            left[going] -= 1
        return [x.tolist() for x in np.split(out, stop[:-1])]


def signatures(rows: int, of: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
    """A bit set of ``width`` bits for every row: the bits of its numbers. Numbers may share a bit."""
    held = np.zeros((rows, width), bool)
    held[of, (number * 2654435761 >> 7) % width] = True
    return np.packbits(held, axis=1, bitorder="little").view(np.uint64)
