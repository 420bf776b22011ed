"""Runs of one to three words as a trie in arrays, with CRC states that grow along its paths.

A block of texts has a trie of its own: its first level are the block's distinct words, and a node of the second or third level is
a pair (parent, word). Nodes are numbered by sorting these pairs, so each distinct run is one node with its count. A
node's CRC-32 is its parent's, carried over the blank and the next word: no run of words is ever written out as a text.

CRC-32 is linear over bits: crc(a + b) = move(crc(a), len(b)) ^ crc(b). Moving over a given number of bytes is a table look-up for
each of the four bytes of a state; words longer than the tables reach are carried over by zlib.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Everything but 0-9, a-z and bytes of non-ASCII characters parts words; A-Z become a-z, no other letter changes.
_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of text that a block gathers, and the longest slice of a text that is cut into words at once.
BLOCK = 4 << 20
_TABLED = 64


@functools.cache
def _moves() -> np.ndarray:
    """[length][byte of the state][its value] -> what it adds to the state once ``length`` bytes have followed."""
    out = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    for length in range(_TABLED + 1):
        zeros = b"\0" * length
        base = zlib.crc32(zeros)
        for i in range(4):
            out[length, i] = [zlib.crc32(zeros, v << (8 * i)) ^ base for v in range(256)]
    return out


class Block:
    """The words of some texts as numbers, in pieces: a text, or a slice of one that is followed by the two words after it."""

    def __init__(self):
        self._number: defaultdict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._ids: list[np.ndarray] = []
        self._own: list[int] = []
        self._text: list[int] = []
        self.n_bytes = 0

    def add(self, text: int, words: list[bytes], own: int) -> None:
        """``words`` of a text, of which runs begin at the first ``own`` ones."""
        self._ids.append(np.fromiter(map(self._number.__getitem__, words), np.int64, len(words)))
        self._own.append(own)
        self._text.append(text)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level of the trie: the texts that its runs begin in, their nodes, and the nodes' counts and CRCs."""
        vocabulary = list(self._number)
        sizes = np.array([len(x) for x in self._ids], np.int64)
        word = np.concatenate(self._ids) if self._ids else np.zeros(0, np.int64)
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(word)) - np.repeat(start, sizes)
        left = np.repeat(sizes, sizes) - place  # words from here to the end of the piece
        text, own = np.repeat(np.array(self._text, np.int64), sizes), place < np.repeat(np.array(self._own, np.int64), sizes)
        crc = np.array([zlib.crc32(w) for w in vocabulary], np.uint32)
        after = np.array([zlib.crc32(b" " + w) for w in vocabulary], np.uint32)
        length = np.array([len(w) + 1 for w in vocabulary], np.int64)
        node, at, state = word[own], np.flatnonzero(own), crc
        yield text[own], node, np.bincount(node, minlength=len(vocabulary)), state
        for level in (1, 2):
            more = left[at] > level
            at, node = at[more], node[more]
            pairs, node, counts = np.unique(node * len(vocabulary) + word[at + level], return_inverse=True, return_counts=True)
            parent, w = np.divmod(pairs, max(len(vocabulary), 1))
            old = state
            state = self._carried(old[parent], w, after, length, vocabulary)
            yield text[at], node, counts, state

    @staticmethod
    def _carried(state: np.ndarray, w: np.ndarray, after: np.ndarray, length: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
        moves, n = _moves(), length[w]
        short = np.minimum(n, _TABLED)
        out = after[w]
        for i in range(4):
            out = out ^ moves[short, i, (state >> np.uint32(8 * i)) & np.uint32(255)]
        for j in np.flatnonzero(n > _TABLED).tolist():
            out[j] = zlib.crc32(b" " + vocabulary[w[j]], int(state[j]))
        return out


def _slices(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text, in slices of about BLOCK bytes; all but the last end with two words that the next one begins with."""
    text = text.translate(_BYTES)
    at, carry = 0, []
    while len(text) - at > BLOCK:
        cut = text.rfind(b" ", at, at + BLOCK)
        if cut <= at:
            cut = text.find(b" ", at + BLOCK)
            if cut < 0:
                break
        words = carry + text[at:cut].split()
        at = cut
        if len(words) < 3:
            carry = words
            continue
        carry = words[-2:]
        yield words, len(words) - 2
    words = carry + text[at:].split()
    yield words, len(words)


def blocks(texts: list[bytes]) -> Iterator[Block]:
    """Texts in blocks of about BLOCK bytes; a long text goes through several."""
    block = Block()
    for i, text in enumerate(texts):
        for words, own in _slices(text):
            block.add(i, words, own)
            block.n_bytes += sum(map(len, words)) + len(words) if len(text) > BLOCK else len(text)
            if block.n_bytes >= BLOCK:
                yield block
                block = Block()
    yield block
