"""Exact tokenization of whole texts with the tokenizers library, at one library call for each distinct word.

A text is cut at blanks that stand between two non-blank characters. Both vocabularies' pre-tokenizers always cut
there, so ids of the parts, in order, are the ids of the text. A worker keeps the ids of the words it has met
(``max_words``, then it starts anew); only unknown words reach the library, in batches.
"""

from __future__ import annotations

import os
import re
from itertools import compress, repeat
from operator import is_

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than blank and line feed; texts that hold such characters are cut by the slower, general pattern.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_HIGH = re.compile("[\u0130-\U0010ffff]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = ".,;:!?*$%&#|"

_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, max_words: int = 1_200_000) -> "WordEncoder":
    """The worker's encoder for a tokenizer file; it outlives tasks, so that words are learnt once for each worker."""
    key = (path, max_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, max_words)
    return _ENCODERS[key]


class WordEncoder:
    def __init__(self, path: str, max_words: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.max_words = max_words
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 0xFFFF else np.dtype("<u4")
        #: Where a blank before a word changes the ids, words at the start of a text are another kind of word.
        self.marks_blank = self.tok.normalizer is None
        self.marks = np.zeros(self.vocab, bool)
        for token, i in self.tok.get_vocab().items():
            self.marks[i] = token.startswith("Ġ") if self.marks_blank else token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Learn words of letters only, many in one text: there a token with the word mark begins (or ends) each word."""
        per = 500
        texts = [(" " if self.marks_blank else "") + " ".join(words[i : i + per]) for i in range(0, len(words), per)]
        size = self.dtype.itemsize
        for i, e in enumerate(self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            own = words[i * per : (i + 1) * per]
            at = np.flatnonzero(self.marks[ids]) + (not self.marks_blank)
            if len(at) != len(own):  # the library cut a word that str.isalpha() calls whole
                self.known.update(zip(own, self._library([" " + w if self.marks_blank else w for w in own])))
                continue
            raw = ids.tobytes()
            cuts = (at * size).tolist()
            cuts = [*cuts, len(raw)] if self.marks_blank else [0, *cuts]
            self.known.update(zip(own, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _split(self, word: str) -> list[str]:
        """A word as parts between which the pre-tokenizer always cuts: letters, then closing punctuation; lines.

        In a part that does not come first, the pieces have no blank before them, which a leading line feed marks.
        """
        out: list[str] = []
        for i, line in enumerate(word.split("\n")):
            if i:
                if not line or not out or line[0].isspace():
                    return [word]
                if self.marks_blank:
                    out.append("\n\n")  # the line feed itself
            core = line.rstrip(_TAIL)
            tail = line[len(core):]
            if not core or (tail and not core.isalpha()):
                return [word]
            out.append("\n" + core if i and self.marks_blank else core)
            if tail:
                out.append("\n" + tail)
        return out

    def _part(self, key: str) -> str:
        if key == "\n\n":
            return "\n"
        if key[0] == "\n":
            return key[1:]
        return " " + key if self.marks_blank else key

    def _learn(self, words: set[str]) -> None:
        known = self.known
        letters = [w for w in words if w.isalpha()]
        parts = {}
        for w in words:
            if not w.isalpha():
                core = w[:-1]
                parts[w] = [core, "\n" + w[-1]] if w[-1] in _TAIL and core.isalpha() else self._split(w)
        new = {p for ps in parts.values() for p in ps}.difference(known)
        letters = list({*letters, *(p for p in new if p.isalpha())})
        other = [p for p in new if not p.isalpha()]
        if letters:
            self._letters(letters)
        if other:
            known.update(zip(other, self._library([self._part(p) for p in other])))
        for w, ps in parts.items():
            if len(ps) > 1:
                known[w] = b"".join([known[p] for p in ps])

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``; null counts as empty."""
        if len(self.known) > self.max_words:
            self.known = {}
        if len(self.bare) > 50_000:
            self.bare = {}
        cut: list[tuple[list[str], list[bytes | None], list[str]]] = []
        unknown: set[str] = set()
        first: set[str] = set()
        get = self.known.get
        for t in texts:
            if not t:
                cut.append(([], [], []))
                continue
            if not self.marks_blank and not _HIGH.search(t):
                t = t.lower()  # as the normalizer does; it makes fewer words to learn
            if t[0] == " " or t[-1] == " " or "  " in t or " \n" in t or "\n " in t or _OTHER_SPACE.search(t):
                words = _CUT.split(t)
            else:
                words = t.split(" ")
            first.add(words[0])
            ids = list(map(get, words))
            missed = list(compress(words, map(is_, ids, repeat(None))))
            unknown.update(missed)
            cut.append((words, ids, missed))
        # a part that holds blanks of its own goes to the library whole
        odd = [w for w in unknown if not w or w[0] == "\n" or " " in w]
        if odd:
            unknown.difference_update(odd)
            self.known.update(zip(odd, self._library([" " + w for w in odd])))
        if unknown:
            self._learn(unknown)
        new = list(first.difference(self.bare))
        if new:
            self.bare.update(zip(new, self._library(new)))
        out, known = [], self.known
        for words, ids, missed in cut:
            at = -1
            for w in missed:
                at = ids.index(None, at + 1)
                ids[at] = known[w]
            if ids:
                ids[0] = self.bare[words[0]]
            out.append(b"".join(ids))
        return out
