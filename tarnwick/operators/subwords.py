"""Lengths of texts in subwords, by greedy longest match on a trie of a vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

#: A word or a mark by itself.
WORD = re.compile(r"\w+|[^\w\s]")
#: Characters of a word beyond which it is one unknown token.
LONGEST_WORD = 100
#: Words, and runs between blanks, whose number of pieces is remembered.
REMEMBERED = 1 << 18
END = ""


class _Remembered(dict):
    """Counts of texts, of which the first REMEMBERED short ones are kept."""

    def __init__(self, count: Callable[[str], int]):
        self.work = count

    def __missing__(self, text: str) -> int:
        n = self.work(text)
        if len(self) < REMEMBERED and len(text) <= LONGEST_WORD:
            self[text] = n
        return n


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in vocabularies of bytes: printable ones for themselves, the others from U+0100 on."""
    shown = {b: chr(b) for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    hidden = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Subwords:
    """A vocabulary of pieces. Pieces that end a word end in ``word_end``, those that don't begin one begin with
    ``inside``; a vocabulary has one of these marks, or none. With ``as_bytes`` pieces are spelt in byte letters."""

    def __init__(self, pieces: Iterable[str], word_end: str = "", inside: str = "", as_bytes: bool = False, lower: bool = True, specials: int = 2):
        self.word_end, self.inside, self.lower, self.specials = word_end, inside, lower, specials
        self.letters = byte_letters() if as_bytes else None
        self.first: dict = {}
        self.later: dict = self.first if not inside else {}
        self.known, self.runs = _Remembered(self._count), _Remembered(self._count_run)
        for piece in pieces:
            trie = self.first
            if inside and piece.startswith(inside):
                trie, piece = self.later, piece[len(inside) :]
            for letter in piece:
                trie = trie.setdefault(letter, {})
            trie[END] = True

    @classmethod
    def from_file(cls, path: str, **how) -> Subwords:
        """The vocabulary of a tokenizer file in JSON."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, spelt = model["model"], json.dumps([model.get("pre_tokenizer"), model.get("normalizer")])
        return cls(vocabulary["vocab"], vocabulary.get("end_of_word_suffix") or "", vocabulary.get("continuing_subword_prefix") or "", "ByteLevel" in spelt, **how)

    def pieces(self, word: str) -> list[str] | None:
        """The word as pieces, each the longest that fits; None if some place has none."""
        plain = not self.letters or (word.isascii() and word.isalnum())  # these stand for themselves
        spelt = word if plain else "".join(self.letters[b] for b in word.encode("utf-8", "replace"))
        if not word or len(word) > LONGEST_WORD:
            return None
        spelt += self.word_end
        out, at, trie = [], 0, self.first
        while at < len(spelt):
            node, end, i = trie, at, at
            while i < len(spelt) and (node := node.get(spelt[i])) is not None:
                i += 1
                if END in node:
                    end = i
            if end == at:
                return None
            out.append(spelt[at:end])
            at, trie = end, self.later
        return out

    def _count(self, word: str) -> int:
        return len(self.pieces(word) or (None,))

    def _count_run(self, run: str) -> int:
        return sum(map(self.known.__getitem__, WORD.findall(run)))

    def count(self, word: str) -> int:
        """How many tokens a word is; one if unknown."""
        return self.known[word]

    def length(self, text: str) -> int:
        """Tokens of a text, the special ones at its ends included. Words and marks end at blanks."""
        return sum(map(self.runs.__getitem__, (text.lower() if self.lower else text).split())) + self.specials

    length.adds = True


def words(text: str) -> int:
    """The length in words, where there is no vocabulary."""
    return len(text.split())


words.adds = True  # the length of texts joined by blanks is the sum of theirs, less what an empty text has


Length = Callable[[str], int]
