"""Splitting texts into snippets of bounded length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.operators.subwords import Length, words

length = words
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=\S)")
#: Where a too long sentence is cut, the first choice first; at last between any two characters.
CUTS = ("\n\n", "\n", " ", "")
#: Characters of texts whose snippets a task holds.
AT_ONCE = 1 << 20


def by_marks(text: str | None) -> list[str]:
    """Sentences end at each mark that a blank follows."""
    return [s.strip() for s in SENTENCE.split(text or "") if s.strip()]


def merged(parts: list[str], limit: int, joint: str, length: Length = words) -> list[str]:
    """Neighbours joined while they stay within the limit together."""
    return [text for text, _ in _merged([(p, length(p)) for p in parts], limit, joint, length)]


def _merged(parts: list[tuple[str, int]], limit: int, joint: str, length: Length) -> list[tuple[str, int]]:
    """merged() of texts and their lengths, to such. Where lengths add, no joined text is measured."""
    out: list[tuple[list[str], int]] = []
    size, between, empty = 0, length(joint), length("")
    for p, n in parts:
        if out and size + between + n <= limit:
            texts, total = out[-1]
            texts.append(p)
            size += between + n
            out[-1] = texts, total + n - empty
        else:
            out.append(([p], n))
            size = n
    joined = ((joint.join(texts), n, len(texts)) for texts, n in out)
    return [(t, n if k == 1 or getattr(length, "adds", False) else length(t)) for t, n, k in joined]


def cut(text: str, limit: int, length: Length = words, cuts: tuple[str, ...] = CUTS) -> list[str]:
    """Pieces within the limit: cut at the first of cuts that the text has, short neighbours joined again, and what is still
    too long cut at the next one. A single character is never cut."""
    if length(text) <= limit or len(text) <= 1:
        return [text]
    at = next((i for i, c in enumerate(cuts) if c in text), len(cuts) - 1)
    joint, rest = cuts[at], cuts[at + 1 :]
    parts = [p for p in text.split(joint) if p.strip()] if joint else _halves(text)
    if not joint:
        return [x for p in parts for x in cut(p, limit, length, ("",))]
    out: list[str] = []
    short: list[str] = []
    for p in [*parts, None]:
        if p is not None and length(p) <= limit:
            short.append(p)
            continue
        out += merged(short, limit, joint, length)
        short = []
        if p is not None:
            out += cut(p, limit, length, rest)
    return out


def _halves(text: str) -> list[str]:
    return [text[: len(text) // 2], text[len(text) // 2 :]]


@dataclass(frozen=True)
class Splitter:
    """Sentences merged up to chunk_size; what is longer than hard_limit is cut, and neighbours are merged up to it. ``length``
    counts words, or the tokens of a vocabulary (Subwords.length); ``sentences`` is by_marks or a trained model's split."""

    chunk_size: int = 500
    hard_limit: int = 520
    length: Length = words
    sentences: Callable[[str | None], list[str]] = by_marks

    def __call__(self, text: str | None) -> list[str]:
        out: list[tuple[str, int]] = []
        for chunk, n in _merged(self._measured(self.sentences(text)), self.chunk_size, "\n\n", self.length):
            out += [(chunk, n)] if n <= self.hard_limit else self._measured(cut(chunk, self.chunk_size, self.length))
        return self._within(_merged(out, self.hard_limit, "\n", self.length))

    def _measured(self, texts: list[str]) -> list[tuple[str, int]]:
        return [(t, self.length(t)) for t in texts]

    def _within(self, snippets: list[tuple[str, int]]) -> list[str]:
        """Joining can make more tokens than the parts had, where a mark of the vocabulary spans the joint."""
        return [x for s, n in snippets for x in ([s] if n <= self.hard_limit else cut(s, self.chunk_size, self.length))]


def split_one(text: str | None, chunk_size: int = 500, hard_limit: int = 520) -> list[str]:
    return Splitter(chunk_size, hard_limit)(text)


def split_text(text: Column, splitter: Splitter | int = Splitter(), hard_limit: int = 520) -> Column:  # noqa: B008
    """The snippets of a text. splitter: or its chunk size in words."""
    do = splitter if isinstance(splitter, Splitter) else Splitter(splitter, hard_limit)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield from _split_in_parts(texts, do)

    return run(text)


def _split_in_parts(texts: pd.Series, do: Splitter) -> Iterator[pd.Series]:
    """The snippets of a batch, as parts of about AT_ONCE characters, so that no task holds those of a whole batch."""
    part: list[list[str]] = []
    size = 0
    for t in texts:
        part.append(do(t))
        size += len(t or "")
        if size >= AT_ONCE:
            yield pd.Series(part, dtype=object)
            part, size = [], 0
    if part:
        yield pd.Series(part, dtype=object)
