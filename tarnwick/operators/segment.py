"""Words and sentences of a text by the default rules of Unicode Standard Annex 29."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

#: The break classes that the rules name; a character of none of them is Other.
SENTENCE_CLASSES = ("CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "STerm", "Close", "SContinue")
_SENTENCE = regex.compile("|".join(rf"(?P<{c}>\p{{Sentence_Break={c}}})" for c in SENTENCE_CLASSES))
#: A stretch between two default word boundaries.
_WORD = regex.compile(r"(?w)\b.+?(?:\b|$)", regex.DOTALL)
_WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{N}]")
_SEPARATORS = ("Sep", "CR", "LF")
#: Where a sentence may end, and what decides after a mark by SB8.
_ENDING = regex.compile(r"[\p{SB=ATerm}\p{SB=STerm}\p{SB=Sep}\p{SB=CR}\p{SB=LF}]")
#: The same up to U+FFFF, as a plain set that is found faster, and all letters beyond.
_MAY_END = re.compile(f"[{re.escape(''.join(_ENDING.findall(''.join(map(chr, range(0x10000))))))}\U00010000-\U0010ffff]")
_DECIDING = regex.compile(r"[\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\p{SB=CR}\p{SB=LF}\p{SB=ATerm}\p{SB=STerm}]")
#: The same words in ASCII without apostrophes: letters, digits and low lines, and a mark between two letters or two digits.
_ASCII_WORD = re.compile(r"(?:[A-Za-z0-9_]|(?<=[A-Za-z])[:.](?=[A-Za-z])|(?<=[0-9])[,;.](?=[0-9]))+")
_NOT_PLAIN = re.compile(r"[^\x00-\x26\x28-\x7f]")
_ASCII_WORDLIKE = re.compile(r"[A-Za-z0-9]")
#: Where a blank may not be a segment by itself: what joins with what is before it follows it or stands alone before it, and other wide
#: blanks and flags; such texts are segmented whole.
_ODD_BLANKS = regex.compile(r"(?V1)(?:^|[ \p{WB=CR}\p{WB=LF}\p{WB=Newline}])[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]|[\p{WB=WSegSpace}--[ ]]|\p{WB=Regional_Indicator}")
#: Stretches without blanks up to this length are remembered.
REMEMBERED_LENGTH = 40


@lru_cache(maxsize=1 << 16)
def sentence_class(letter: str) -> str:
    m = _SENTENCE.match(letter)
    return m.lastgroup if m else "Other"


def sentence_breaks(text: str) -> list[int]:
    """The places inside a text where a sentence ends, by the rules SB3 to SB998. Only marks and separators are stopped at, and
    what decides about a mark: the letter before it and what comes after. Extend and Format belong to what they follow (SB5)."""
    out: list[int] = []
    n, at = len(text), 0
    while (m := _MAY_END.search(text, at)) is not None:
        at = m.end()
        mark = sentence_class(m[0])
        if mark in ("ATerm", "STerm"):
            at = _after_mark(text, m.start(), mark, out)
        elif mark in _SEPARATORS and at < n and not (mark == "CR" and text[at] == "\n"):  # SB3, SB4
            out.append(at)
    return out


def _after_mark(text: str, mark_at: int, mark: str, out: list[int]) -> int:
    """Adds the end of the sentence that the mark ends, if it does; returns where to go on."""
    phase, decided, lower = "", -1, False  # phase: '' right after the mark, 'Close', 'Sp'
    for i in range(mark_at + 1, len(text)):
        c = sentence_class(text[i])
        if c in ("Extend", "Format"):
            continue
        if mark == "ATerm" and not phase and (c == "Numeric" or (c == "Upper" and _class_before(text, mark_at) in ("Upper", "Lower"))):
            return i  # SB6, SB7
        if c in ("SContinue", "ATerm", "STerm"):
            return i  # SB8a
        if mark == "ATerm":
            if decided < i:
                m = _DECIDING.search(text, i)
                decided, lower = (m.start(), sentence_class(m[0]) == "Lower") if m else (len(text), False)
            if lower:
                return i  # SB8
        if c == "Close" and phase != "Sp":
            phase = "Close"  # SB9
        elif c == "Sp":
            phase = "Sp"  # SB9, SB10
        else:
            if c not in _SEPARATORS:  # SB9, SB10; SB4 ends it after
                out.append(i)  # SB11
            return i
    return len(text)


def _class_before(text: str, at: int) -> str:
    """The class of the letter before a place, without Extend and Format."""
    for i in range(at - 1, -1, -1):
        if (c := sentence_class(text[i])) not in ("Extend", "Format"):
            return c
    return ""


def sentences(text: str) -> list[str]:
    """The sentences that have a letter or a digit, with the blanks that follow them."""
    cuts = [0, *sentence_breaks(text), len(text)]
    return [s for s in (text[a:b] for a, b in zip(cuts, cuts[1:])) if _WORDLIKE.search(s)]


def words(text: str) -> list[str]:
    """The stretches between word boundaries that have a letter or a digit."""
    if not text.isascii() and _ODD_BLANKS.search(text):
        return _words(text)
    out: list[str] = []
    at = 0
    while (m := _NOT_PLAIN.search(text, at)) is not None:  # no word goes over a blank
        start, end = max(at, text.rfind(" ", at, m.start()) + 1), text.find(" ", m.end())
        part = text[start : end if end >= 0 else len(text)]
        out += _plain_words(text[at:start])
        out += _remembered(part) if len(part) <= REMEMBERED_LENGTH else _words(part)
        at = start + len(part)
    return out + _plain_words(text[at:])


def _plain_words(text: str) -> list[str]:
    found = _ASCII_WORD.findall(text)
    return [w for w in found if _ASCII_WORDLIKE.search(w)] if "_" in text else found


def _words(text: str) -> list[str]:
    return [m[0] for m in _WORD.finditer(text) if _WORDLIKE.search(m[0])]


@lru_cache(maxsize=1 << 15)
def _remembered(text: str) -> tuple[str, ...]:
    return tuple(_words(text))
